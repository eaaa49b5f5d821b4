"""Calendar buckets: totals per week, month or year, with empty periods filled by zero."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from strideframe.functions.columns import ColumnOrName, as_col, year_of

PERIODS = ("W-SUN", "W-MON", "M")


def week_end(date: ColumnOrName, weekday: str = "SUN") -> Column:
    """Last day of the week the date falls in, for weeks ending on `weekday`."""
    return F.next_day(F.date_sub(as_col(date).cast("date"), 1), weekday)


def month_end(date: ColumnOrName) -> Column:
    return F.last_day(as_col(date).cast("date"))


def week_start(date: ColumnOrName) -> Column:
    """Monday of the calendar week."""
    return F.date_trunc("week", as_col(date)).cast("date")


def period_end(date: ColumnOrName, period: str) -> Column:
    if period not in PERIODS:
        raise ValueError(f"period must be one of {PERIODS}, got {period!r}")
    return month_end(date) if period == "M" else week_end(date, period.split("-")[1])


def _grouping(keys: Sequence[str]) -> list[Column]:
    # Without keys the rows are one total per period, so that one task holds one row per
    # week of the calendar, however large the input was.
    return [F.col(k) for k in keys] or [F.lit(0)]


def period_totals(df: DataFrame, keys: Sequence[str], date_col: str, value_col: str,
                  period: str = "W-SUN", out: str = "total", fill: bool = True,
                  period_col: str = "period_end") -> DataFrame:
    """Sum of a value per key and period; `fill` adds the empty periods between as 0.

    The sum is combined before the shuffle, so the window that finds the next period sees one
    row per key and period. Each row then unfolds the gap up to the next period itself; there
    is no second read of the input and no join against a calendar.
    """
    sums = (
        df.where(F.col(date_col).isNotNull())
        .groupBy(*keys, period_end(date_col, period).alias("_end"))
        .agg(F.coalesce(F.sum(value_col), F.lit(0.0)).alias("_sum")))
    if not fill:
        return sums.select(*keys, F.col("_end").alias(period_col), F.col("_sum").alias(out))
    following = F.lead("_end").over(Window.partitionBy(*_grouping(keys)).orderBy("_end"))
    if period == "M":
        start, step = F.trunc("_end", "MM"), F.expr("INTERVAL 1 MONTH")
        stop = F.add_months(F.trunc("_next", "MM"), -1)
    else:
        start, step = F.col("_end"), F.expr("INTERVAL 7 DAYS")
        stop = F.date_sub("_next", 7)
    slots = F.sequence(start, F.coalesce(stop, start), step)
    spread = (sums.withColumn("_next", following)
              .select(*keys, "_end", "_sum", F.explode(slots).alias("_slot")))
    slot_end = F.last_day("_slot") if period == "M" else F.col("_slot")
    return spread.select(
        *keys, slot_end.alias(period_col),
        F.when(slot_end == F.col("_end"), F.col("_sum")).otherwise(F.lit(0.0)).alias(out))


def peak_and_mean(totals: DataFrame, keys: Sequence[str], value_col: str,
                  peak: str = "peak_weekly_mileage", mean: str = "avg_weekly_mileage") -> DataFrame:
    """Peak and mean over period totals; filled periods count as zero in the mean."""
    return totals.groupBy(*keys).agg(F.max(value_col).alias(peak), F.avg(value_col).alias(mean))


def max_per_day(df: DataFrame, keys: Sequence[str], date_col: str, value_col: str) -> DataFrame:
    """Repeated dates collapsed to their largest value."""
    return df.groupBy(*keys, date_col).agg(F.max(value_col).alias(value_col))


def calendar_week_totals(df: DataFrame, keys: Sequence[str], time_col: str, value_col: str,
                         out: str = "total") -> DataFrame:
    """Sum per Monday-based week; weeks without rows are not added."""
    return df.groupBy(*keys, week_start(time_col).alias("week")).agg(F.sum(value_col).alias(out))


def yearly_totals(df: DataFrame, keys: Sequence[str], time_col: str, value_col: str,
                  out: str = "total") -> DataFrame:
    return df.groupBy(*keys, year_of(time_col).alias("year")).agg(F.sum(value_col).alias(out))
