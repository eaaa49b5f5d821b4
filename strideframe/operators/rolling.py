"""Row-window operators over a daily series.

Contract: the input holds at most one row per key and date (the daily roll-ups guarantee it).
A window partition is therefore bounded by the calendar, about 366 rows per athlete and year,
whatever share of the raw rows an athlete has. Operators over raw rows belong in
`temporal`, which splits a key into time chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from strideframe.functions import constants as K
from strideframe.functions.columns import days_between

UNBOUNDED = Window.unboundedPreceding


def by_date(keys: Sequence[str], date_col: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(date_col)


def latest_first(keys: Sequence[str], date_col: str = "date") -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(date_col).desc())


def full_window_std(value: str, rows: int, spec: WindowSpec) -> Column:
    """Sample deviation of the last `rows` rows; NULL until they are all there and non-null."""
    frame = spec.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(value).over(frame) == rows, F.stddev_samp(value).over(frame))


def rolling_volatility(days: DataFrame, keys: Sequence[str] = ("athlete_id",),
                       date_col: str = "date",
                       columns: dict[str, str] | None = None,
                       windows: Sequence[int] = K.ROLLING_WINDOWS) -> DataFrame:
    """Add `rolling_std_{rows}_{label}d` for every prediction column and window length.

    All columns share one partitioning and one sort.
    """
    columns = columns or {p: p.removesuffix("_pred") for p in K.PREDICTION_COLUMNS}
    spec = by_date(keys, date_col)
    return days.withColumns({
        f"rolling_std_{rows}_{label}d": full_window_std(f"`{name}`", rows, spec)
        for name, label in columns.items() for rows in windows})


def moving_average(days: DataFrame, value: str, keys: Sequence[str], out: str,
                   rows: int = 7, date_col: str = "date") -> DataFrame:
    """Mean of the last `rows` rows, or of as many as there are."""
    return days.withColumn(out, F.avg(value).over(by_date(keys, date_col).rowsBetween(-(rows - 1), 0)))


def forward_fill(days: DataFrame, columns: Sequence[str], keys: Sequence[str],
                 date_col: str = "date") -> DataFrame:
    frame = by_date(keys, date_col).rowsBetween(UNBOUNDED, 0)
    return days.withColumns({c: F.last(f"`{c}`", ignorenulls=True).over(frame) for c in columns})


def mark_stable_tail(days: DataFrame, prediction: str, final: str, keys: Sequence[str],
                     out: str = "stable_from_here", date_col: str = "date",
                     tolerance: float = K.STABILITY_MINUTES) -> DataFrame:
    """True where this and every later row lies within `tolerance` of the final prediction.

    A missing prediction is not stable. "Every later row" is a running minimum in
    descending date order, one pass, rather than a frame that looks ahead from each row.
    """
    near = F.coalesce(F.abs(F.col(prediction) - F.col(final)) <= tolerance, F.lit(False))
    frame = latest_first(keys, date_col).rowsBetween(UNBOUNDED, 0)
    return days.withColumn(out, F.min(near).over(frame))


def stabilisation(days: DataFrame, prediction: str, final: str, keys: Sequence[str],
                  date_col: str = "date", tolerance: float = K.STABILITY_MINUTES) -> DataFrame:
    """First date of the stable tail per key; NULL when the key never settles."""
    marked = mark_stable_tail(days, prediction, final, keys, "_stable", date_col, tolerance)
    return marked.groupBy(*keys).agg(
        F.min(F.when(F.col("_stable"), F.col(date_col))).alias("stable_date"))


def tail_mean(days: DataFrame, value: str, keys: Sequence[str], out: str,
              rows: int = K.TAIL_ROWS, date_col: str = "date") -> DataFrame:
    """Mean over the last `rows` rows of each key."""
    place = F.row_number().over(latest_first(keys, date_col))
    return (days.withColumn("_place", place).where(F.col("_place") <= rows)
            .groupBy(*keys).agg(F.avg(value).alias(out)))


def with_days_from_start(days: DataFrame, keys: Sequence[str], date_col: str = "date",
                         out: str = "days_from_start") -> DataFrame:
    first = F.min(date_col).over(Window.partitionBy(*keys))
    return days.withColumn(out, days_between(date_col, first))


def value_at_first(value: str, date_col: str = "date") -> Column:
    """Aggregate: the value on the first date, NULL if it is NULL there."""
    return F.min_by(F.struct(F.col(value).alias("v")), date_col).getField("v")


def value_at_last(value: str, date_col: str = "date") -> Column:
    return F.max_by(F.struct(F.col(value).alias("v")), date_col).getField("v")


def drift(value: str, date_col: str = "date") -> Column:
    """Aggregate: value on the last date minus value on the first date."""
    return value_at_last(value, date_col) - value_at_first(value, date_col)


def stability_band(days: DataFrame, final: str,
                   tolerance: float = K.STABILITY_MINUTES) -> DataFrame:
    return days.withColumns({"band_lower": F.col(final) - tolerance,
                             "band_upper": F.col(final) + tolerance})


def top_row(df: DataFrame, keys: Sequence[str], order: Column, largest: bool = False) -> DataFrame:
    """The one whole row per key with the smallest (or largest) order value.

    An aggregate with map-side combine, so a hot key is reduced before the shuffle. Ties
    fall to the smallest row content; a row whose order is NULL is used only when no other
    exists.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = -order if largest else order
    row = F.struct(rank.isNull().alias("_none"), rank.alias("_rank"), *rest)
    best = df.groupBy(*keys).agg(F.min(row).alias("_row"))
    return best.select(*[F.col(c) if c in keys else F.col("_row").getField(c).alias(c)
                         for c in df.columns])
