"""Overview tables: volume history, timeline, headline numbers and top picks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions import columns as X, constants as K
from strideframe.operators import calendar, clean


def monthly_volume(runs: DataFrame, unit: str = "mi") -> DataFrame:
    dated = clean.not_null(runs, ["start_time"])
    totals = calendar.period_totals(dated, ["athlete_id"], "start_time", "distance_miles", "M",
                                    out="distance_miles", period_col="month_end")
    return totals.withColumn("distance", X.in_unit("distance_miles", unit))


def timeline(days: DataFrame, summary: DataFrame, unit: str = "mi",
             start: str = K.TIMELINE_START) -> DataFrame:
    """Weekly distance, VO2, marathon prediction and race markers as one long table."""
    recent = clean.since(days, start)
    weekly = calendar.period_totals(recent, ["athlete_id"], "date", "total_distance_miles",
                                    "W-SUN", out="miles")
    weekly = weekly.select("athlete_id", F.lit("weekly_distance").alias("series"),
                           F.col("period_end").alias("date"),
                           X.in_unit("miles", unit).alias("value"),
                           F.lit(None).cast("string").alias("label"))
    lines = recent.select(
        "athlete_id", "date", F.inline(F.array(
            F.struct(F.lit("vo2_max").alias("series"), F.col("vo2MaxValue").alias("value")),
            F.struct(F.lit("marathon_prediction").alias("series"),
                     F.col("Marathon_pred").alias("value")))))
    lines = lines.where((F.col("series") == "vo2_max") | F.col("value").isNotNull())
    markers = clean.not_null(summary, ["race_date"]).select(
        "athlete_id", F.lit("race").alias("series"), F.col("race_date").alias("date"),
        X.short_block_name("block_name").alias("label"))
    return (weekly.unionByName(lines, allowMissingColumns=True)
            .unionByName(markers, allowMissingColumns=True))


def overview_totals(runs: DataFrame, summary: DataFrame) -> DataFrame:
    """Runs, distance, first and last run, blocks, mean absolute error and peak week."""
    ran = runs.groupBy("athlete_id").agg(
        F.count(F.lit(1)).alias("total_runs"), F.sum("distance_miles").alias("total_miles"),
        F.min("start_time").cast("date").alias("first_run"),
        F.max("start_time").cast("date").alias("latest_run"))
    raced = summary.groupBy("athlete_id").agg(
        F.countDistinct("block_name").alias("blocks"),
        F.avg(F.abs("prediction_error")).alias("mean_abs_error"),
        F.max("peak_weekly_mileage").alias("peak_weekly"))
    return ran.join(raced, ["athlete_id"], "left")


def block_snapshot(summary: DataFrame) -> DataFrame:
    return summary.select(
        "athlete_id", X.short_block_name("block_name").alias("block"), "race_date",
        X.minutes_label("actual_time").alias("time_label"),
        F.concat(X.signed_text("prediction_error"), F.lit(" min")).alias("error_label")).orderBy(
        F.col("race_date").asc_nulls_last(), "athlete_id", "block")


def race_markers(summary: DataFrame) -> DataFrame:
    return summary.select(
        "athlete_id", X.short_block_name("block_name").alias("block"), "race_date",
        X.date_label("race_date").alias("date_label"),
        X.minutes_label("actual_time").alias("time_label")).orderBy(
        F.col("race_date").asc_nulls_last(), "athlete_id", "block")


def top_picks(summary: DataFrame, picks: dict[str, tuple[Column, bool]]) -> DataFrame:
    """One block per athlete and finding: the smallest or largest value of its measure.

    All findings come from one pass; equal values go to the first block name.
    """
    def pick(measure: Column, largest: bool) -> Column:
        rank = -measure if largest else measure
        return F.min(F.when(measure.isNotNull(), F.struct(
            rank.alias("rank"), F.col("block_name"), measure.alias("value"))))

    best = summary.groupBy("athlete_id").agg(
        *[pick(m.cast("double"), largest).alias(name) for name, (m, largest) in picks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("finding"),
                              F.col(name).getField("block_name").alias("block_name"),
                              F.col(name).getField("value").alias("value")) for name in picks])
    return best.select("athlete_id", F.inline(rows)).where(F.col("block_name").isNotNull())


def key_findings(summary: DataFrame) -> DataFrame:
    error = F.abs("prediction_error")
    return top_picks(summary, {
        "closest_prediction": (error, False),
        "biggest_miss": (error, True),
        "earliest_stability": (F.col("days_stable_before_race"), True),
        "highest_peak": (F.col("peak_weekly_mileage"), True),
        "best_marathon": (F.col("actual_time"), False)})


def dynamics_headline(summary: DataFrame) -> DataFrame:
    return top_picks(summary, {
        "lowest_volatility": (F.col("mean_volatility"), False),
        "highest_volatility": (F.col("mean_volatility"), True),
        "earliest_stability": (F.col("days_stable_before_race"), True),
        "closest_prediction": (F.abs("prediction_error"), False)})


def pairs(df: DataFrame, x: str, y: str, *extra: str) -> DataFrame:
    return clean.not_null(df.select(*extra, x, y), [x, y])


def longest_run(runs: DataFrame, value: str = "distance_miles") -> DataFrame:
    """All runs that reach their athlete's greatest distance."""
    best = runs.groupBy("athlete_id").agg(F.max(value).alias("_best"))
    return runs.join(best, ["athlete_id"]).where(F.col(value) == F.col("_best")).drop("_best")
