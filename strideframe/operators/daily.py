"""Roll-ups to one row per athlete and date, and the joined daily master table.

Every side of the master join is first reduced to unique (athlete_id, date) rows by an
aggregate with map-side combine. The five left joins then reuse the hash partitioning of
those aggregates: each source is shuffled once, already small, and no athlete can be a hot
join key because a key holds one row per side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions import columns as X, constants as K
from strideframe.operators import clean

DAY = ("athlete_id", "date")


def total(name: str) -> Column:
    """Sum in which a group without values is 0, not NULL."""
    return F.coalesce(F.sum(F.col(name).cast("double")), F.lit(0.0))


def count_true(name: str) -> Column:
    return F.coalesce(F.sum(F.col(name).cast("int")), F.lit(0)).cast("bigint")


def first_value(name: str, order: Column) -> Column:
    """First non-null value by `order`; rows with a NULL order are ignored by min_by."""
    return F.min_by(name, F.when(F.col(name).isNotNull(), order))


def last_value(name: str, order: Column) -> Column:
    return F.max_by(name, F.when(F.col(name).isNotNull(), order))


def daily_runs(runs: DataFrame) -> DataFrame:
    """One row per athlete and run day; runs without a date are left out."""
    return (
        runs.where(F.col("date").isNotNull())
        .groupBy(*DAY)
        .agg(
            F.count("activityId").alias("run_count"),
            total("distance_km").alias("total_distance_km"),
            total("distance_miles").alias("total_distance_miles"),
            total("duration_minutes").alias("total_duration_minutes"),
            total("moving_duration_minutes").alias("total_moving_minutes"),
            total("elevation_gain_m").alias("total_elevation_gain_m"),
            F.avg("avgHr").alias("avg_hr"),
            F.max("maxHr").alias("max_hr"),
            X.mean_pace("avg_speed_mps").alias("avg_pace_mile"),
            F.avg("avg_stride_length_m").alias("avg_stride_length_m"),
            total("activityTrainingLoad").alias("total_training_load"),
            F.avg("aerobicTrainingEffect").alias("aerobic_te_avg"),
            F.avg("anaerobicTrainingEffect").alias("anaerobic_te_avg"),
            count_true("pr").alias("pr_count"),
            F.avg("avgPower").alias("avg_power"),
            F.max("maxPower").alias("max_power"),
            F.avg("avgDoubleCadence").alias("avg_cadence"),
        ))


def snapshot_order(df: DataFrame) -> Column:
    """Order of a day's snapshots: timestamp with NULL last, then file and content."""
    stamp = F.coalesce(*[F.col(c) for c in ("timestampLocal", "timestamp") if c in df.columns])
    ties = [c for c in ("source_file", "score", "level") if c in df.columns]
    return F.struct(stamp.isNull(), stamp, *ties)


def daily_readiness(readiness: DataFrame) -> DataFrame:
    order = snapshot_order(readiness)
    return readiness.groupBy(*DAY).agg(
        first_value("score", order).alias("readiness_score_first"),
        last_value("score", order).alias("readiness_score_last"),
        F.avg("score").alias("readiness_score_mean"),
        last_value("level", order).alias("readiness_level_last"),
        last_value("recoveryTime", order).alias("recovery_time_last"),
        last_value("acuteLoad", order).alias("acute_load_last"),
        last_value("hrvWeeklyAverage", order).alias("hrv_weekly_avg_last"),
        last_value("sleepScore", order).alias("sleep_score_last"),
        F.max("validSleep").alias("valid_sleep_any"),
        F.count("score").alias("readiness_snapshots"),
    )


def daily_history(history: DataFrame) -> DataFrame:
    order = F.struct(*[c for c in ("source_file", "trainingStatus", "fitnessLevelTrend",
                                   "loadLevelTrend") if c in history.columns])
    status_last = last_value("trainingStatus", order)
    return history.groupBy(*DAY).agg(
        F.min("loadTunnelMin").alias("load_tunnel_min"),
        first_value("trainingStatus", order).alias("training_status_first"),
        status_last.alias("training_status_last"),
        status_last.alias("training_status"),
        last_value("fitnessLevelTrend", order).alias("fitness_level_trend"),
        last_value("loadLevelTrend", order).alias("load_level_trend"),
        F.max("loadTunnelMax").alias("load_tunnel_max"),
    )


def prediction_labels(predictions: DataFrame) -> DataFrame:
    """Race predictions in seconds -> `HH:MM:SS` text columns."""
    return predictions.withColumns(
        {name: X.seconds_to_hms(raw) for name, raw in K.PREDICTION_SECONDS.items()})


def _one_per_day(source: DataFrame, columns: Sequence[str], keep: str) -> DataFrame:
    """The wanted columns of one row per day. Columns are cut before the deduplication, which
    packs whole rows and would otherwise read and shuffle all of them."""
    narrow = clean.select_existing(source, [*DAY, *clean.ORDER_COLUMNS, *columns])
    return clean.dedup_dates(narrow, keep).drop(*clean.ORDER_COLUMNS)


def join_metrics(days: DataFrame, metrics: DataFrame) -> DataFrame:
    return days.join(_one_per_day(metrics, K.METRIC_COLUMNS, "first"), list(DAY), "left")


def join_predictions(days: DataFrame, predictions: DataFrame) -> DataFrame:
    """`predictions` holds the seconds, or already the text columns."""
    if "Marathon_pred" in predictions.columns:
        side = _one_per_day(predictions, K.PREDICTION_COLUMNS, "last")
    else:
        raw = list(K.PREDICTION_SECONDS.values())
        side = prediction_labels(_one_per_day(predictions, raw, "last")).drop(*raw)
    return days.join(side, list(DAY), "left")


def join_maxmet(days: DataFrame, maxmet: DataFrame) -> DataFrame:
    return days.join(_one_per_day(maxmet, K.MAXMET_COLUMNS, "last"), list(DAY), "left")


def join_readiness(days: DataFrame, readiness: DataFrame) -> DataFrame:
    return days.join(daily_readiness(readiness), list(DAY), "left")


def join_history(days: DataFrame, history: DataFrame) -> DataFrame:
    return days.join(daily_history(history), list(DAY), "left")


_ABSENT = {
    "metrics": {c: "string" if "Status" in c else "double" for c in K.METRIC_COLUMNS},
    "predictions": {c: "string" for c in K.PREDICTION_COLUMNS},
    "maxmet": {c: "string" if "Description" in c else "double" for c in K.MAXMET_COLUMNS},
    "readiness": {
        "readiness_score_first": "double", "readiness_score_last": "double",
        "readiness_score_mean": "double", "readiness_level_last": "string",
        "recovery_time_last": "double", "acute_load_last": "double",
        "hrv_weekly_avg_last": "double", "sleep_score_last": "double",
        "valid_sleep_any": "boolean", "readiness_snapshots": "bigint"},
    "history": {
        "load_tunnel_min": "double", "training_status_first": "string",
        "training_status_last": "string", "training_status": "string",
        "fitness_level_trend": "string", "load_level_trend": "string",
        "load_tunnel_max": "double"},
}


def daily_master(runs: DataFrame, metrics: DataFrame | None = None,
                 predictions: DataFrame | None = None, maxmet: DataFrame | None = None,
                 readiness: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """One row per athlete and run day with every daily source joined on.

    A source that is not given contributes its columns as NULL.
    """
    days = daily_runs(runs)
    steps = (("metrics", metrics, join_metrics), ("predictions", predictions, join_predictions),
             ("maxmet", maxmet, join_maxmet), ("readiness", readiness, join_readiness),
             ("history", history, join_history))
    for name, source, join in steps:
        days = join(days, source) if source is not None else clean.with_missing(days, _ABSENT[name])
    return days


def analysis_days(master: DataFrame) -> DataFrame:
    """Daily master with the HRV sentinel removed and predictions in minutes."""
    return master.withColumns({
        "hrv_weekly_avg_clean": X.null_if("hrv_weekly_avg_last", float(K.HRV_MISSING)),
        **{p: X.prediction_minutes(f"`{p}`") for p in K.PREDICTION_COLUMNS},
    })
