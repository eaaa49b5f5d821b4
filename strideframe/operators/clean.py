"""Row and column filters, unit scaling and deduplication."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from strideframe.functions import columns as X, constants as K


def select_existing(df: DataFrame, names: Sequence[str]) -> DataFrame:
    have = set(df.columns)
    return df.select(*[F.col(f"`{n}`") for n in names if n in have])


def with_missing(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    """Add each absent column as a typed NULL, so that output schemas are stable."""
    have = set(df.columns)
    return df.withColumns({n: F.lit(None).cast(t) for n, t in fields.items() if n not in have})


def drop_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.drop(*names)


def not_null(df: DataFrame, names: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(names))


def since(df: DataFrame, date: str, column: str = "date") -> DataFrame:
    return df.where(F.col(column) >= F.lit(date).cast("date"))


def of_type(events: DataFrame, event_type: str) -> DataFrame:
    return events.where(F.col("event_type") == event_type)


def running_activities(activities: DataFrame) -> DataFrame:
    """Outdoor runs only: treadmill, track and indoor types are other labels."""
    return activities.where(F.col("activityType") == "running")


def scale_units(runs: DataFrame) -> DataFrame:
    """Raw device units -> minutes, kilometres, miles, metres and metres per second."""
    started = X.epoch_ms_to_timestamp("startTimeLocal")
    max_speed, avg_speed = F.col("maxSpeed") * 10, F.col("avgSpeed") * 10
    scaled: dict[str, Column] = {
        "start_time": started,
        "date": started.cast("date"),
        "duration_minutes": X.ms_to_minutes("duration"),
        "distance_km": F.col("distance") / K.CM_PER_KM,
        "distance_miles": F.col("distance") / K.CM_PER_MILE,
        "elevation_gain_m": F.col("elevationGain") / 100,
        "elevation_loss_m": F.col("elevationLoss") / 100,
        "max_speed_mps": max_speed,
        "max_pace_mile": X.pace_label(max_speed, "mile"),
        "max_pace_km": X.pace_label(max_speed, "km"),
        "avg_speed_mps": avg_speed,
        "avg_pace_mile": X.pace_label(avg_speed, "mile"),
        "avg_pace_km": X.pace_label(avg_speed, "km"),
        "avg_stride_length_m": F.col("avgStrideLength") / 100,
        "elapsed_duration_minutes": X.ms_to_minutes("elapsedDuration"),
        "moving_duration_minutes": X.ms_to_minutes("movingDuration"),
    }
    return runs.withColumns(scaled)


def zone_minutes(runs: DataFrame) -> DataFrame:
    """Heart-rate zones 1-6 and power zones 1-5 in minutes, for the zones present."""
    zones = ([f"hrTimeInZone_{i}" for i in range(1, 7)]
             + [f"powerTimeInZone_{i}" for i in range(1, 6)])
    present = [z for z in zones if z in runs.columns]
    return runs.withColumns({f"{z}_minutes": X.ms_to_minutes(z) for z in present})


def runs_table(activities: DataFrame) -> DataFrame:
    """Raw activities -> one cleaned row per run."""
    runs = zone_minutes(scale_units(running_activities(X.nan_to_null(activities))))
    return drop_columns(runs, K.DROPPED_ACTIVITY_COLUMNS)


# --- deduplication --------------------------------------------------------------------

ORDER_COLUMNS = ("source_file", "timestampLocal", "timestamp")


def keep_one(df: DataFrame, keys: Sequence[str], keep: str = "last",
             order: Sequence[str] = ORDER_COLUMNS) -> DataFrame:
    """One whole row per key: the first or last by `order`, then by row content.

    Written as an aggregate of a struct rather than as a window, so each map task sends at
    most one row per key to the shuffle and a hot key costs no more than any other. The row
    content closes the order, so the result does not depend on file or row order.
    """
    keys = list(keys)
    lead = [c for c in order if c in df.columns and c not in keys]
    rest = [c for c in df.columns if c not in keys and c not in lead]
    row = F.struct(*[F.col(f"`{c}`") for c in lead + rest])
    pick = F.min(row) if keep == "first" else F.max(row)
    picked = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(pick.alias("_row"))
    return picked.select(*[
        F.col(f"`{c}`") if c in keys else F.col("_row").getField(c).alias(c)
        for c in df.columns])


def dedup_dates(df: DataFrame, keep: str, keys: Sequence[str] = ("athlete_id", "date")) -> DataFrame:
    return keep_one(df, keys, keep)


def duplicate_report(df: DataFrame, key: str) -> DataFrame:
    """Rows beyond the first per key value, the number of keys and the most repeated key.

    NULL counts as one key value. The most repeated key is the smallest on ties.
    """
    per_key = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    busiest = F.max(F.when(F.col("_key").isNotNull(), F.col("_n")))
    totals = per_key.agg(
        (F.sum("_n") - F.count(F.lit(1))).cast("bigint").alias("duplicated_rows"),
        F.count(F.lit(1)).alias("distinct_keys"),
        busiest.alias("top_count"),
        # the struct minimum of (-n, key) is the busiest, then smallest, key
        F.min(F.when(F.col("_key").isNotNull(), F.struct(-F.col("_n"), F.col("_key"))))
        .getField("_key").alias("top_key"))
    return totals.select("duplicated_rows", "distinct_keys", "top_key", "top_count")
