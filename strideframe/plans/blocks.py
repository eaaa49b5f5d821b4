"""Training blocks: sliced daily series, the block summary and the tables drawn from them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from strideframe.functions import columns as X, constants as K
from strideframe.operators import calendar, clean, rolling, stats, temporal

BLOCK = ("athlete_id", "block_name")


def block_series(days: DataFrame, blocks: DataFrame, fill: bool = False) -> DataFrame:
    """Daily rows per block with days from the block's first run day.

    `fill` carries VO2 and the marathon prediction forward inside a block, as the drawn
    series do; the summary is computed without it.
    """
    sliced = rolling.with_days_from_start(temporal.slice_blocks(days, blocks), BLOCK)
    return rolling.forward_fill(sliced, ["vo2MaxValue", "Marathon_pred"], BLOCK) if fill else sliced


def filled_days(days: DataFrame) -> DataFrame:
    return rolling.forward_fill(days, ["vo2MaxValue", "Marathon_pred"], ["athlete_id"])


def block_ranges(series: DataFrame) -> DataFrame:
    return series.groupBy(*BLOCK).agg(F.min("date").alias("start_date"),
                                      F.max("date").alias("end_date"))


def block_races(blocks: DataFrame, evaluated: DataFrame) -> DataFrame:
    """The race of each block: the first, by prediction date, whose label holds the first
    word of the block name."""
    named = blocks.select(*BLOCK, X.first_word("block_name").alias("_word")).distinct()
    first = rolling.top_row(
        evaluated.where(F.col("label").isNotNull()).select(
            "athlete_id", "label",
            F.struct("prediction_date", "race_date", "official_time_min",
                     "relevant_prediction").alias("race")),
        ["athlete_id", "label"], F.unix_date("race.prediction_date"))
    pairs = temporal.label_contains(named, first, ["athlete_id"], "_word", "label")
    chosen = (
        pairs.withColumnRenamed("_label", "label").join(first, ["athlete_id", "label"])
        .groupBy("athlete_id", "_word")
        .agg(F.min(F.struct("race.prediction_date", "label", "race")).getField("race").alias("race")))
    return named.join(chosen, ["athlete_id", "_word"], "left").select(
        *BLOCK, F.col("race.race_date").alias("race_date"),
        F.col("race.official_time_min").alias("actual_time"),
        F.col("race.relevant_prediction").alias("final_prediction"))


def block_summary(series: DataFrame, blocks: DataFrame, evaluated: DataFrame) -> DataFrame:
    """One row per block: outcome, volatility, stability, volume, drift and averages."""
    keys = list(BLOCK)
    rows = series.join(block_races(blocks, evaluated), keys, "left")
    rows = rolling.mark_stable_tail(rows, "Marathon_pred", "final_prediction", keys, "_stable")
    rows = rows.withColumn(
        "_place", F.row_number().over(rolling.latest_first(keys)))
    per_block = rows.groupBy(*keys).agg(
        F.max("race_date").alias("race_date"), F.max("actual_time").alias("actual_time"),
        F.max("final_prediction").alias("final_prediction"),
        F.avg("rolling_std_7_Marathond").alias("mean_volatility"),
        F.max("rolling_std_7_Marathond").alias("max_volatility"),
        F.min(F.when(F.col("_stable"), F.col("date"))).alias("stable_date"),
        F.avg(F.when(F.col("_place") <= K.TAIL_ROWS, F.col("Marathon_pred")))
        .alias("last_14_day_avg_prediction"),
        rolling.value_at_first("Marathon_pred").alias("_first_prediction"),
        F.avg("total_training_load").alias("avg_training_load"),
        F.avg("readiness_score_mean").alias("avg_readiness"),
        rolling.drift("vo2MaxValue").alias("vo2_drift"),
        F.avg("hrv_weekly_avg_clean").alias("avg_hrv"))
    weekly = calendar.period_totals(
        calendar.max_per_day(series, keys, "date", "total_distance_miles"),
        keys, "date", "total_distance_miles", "W-MON", out="weekly")
    error = F.col("final_prediction") - F.col("actual_time")
    return per_block.join(calendar.peak_and_mean(weekly, keys, "weekly"), keys, "left").select(
        *keys, "race_date", "actual_time", "final_prediction", error.alias("prediction_error"),
        X.error_bias(error).alias("prediction_bias"), "mean_volatility", "max_volatility",
        "stable_date", X.days_between("race_date", "stable_date").alias("days_stable_before_race"),
        "peak_weekly_mileage", "avg_weekly_mileage", "last_14_day_avg_prediction",
        (F.col("final_prediction") - F.col("_first_prediction")).alias("prediction_drift"),
        "avg_training_load", "avg_readiness", "vo2_drift", "avg_hrv")


def summary_row(summary: DataFrame, block_name: str) -> DataFrame:
    return summary.where(F.col("block_name") == block_name)


# --- tables drawn on the block and comparison pages ------------------------------------

def prediction_curve(series: DataFrame, summary: DataFrame) -> DataFrame:
    """Prediction per day with the stability band and a flag on the stable date."""
    known = clean.not_null(series, ["Marathon_pred"])
    finals = summary.select(*BLOCK, "final_prediction", "stable_date")
    curve = rolling.stability_band(known.join(finals, list(BLOCK)), "final_prediction")
    return curve.select(*BLOCK, "date", "Marathon_pred", "final_prediction", "band_lower",
                        "band_upper", "stable_date")


def accuracy_vs_stability(summary: DataFrame, unit: str = "mi") -> DataFrame:
    return summary.select(
        *BLOCK, "days_stable_before_race", F.abs("prediction_error").alias("absolute_error"),
        X.in_unit("peak_weekly_mileage", unit).alias("peak_weekly_distance"), "prediction_bias")


def volatility_by_block(summary: DataFrame) -> DataFrame:
    return summary.select(*BLOCK, "mean_volatility", "max_volatility", "prediction_bias",
                          "days_stable_before_race", "prediction_error").orderBy(
        F.col("mean_volatility").asc_nulls_last(), *BLOCK)


def stabilisation_points(summary: DataFrame) -> DataFrame:
    """Two points per block: where it settled and when it was raced."""
    points = F.array(
        F.struct(F.lit("stable").alias("point"), F.col("stable_date").alias("date")),
        F.struct(F.lit("race").alias("point"), F.col("race_date").alias("date")))
    return (summary.select(*BLOCK, "race_date", F.inline(points))
            .orderBy(F.col("race_date").asc_nulls_last(), *BLOCK, F.col("point").desc())
            .drop("race_date"))


def error_and_drift(summary: DataFrame) -> DataFrame:
    return summary.select(*BLOCK, "race_date", "prediction_error", "prediction_drift",
                          "prediction_bias", "actual_time", "final_prediction",
                          "days_stable_before_race").orderBy(
        F.col("race_date").asc_nulls_last(), *BLOCK)


def volatility_timeline(series: DataFrame, rows: int = 7) -> DataFrame:
    column = f"rolling_std_{rows}_Marathond"
    return clean.not_null(series, [column]).select(*BLOCK, "date", "days_from_start", column)


def aligned_predictions(series: DataFrame) -> DataFrame:
    return clean.not_null(series, ["Marathon_pred"]).select(
        *BLOCK, "date", "days_from_start", "Marathon_pred")


def volatility_relationship(series: DataFrame, x: str, unit: str = "mi") -> DataFrame:
    """15-row volatility against load, ACWR, readiness or (in display units) distance."""
    value = X.in_unit(x, unit) if x == "total_distance_miles" else F.col(x)
    picked = series.select(*BLOCK, "date", value.alias("x"),
                           F.col("rolling_std_15_Marathond").alias("volatility"), "Marathon_pred")
    return clean.not_null(picked, ["x", "volatility"])


def weekly_distance(series: DataFrame, unit: str = "mi") -> DataFrame:
    totals = calendar.period_totals(series, BLOCK, "date", "total_distance_miles", "W-SUN",
                                    out="miles", period_col="week_end")
    return totals.select(*BLOCK, "week_end", X.in_unit("miles", unit).alias("distance"))


def daily_distance(series: DataFrame, unit: str = "mi") -> DataFrame:
    shown = series.select(*BLOCK, "date", X.in_unit("total_distance_miles", unit).alias("distance"))
    return rolling.moving_average(shown, "distance", BLOCK, "average_7")


def load_series(series: DataFrame) -> DataFrame:
    return clean.select_existing(series, [*BLOCK, "date", "dailyTrainingLoadAcute",
                                          "dailyTrainingLoadChronic",
                                          "dailyAcuteChronicWorkloadRatio"])


def readiness_series(series: DataFrame) -> DataFrame:
    return series.select(*BLOCK, "date", "readiness_score_mean", "sleep_score_last",
                         (F.col("recovery_time_last") / 60).alias("recovery_hours"))


def physiology_series(series: DataFrame) -> DataFrame:
    return series.select(*BLOCK, "date", "vo2MaxValue", "hrv_weekly_avg_clean", "avg_hr")


def status_distribution(series: DataFrame, column: str) -> DataFrame:
    return stats.value_counts(series, column, BLOCK, "days")


def loaded_days(series: DataFrame) -> DataFrame:
    return series.where(F.col("total_training_load") > 0)


def block_headline(summary: DataFrame, unit: str = "mi") -> DataFrame:
    """The labelled numbers shown at the top of a block page."""
    days = F.concat(F.col("days_stable_before_race").cast("string"), F.lit(" days"))
    return summary.select(
        *BLOCK, X.minutes_label("actual_time").alias("official_time"),
        X.minutes_label("final_prediction").alias("final_prediction_label"),
        F.concat(X.signed_text("prediction_error"), F.lit(" min")).alias("error_label"),
        X.title_label("prediction_bias").alias("bias_label"),
        F.coalesce(days, F.lit("N/A")).alias("stable_label"),
        X.date_label("stable_date").alias("stable_date_label"),
        X.distance_label("peak_weekly_mileage", unit).alias("peak_week_label"),
        X.distance_label("avg_weekly_mileage", unit).alias("avg_week_label"),
        X.fixed_text("avg_training_load", 0).alias("load_label"),
        X.fixed_text("avg_readiness").alias("readiness_label"),
        X.fixed_text("avg_hrv").alias("hrv_label"))


def race_reports(summary: DataFrame, unit: str = "mi", device: str = "the watch") -> DataFrame:
    return summary.select(*BLOCK, X.race_report(unit, device).alias("report"))
