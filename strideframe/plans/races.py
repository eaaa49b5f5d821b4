"""Race calendar, race evaluation against predictions, and personal bests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from strideframe.functions import columns as X, constants as K
from strideframe.operators import clean, stats, temporal
from strideframe.operators.rolling import top_row

ROLLING_COLUMNS = tuple(
    f"rolling_std_{rows}_{p.removesuffix('_pred')}d"
    for p in K.PREDICTION_COLUMNS for rows in K.ROLLING_WINDOWS)


def race_calendar(events: DataFrame) -> DataFrame:
    """Races with the day before as prediction date, so that race day cannot leak in."""
    return clean.of_type(events, "race").select(
        "athlete_id", F.col("date").alias("race_date"), "label", "race_type",
        "official_time_min", F.date_sub("date", 1).alias("prediction_date"))


def evaluate_races(events: DataFrame, days: DataFrame, overrides: DataFrame | None = None,
                   override_errors: bool = True) -> DataFrame:
    """Each race with the last prediction known before it, its error and its volatility.

    `days` is the daily series with predictions in minutes and rolling deviations.
    `overrides` (athlete_id, label, prediction_date) moves the prediction date of single
    races. With `override_errors=False` an override moves only the volatility columns and
    the reported dates, and the error stays that of the day before the race.
    """
    races = race_calendar(events)
    moved = temporal.apply_overrides(races, overrides, ["athlete_id", "label"], "prediction_date")
    predictions, rolling = list(K.PREDICTION_COLUMNS), list(ROLLING_COLUMNS)

    def matched(left: DataFrame, payload: list[str]) -> DataFrame:
        return temporal.asof_join(left, days, ["athlete_id"], "prediction_date", "date", payload,
                                  matched="prediction_date_matched")

    if override_errors or overrides is None:
        joined = matched(moved, predictions + rolling)
    else:
        first = matched(races, predictions).drop("prediction_date_matched")
        again = temporal.apply_overrides(first, overrides, ["athlete_id", "label"],
                                         "prediction_date")
        joined = matched(again, rolling)
    scored = joined.withColumn("relevant_prediction", X.prediction_for_race_type("race_type"))
    scored = scored.withColumn("prediction_error",
                               F.col("relevant_prediction") - F.col("official_time_min"))
    scored = scored.withColumn("error_category", X.error_sign("prediction_error"))
    return scored.select(
        "athlete_id", "race_date", "label", "race_type", "official_time_min", "prediction_date",
        "prediction_date_matched", *[F.col(f"`{p}`") for p in predictions], "relevant_prediction",
        "prediction_error", "error_category", *rolling)


def error_by_race_type(evaluated: DataFrame) -> DataFrame:
    return stats.spread(evaluated, ["race_type"], "prediction_error")


def error_boxes(evaluated: DataFrame) -> DataFrame:
    return stats.box_statistics(evaluated, ["race_type"], "prediction_error")


def predicted_vs_official(evaluated: DataFrame) -> DataFrame:
    """Races with a prediction, for the scatter; its diagonal is `diagonal`."""
    return clean.not_null(evaluated, ["relevant_prediction"]).select(
        "athlete_id", "label", "race_date", "race_type", "official_time_min",
        "relevant_prediction")


def diagonal(evaluated: DataFrame) -> DataFrame:
    return stats.common_range(evaluated, "official_time_min", "relevant_prediction",
                              ["athlete_id"])


def prediction_series(days: DataFrame) -> DataFrame:
    """The four predictions as one long table (athlete, date, distance, minutes)."""
    return days.unpivot(["athlete_id", "date"], [F.col(f"`{p}`") for p in K.PREDICTION_COLUMNS],
                        "distance", "minutes").dropna(subset=["minutes"])


def event_markers(events: DataFrame) -> DataFrame:
    kinds = ["race", "training_block_start"]
    return events.where(F.col("event_type").isin(kinds)).select(
        "athlete_id", "date", "event_type", "label")


# --- personal bests -------------------------------------------------------------------

def personal_best_table(events: DataFrame, runs: DataFrame, unit: str = "mi",
                        no_match: str = K.NO_MATCH) -> DataFrame:
    """Every timed race with labels, pace and the same-day run nearest to its time."""
    races = clean.of_type(events, "race").where(F.col("official_time_min").isNotNull())
    miles = X.standard_distance_miles("race_type")
    labelled = races.select(
        "athlete_id", F.col("date").alias("event_date"), "label", "race_type", "official_time_min",
        X.upper_label("race_type").alias("race_type_label"),
        miles.alias("distance_miles_standard"), X.in_unit(miles, unit).alias("distance_value"),
        X.distance_label(miles, unit).alias("distance_display"),
        X.minutes_label("official_time_min").alias("official_time_label"))
    pace = F.col("official_time_min") / F.col("distance_value")
    labelled = labelled.withColumns({"pace_minutes": pace, "pace_label": X.minutes_label(pace)})
    same_day = runs.select(
        "athlete_id", F.col("start_time").cast("date").alias("event_date"), "duration_minutes",
        "activityId", F.col("distance_miles").alias("recorded_distance_miles"),
        F.col("name").alias("matched_run_name"),
        F.col("locationName").alias("matched_location"), F.lit(True).alias("_found"))
    joined = temporal.nearest_match(
        labelled, same_day, ["athlete_id", "event_date"], "official_time_min", "duration_minutes",
        prefer=["recorded_distance_miles", "activityId"],
        payload=["matched_run_name", "matched_location", "recorded_distance_miles", "_found"])
    found = F.col("_found").isNotNull()
    return joined.withColumns({
        "matched_run_name": F.when(found, F.col("matched_run_name")).otherwise(no_match),
        "matched_location": F.when(found, F.col("matched_location")).otherwise(""),
    }).drop("_found")


def best_by_race_type(bests: DataFrame) -> DataFrame:
    """The current best per athlete and race type, always one whole race."""
    return top_row(bests, ["athlete_id", "race_type_label"], F.col("official_time_min"))


def personal_best_headline(bests: DataFrame) -> DataFrame:
    """Race count, categories, fastest pace (with its race) and latest race per athlete."""
    fastest = F.min(F.when(F.col("pace_minutes").isNotNull(),
                           F.struct("pace_minutes", "label", "pace_label")))
    return bests.groupBy("athlete_id").agg(
        F.count(F.lit(1)).alias("race_events"),
        F.countDistinct("race_type_label").alias("categories"),
        fastest.getField("pace_label").alias("fastest_pace_label"),
        fastest.getField("label").alias("fastest_race"),
        X.date_label(F.max("event_date")).alias("most_recent_race"))


# --- training blocks from the calendar ------------------------------------------------

def blocks_from_events(events: DataFrame, include_race_day: bool = False) -> DataFrame:
    """Block dimension from the calendar: a block start and the next race that shares the
    first word of its label. The block ends the day before the race.

    Several starts before one race give one block, from the latest start. A label raced more
    than once gets the race date appended, so that names stay unique per athlete.
    """
    word = X.first_word("label").alias("word")
    starts = clean.of_type(events, "training_block_start").select(
        "athlete_id", word, F.col("date").alias("start_date"))
    races = clean.of_type(events, "race").select("athlete_id", word, "label",
                                                F.col("date").alias("race_day"))
    paired = temporal.asof_join(starts, races, ["athlete_id", "word"], "start_date", "race_day",
                                ["label"], matched="race_date", direction="forward")
    blocks = (paired.where(F.col("race_date").isNotNull())
              .groupBy("athlete_id", "label", "race_date")
              .agg(F.max("start_date").alias("start_date")))
    # The calendar bounds this window: one row per race day of a label.
    repeats = F.count(F.lit(1)).over(Window.partitionBy("athlete_id", "label"))
    end = F.col("race_date") if include_race_day else F.date_sub("race_date", 1)
    return (
        blocks.withColumn("_repeats", repeats)
        .select("athlete_id",
                F.when(F.col("_repeats") > 1, F.concat_ws(" ", "label", "race_date"))
                .otherwise(F.col("label")).alias("block_name"),
                "start_date", end.alias("end_date"),
                F.unix_date("start_date").cast("bigint").alias("priority"), "race_date")
        .where(F.col("start_date") <= F.col("end_date")))
