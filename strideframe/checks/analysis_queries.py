"""Queries over race evaluation, blocks, overview, atlas and the sources and sinks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

from strideframe.checks import export_files
from strideframe.checks.cleaning_queries import METRICS, days, kept_days, master, runs
from strideframe.checks.oracle_tables import (ROLLING, clock, day_label, distance, filled, fixed, signed,
                                              week_end)
from strideframe.checks.registry import register
from strideframe.checks.warehouse import Warehouse
from strideframe.functions import columns as X
from strideframe.operators import clean, rolling, stats
from strideframe.plans import atlas, blocks as B, overview as O, races as R
from strideframe.sources import readers, writers


def evaluated(w: Warehouse) -> DataFrame:
    return R.evaluate_races(w.calendar(), days(w))


def series(w: Warehouse, fill: bool = False) -> DataFrame:
    return B.block_series(days(w), w.blocks(), fill)


def kept_series(w: Warehouse) -> DataFrame:
    """Block series over the kept daily series, for queries that read it more than once."""
    return B.block_series(kept_days(w), w.blocks())


def summary(w: Warehouse) -> DataFrame:
    races = R.evaluate_races(w.calendar(), kept_days(w))
    return B.block_summary(kept_series(w), w.blocks(), races)


def raced_blocks(w: Warehouse) -> DataFrame:
    """The blocks with their races alone, for plans that need no figures of the series."""
    return B.block_races(w.blocks(), R.evaluate_races(w.calendar(), kept_days(w)))


def bests(w: Warehouse) -> DataFrame:
    return R.personal_best_table(w.calendar(), runs(w))


def atlas_rows(w: Warehouse) -> DataFrame:
    return atlas.map_rows(runs(w), w.blocks())


PRED = '"5K_pred" "10K_pred" "Half_pred" "Marathon_pred"'
PRED_ROUND = PRED.replace('"', "")
SUMMARY = ("actual_time final_prediction prediction_error mean_volatility max_volatility "
           "peak_weekly_mileage avg_weekly_mileage last_14_day_avg_prediction prediction_drift "
           "avg_training_load avg_readiness vo2_drift avg_hrv")

# --- races ----------------------------------------------------------------------------

register("q25_race_evaluation", evaluated,
         "SELECT athlete_id, race_date, label, race_type, official_time_min, prediction_date, "
         f"prediction_date_matched, {PRED.replace(' ', ', ')}, relevant_prediction, prediction_error, "
         "error_category, " + ", ".join(f'"{c}"' for c in ROLLING) + " FROM race_eval",
         f"official_time_min {PRED_ROUND} relevant_prediction prediction_error " + " ".join(ROLLING))
register("q28_a31_prediction_vs_official", lambda w: R.predicted_vs_official(evaluated(w)),
         "SELECT athlete_id, label, race_date, race_type, official_time_min, relevant_prediction FROM race_eval "
         "WHERE relevant_prediction IS NOT NULL", "official_time_min relevant_prediction")
register("q28_diagonal", lambda w: R.diagonal(evaluated(w)),
         "SELECT athlete_id, least(min(official_time_min), min(relevant_prediction)) AS range_min, "
         "greatest(max(official_time_min), max(relevant_prediction)) AS range_max FROM race_eval GROUP BY 1",
         "range_min range_max")
register("q29_prediction_series", lambda w: R.prediction_series(days(w)),
         "SELECT athlete_id, date, distance, minutes FROM (" + " UNION ALL ".join(
             f"SELECT athlete_id, date, '{p}_pred' AS distance, \"{p}_pred\" AS minutes FROM days"
             for p in ("5K", "10K", "Half", "Marathon")) + ") WHERE minutes IS NOT NULL", "minutes")
register("q29_event_markers", lambda w: R.event_markers(w.calendar()),
         "SELECT athlete_id, date, event_type, label FROM cal WHERE event_type IN ('race', 'training_block_start')")
register("q03_j08_personal_bests", bests, "SELECT * FROM pb",
         "official_time_min distance_miles_standard distance_value pace_minutes recorded_distance_miles")
register("q04_w10_best_by_race_type",
         lambda w: R.best_by_race_type(bests(w)).select("athlete_id", "race_type_label", "official_time_min"),
         "SELECT athlete_id, race_type_label, min(official_time_min) AS official_time_min FROM pb GROUP BY 1, 2",
         "official_time_min")
register("q04_personal_best_headline", lambda w: R.personal_best_headline(bests(w)),
         "SELECT athlete_id, count(*) AS race_events, count(DISTINCT race_type_label) AS categories, "
         "(SELECT q.pace_label FROM pb AS q WHERE q.athlete_id = p.athlete_id AND q.pace_minutes IS NOT NULL "
         "ORDER BY q.pace_minutes, q.label LIMIT 1) AS fastest_pace_label, "
         "(SELECT q.label FROM pb AS q WHERE q.athlete_id = p.athlete_id AND q.pace_minutes IS NOT NULL "
         f"ORDER BY q.pace_minutes, q.label LIMIT 1) AS fastest_race, {day_label('max(event_date)')} AS most_recent_race "
         "FROM pb AS p GROUP BY athlete_id")
register("f08_blocks_from_events", lambda w: R.blocks_from_events(w.calendar()),
         "WITH s AS (SELECT athlete_id, date AS start_date, split_part(label, ' ', 1) AS word FROM cal "
         "WHERE event_type = 'training_block_start'), r AS (SELECT athlete_id, race_date, label, "
         "split_part(label, ' ', 1) AS word FROM races), p AS (SELECT s.athlete_id, s.start_date, min(r.race_date) AS race_date, "
         "s.word FROM s JOIN r ON s.athlete_id = r.athlete_id AND s.word = r.word AND r.race_date >= s.start_date GROUP BY ALL), "
         "b AS (SELECT athlete_id, word || ' Marathon' AS label, race_date, max(start_date) AS start_date FROM p GROUP BY ALL), "
         "c AS (SELECT *, count(*) OVER (PARTITION BY athlete_id, label) AS n FROM b) "
         "SELECT athlete_id, CASE WHEN n > 1 THEN label || ' ' || CAST(race_date AS VARCHAR) ELSE label END AS block_name, "
         "start_date, CAST(race_date - 1 AS DATE) AS end_date, date_diff('day', DATE '1970-01-01', start_date) AS priority, race_date "
         "FROM c WHERE start_date <= race_date - 1")

# --- blocks ---------------------------------------------------------------------------

register("q26_block_summary", summary, "SELECT * FROM summary", SUMMARY)
register("a25_block_ranges", lambda w: B.block_ranges(series(w)), "SELECT * FROM ranges")
register("j10_summary_of_one_block", lambda w: B.summary_row(summary(w), "Birch Marathon"),
         "SELECT * FROM summary WHERE block_name = 'Birch Marathon'", SUMMARY)
register("u02_w07_block_series",
         lambda w: series(w).select("athlete_id", "block_name", "date", "days_from_start", "total_distance_miles"),
         "SELECT athlete_id, block_name, date, days_from_start, total_distance_miles FROM series", "total_distance_miles")
FILL = ("(SELECT athlete_id, block_name, date, days_from_start, last_value(vo2MaxValue IGNORE NULLS) OVER b AS vo2MaxValue, "
        "last_value(\"Marathon_pred\" IGNORE NULLS) OVER b AS \"Marathon_pred\" FROM series WINDOW b AS "
        "(PARTITION BY athlete_id, block_name ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))")
register("w03_filled_block_series",
         lambda w: series(w, True).select("athlete_id", "block_name", "date", "days_from_start", "vo2MaxValue", "Marathon_pred"),
         f"SELECT * FROM {FILL}", "vo2MaxValue Marathon_pred")
register("q05_w09_prediction_curve", lambda w: B.prediction_curve(kept_series(w), summary(w)),
         'SELECT s.athlete_id, s.block_name, s.date, s."Marathon_pred", m.final_prediction, m.final_prediction - 2 AS band_lower, '
         'm.final_prediction + 2 AS band_upper, m.stable_date FROM series AS s JOIN summary AS m USING (athlete_id, block_name) '
         'WHERE s."Marathon_pred" IS NOT NULL', "Marathon_pred final_prediction band_lower band_upper")
register("q06_accuracy_vs_stability", lambda w: B.accuracy_vs_stability(summary(w), "km"),
         "SELECT athlete_id, block_name, days_stable_before_race, abs(prediction_error) AS absolute_error, "
         "peak_weekly_mileage * 1.609344 AS peak_weekly_distance, prediction_bias FROM summary",
         "absolute_error peak_weekly_distance")
register("q07_volatility_by_block", lambda w: B.volatility_by_block(summary(w)),
         "SELECT athlete_id, block_name, mean_volatility, max_volatility, prediction_bias, days_stable_before_race, "
         "prediction_error FROM summary", "mean_volatility max_volatility prediction_error")
register("q08_stabilisation_points", lambda w: B.stabilisation_points(summary(w)),
         "SELECT athlete_id, block_name, 'stable' AS point, stable_date AS date FROM summary UNION ALL "
         "SELECT athlete_id, block_name, 'race', race_date FROM summary")
register("q09_error_and_drift", lambda w: B.error_and_drift(summary(w)),
         "SELECT athlete_id, block_name, race_date, prediction_error, prediction_drift, prediction_bias, actual_time, "
         "final_prediction, days_stable_before_race FROM summary",
         "prediction_error prediction_drift actual_time final_prediction")
register("q10_volatility_timeline", lambda w: B.volatility_timeline(series(w), 7),
         'SELECT athlete_id, block_name, date, days_from_start, "rolling_std_7_Marathond" FROM series '
         'WHERE "rolling_std_7_Marathond" IS NOT NULL', "rolling_std_7_Marathond")
register("q11_aligned_predictions", lambda w: B.aligned_predictions(series(w)),
         'SELECT athlete_id, block_name, date, days_from_start, "Marathon_pred" FROM series WHERE "Marathon_pred" IS NOT NULL',
         "Marathon_pred")


def _relationship(name: str, x: str, sql_x: str, unit: str = "mi") -> None:
    register(f"q12_volatility_vs_{name}", lambda w: B.volatility_relationship(series(w), x, unit),
             f'SELECT athlete_id, block_name, date, {sql_x} AS x, "rolling_std_15_Marathond" AS volatility, "Marathon_pred" '
             f'FROM series WHERE {sql_x} IS NOT NULL AND "rolling_std_15_Marathond" IS NOT NULL', "x volatility Marathon_pred")


_relationship("load", "dailyTrainingLoadAcute", "dailyTrainingLoadAcute")
_relationship("acwr", "dailyAcuteChronicWorkloadRatio", "dailyAcuteChronicWorkloadRatio")
_relationship("readiness", "readiness_score_mean", "readiness_score_mean")
_relationship("distance", "total_distance_miles", "total_distance_miles * 1.609344", "km")

BLOCK_WEEKS = filled("series", "athlete_id, block_name", week_end("date"), "total_distance_miles")
register("q13_block_weekly_distance", lambda w: B.weekly_distance(series(w), "km"),
         f"SELECT athlete_id, block_name, p AS week_end, v * 1.609344 AS distance FROM ({BLOCK_WEEKS})", "distance")
register("q14_block_daily_distance", lambda w: B.daily_distance(series(w)),
         "SELECT athlete_id, block_name, date, total_distance_miles AS distance, avg(total_distance_miles) OVER "
         "(PARTITION BY athlete_id, block_name ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS average_7 FROM series",
         "distance average_7")
LOADS = "dailyTrainingLoadAcute dailyTrainingLoadChronic dailyAcuteChronicWorkloadRatio"
register("q15_load_series", lambda w: B.load_series(series(w)),
         f"SELECT athlete_id, block_name, date, {LOADS.replace(' ', ', ')} FROM series", LOADS)
register("q15_readiness_series", lambda w: B.readiness_series(series(w)),
         "SELECT athlete_id, block_name, date, readiness_score_mean, sleep_score_last, recovery_time_last / 60 AS recovery_hours FROM series",
         "readiness_score_mean sleep_score_last recovery_hours")
register("q15_physiology_series", lambda w: B.physiology_series(series(w)),
         "SELECT athlete_id, block_name, date, vo2MaxValue, hrv_weekly_avg_clean, avg_hr FROM series",
         "vo2MaxValue hrv_weekly_avg_clean avg_hr")
for _column in ("training_status", "acwrStatus"):
    register(f"q16_status_{_column.lower()}",
             lambda w, column=_column: B.status_distribution(series(w), column),
             f"SELECT athlete_id, block_name, {_column}, count(*) AS days FROM series WHERE {_column} IS NOT NULL GROUP BY ALL")
register("a19_a20_block_means",
         lambda w: series(w).groupBy("athlete_id", "block_name").agg(
             F.avg("rolling_std_7_Marathond").alias("mean_volatility"), F.max("rolling_std_7_Marathond").alias("max_volatility"),
             F.avg("total_training_load").alias("load"), F.avg("readiness_score_mean").alias("readiness"),
             F.avg("hrv_weekly_avg_clean").alias("hrv")),
         'SELECT athlete_id, block_name, avg("rolling_std_7_Marathond") AS mean_volatility, max("rolling_std_7_Marathond") AS max_volatility, '
         "avg(total_training_load) AS load, avg(readiness_score_mean) AS readiness, avg(hrv_weekly_avg_clean) AS hrv FROM series GROUP BY ALL",
         "mean_volatility max_volatility load readiness hrv")
register("a26_block_correlation",
         lambda w: stats.correlation(series(w), ["block_name"], "rolling_std_7_Marathond", "total_training_load"),
         'SELECT block_name, corr("rolling_std_7_Marathond", total_training_load) AS corr FROM series GROUP BY 1', "corr")
register("a27_block_fit",
         lambda w: stats.linear_fit(B.loaded_days(series(w)), ["block_name"], "rolling_std_7_Marathond", "total_training_load"),
         'SELECT block_name, regr_slope(total_training_load, "rolling_std_7_Marathond") AS slope, '
         'regr_intercept(total_training_load, "rolling_std_7_Marathond") AS intercept, '
         'regr_r2(total_training_load, "rolling_std_7_Marathond") AS r2, count(*) AS n FROM series '
         'WHERE total_training_load > 0 AND "rolling_std_7_Marathond" IS NOT NULL GROUP BY 1', "slope intercept r2")
register("q24_block_headline", lambda w: B.block_headline(summary(w)),
         f"SELECT athlete_id, block_name, {clock('actual_time')} AS official_time, {clock('final_prediction')} AS final_prediction_label, "
         f"{signed('prediction_error')} || ' min' AS error_label, upper(prediction_bias[1]) || prediction_bias[2:] AS bias_label, "
         "coalesce(CAST(days_stable_before_race AS VARCHAR) || ' days', 'N/A') AS stable_label, "
         f"{day_label('stable_date')} AS stable_date_label, {distance('peak_weekly_mileage')} AS peak_week_label, "
         f"{distance('avg_weekly_mileage')} AS avg_week_label, {fixed('avg_training_load', 0)} AS load_label, "
         f"{fixed('avg_readiness')} AS readiness_label, {fixed('avg_hrv')} AS hrv_label FROM summary")


def _or_missing(text: str) -> str:
    return f"coalesce({text}, 'N/A')"


register("x22_race_reports", lambda w: B.race_reports(summary(w)),
         f"SELECT athlete_id, block_name, concat_ws(' | ', 'Volume: ' || {distance('avg_weekly_mileage')} || ' a week, ' || "
         f"{distance('peak_weekly_mileage')} || ' at most', 'Readiness: ' || {_or_missing(fixed('avg_readiness'))}, "
         f"'HRV: ' || {_or_missing(fixed('avg_hrv'))}, 'VO2 change: ' || {_or_missing(signed('vo2_drift'))}, "
         f"'Forecast of the watch: ' || CASE prediction_bias WHEN 'conservative' THEN {fixed('abs(prediction_error)')} || ' min too slow' "
         f"WHEN 'optimistic' THEN {fixed('abs(prediction_error)')} || ' min too fast' ELSE 'on target' END, "
         f"'Days settled: ' || {_or_missing('CAST(days_stable_before_race AS VARCHAR)')}) AS report FROM summary")

# --- overview -------------------------------------------------------------------------

MONTHS = filled("runs", "athlete_id", "last_day(date)", "distance_miles", "1 MONTH")
register("q01_monthly_volume", lambda w: O.monthly_volume(runs(w), "km"),
         f"SELECT athlete_id, p AS month_end, v AS distance_miles, v * 1.609344 AS distance FROM ({MONTHS})",
         "distance_miles distance")
WEEKS = filled("days", "athlete_id", week_end("date"), "total_distance_miles")
register("q02_timeline", lambda w: O.timeline(kept_days(w), raced_blocks(w)),
         f"SELECT athlete_id, 'weekly_distance' AS series, p AS date, v AS value, NULL AS label FROM ({WEEKS}) UNION ALL "
         "SELECT athlete_id, 'vo2_max', date, vo2MaxValue, NULL FROM days UNION ALL "
         'SELECT athlete_id, \'marathon_prediction\', date, "Marathon_pred", NULL FROM days WHERE "Marathon_pred" IS NOT NULL UNION ALL '
         "SELECT athlete_id, 'race', race_date, NULL, replace(block_name, ' Marathon', '') FROM summary WHERE race_date IS NOT NULL", "value")
register("q17_a22_overview_totals", lambda w: O.overview_totals(runs(w), summary(w)),
         "SELECT r.*, s.* EXCLUDE (athlete_id) FROM (SELECT athlete_id, count(*) AS total_runs, sum(distance_miles) AS total_miles, "
         "min(date) AS first_run, max(date) AS latest_run FROM runs GROUP BY 1) AS r LEFT JOIN (SELECT athlete_id, "
         "count(DISTINCT block_name) AS blocks, avg(abs(prediction_error)) AS mean_abs_error, max(peak_weekly_mileage) AS peak_weekly "
         "FROM summary GROUP BY 1) AS s USING (athlete_id)", "total_miles mean_abs_error peak_weekly")
register("q17_block_snapshot", lambda w: O.block_snapshot(summary(w)),
         f"SELECT athlete_id, replace(block_name, ' Marathon', '') AS block, race_date, {clock('actual_time')} AS time_label, "
         f"{signed('prediction_error')} || ' min' AS error_label FROM summary")
register("q23_race_markers", lambda w: O.race_markers(raced_blocks(w)),
         f"SELECT athlete_id, replace(block_name, ' Marathon', '') AS block, race_date, {day_label('race_date')} AS date_label, "
         f"{clock('actual_time')} AS time_label FROM summary")


def _picks_sql(picks: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(
        f"(SELECT athlete_id, '{name}' AS finding, block_name, CAST({measure} AS DOUBLE) AS value FROM summary "
        f"WHERE {measure} IS NOT NULL QUALIFY row_number() OVER (PARTITION BY athlete_id ORDER BY {measure} {way}, block_name) = 1)"
        for name, (measure, way) in picks.items())


register("q18_k03_key_findings", lambda w: O.key_findings(summary(w)),
         _picks_sql({"closest_prediction": ("abs(prediction_error)", ""), "biggest_miss": ("abs(prediction_error)", "DESC"),
                     "earliest_stability": ("days_stable_before_race", "DESC"),
                     "highest_peak": ("peak_weekly_mileage", "DESC"), "best_marathon": ("actual_time", "")}), "value")
register("q19_dynamics_headline", lambda w: O.dynamics_headline(summary(w)),
         _picks_sql({"lowest_volatility": ("mean_volatility", ""), "highest_volatility": ("mean_volatility", "DESC"),
                     "earliest_stability": ("days_stable_before_race", "DESC"),
                     "closest_prediction": ("abs(prediction_error)", "")}), "value")
register("q30_maxmet_vs_vo2", lambda w: O.pairs(w.family("maxmet"), "maxMet", "vo2MaxValue", "athlete_id"),
         "SELECT athlete_id, maxMet, vo2MaxValue FROM raw_maxmet WHERE vo2MaxValue IS NOT NULL", "maxMet vo2MaxValue")
register("q30_vo2_over_time", lambda w: O.pairs(runs(w), "date", "vO2MaxValue", "athlete_id"),
         "SELECT athlete_id, date, vO2MaxValue FROM runs", "vO2MaxValue")
register("k04_longest_run", lambda w: O.longest_run(runs(w)).select("athlete_id", "activityId", "distance_miles"),
         "SELECT athlete_id, activityId, distance_miles FROM runs QUALIFY distance_miles = max(distance_miles) OVER (PARTITION BY athlete_id)",
         "distance_miles")

# --- atlas ----------------------------------------------------------------------------

ATLAS = "distance_miles distance_display radius_m startLatitude startLongitude endLatitude endLongitude"
register("q20_atlas_rows", atlas_rows, "SELECT * FROM atlas", ATLAS)
register("q20_f11_atlas_filter",
         lambda w: atlas.filter_rows(atlas_rows(w), [2024], ["Alder Marathon", "Outside marathon blocks"], ["running"], (3.0, 8.0))
         .select("activityId", "marathon_block", "distance_display"),
         "SELECT activityId, marathon_block, distance_display FROM atlas WHERE year IN (2024) AND marathon_block IN "
         "('Alder Marathon', 'Outside marathon blocks') AND activityType IN ('running') AND distance_display BETWEEN 3 AND 8",
         "distance_display")
SPANS = ("max(startLatitude) - min(startLatitude) AS lat, max(startLongitude) - min(startLongitude) AS lon, "
         "avg(startLatitude) AS clat, avg(startLongitude) AS clon")
for _name, _keys in (("per_athlete", ["athlete_id"]), ("per_block", ["marathon_block"])):
    register(f"q21_a33_atlas_headline_{_name}", lambda w, keys=_keys: atlas.headline(atlas_rows(w), keys),
             f"SELECT {_keys[0]}, n AS mapped_runs, total AS mapped_distance, longest AS longest_run, CASE WHEN sqrt(lat * lat + lon * lon) > 20 "
             "THEN 'Global footprint' WHEN sqrt(lat * lat + lon * lon) > 2 THEN 'Regional footprint' ELSE 'Local footprint' END AS footprint "
             f"FROM (SELECT {_keys[0]}, count(*) AS n, sum(distance_display) AS total, max(distance_display) AS longest, {SPANS} FROM atlas GROUP BY 1)",
             "mapped_distance longest_run")
    register(f"a32_atlas_view_{_name}", lambda w, keys=_keys: atlas.view_state(atlas_rows(w), keys),
             f"SELECT {_keys[0]}, clat AS latitude, clon AS longitude, CASE WHEN greatest(lat, lon) > 25 THEN 2e0 WHEN greatest(lat, lon) > 8 "
             "THEN 4e0 WHEN greatest(lat, lon) > 1 THEN 7e0 ELSE 10e0 END AS zoom FROM "
             f"(SELECT {_keys[0]}, {SPANS} FROM atlas GROUP BY 1)", "latitude longitude zoom")
register("q22_route_chords", lambda w: atlas.route_chords(atlas_rows(w)).select("activityId", "startLatitude", "endLatitude"),
         "SELECT activityId, startLatitude, endLatitude FROM atlas WHERE has_route_chord", "startLatitude endLatitude")
register("q22_end_points", lambda w: atlas.end_points(atlas_rows(w)).select("activityId", "endLatitude", "endLongitude"),
         "SELECT activityId, endLatitude, endLongitude FROM atlas WHERE endLatitude IS NOT NULL AND endLongitude IS NOT NULL",
         "endLatitude endLongitude")

# --- sources and sinks ----------------------------------------------------------------


def scratch(w: Warehouse) -> str:
    """A new folder: below the shared one the cluster names, or local where none is set."""
    shared = w.spark.conf.get("spark.checkpoint.dir", "")
    return f"{shared.rstrip('/')}/{uuid.uuid4().hex}" if shared else tempfile.mkdtemp(prefix="strideframe-")


register("s14_table_scan",
         lambda w: readers.read_table(w.spark, f"{w.sf_dir}/orders.parquet", ["o_orderkey", "o_totalprice"]),
         "SELECT o_orderkey, o_totalprice FROM orders", "o_totalprice")


def _calendar_csv(w: Warehouse) -> DataFrame:
    path = f"{scratch(w)}/calendar"
    w.calendar().select("athlete_id", F.date_format("date", "M/d/yy").alias("date"), "event_type", "label",
                        "official_time_min", "race_type").write.option("header", True).csv(path)
    return readers.read_events(w.spark, f"{path}-absent", fallback=path)


register("s15_calendar_csv", _calendar_csv, "SELECT * FROM cal", "official_time_min")


def _table_round_trip(w: Warehouse) -> DataFrame:
    path = writers.write_table(clean.dedup_dates(w.family("metrics"), "first"), f"{scratch(w)}/metrics")
    return readers.read_table(w.spark, path).drop("calendarDate")


register("s16_s17_table_round_trip", _table_round_trip, "SELECT * EXCLUDE (ts) FROM metrics1", METRICS)


def _manifest(w: Warehouse) -> DataFrame:
    tables = {"metrics": w.family("metrics"), "maxmet": w.family("maxmet"), "history": None,
              "races": w.calendar().where("event_type = 'race'")}
    return writers.save_tables(tables, scratch(w)).select(
        "athlete_id", "dataset", "saved", "reason", "rows", "first_date", "last_date")


_PART = ("SELECT athlete_id, '{n}' AS dataset, count(*) AS rows, min(date) AS first_date, max(date) AS last_date "
         "FROM {t} {w} GROUP BY 1")
register("s19_s20_manifest", _manifest,
         "SELECT a.athlete_id, d.dataset, coalesce(c.rows > 0, false) AS saved, CASE WHEN d.dataset = 'history' THEN 'DataFrame is None' "
         "WHEN c.rows IS NULL THEN 'DataFrame is empty' END AS reason, c.rows, c.first_date, c.last_date FROM (SELECT DISTINCT athlete_id "
         "FROM ev) AS a CROSS JOIN (VALUES ('metrics'), ('maxmet'), ('history'), ('races')) AS d(dataset) LEFT JOIN ("
         + " UNION ALL ".join([_PART.format(n="metrics", t="raw_metrics", w=""), _PART.format(n="maxmet", t="raw_maxmet", w=""),
                               _PART.format(n="races", t="cal", w="WHERE event_type = 'race'")])
         + ") AS c ON a.athlete_id = c.athlete_id AND d.dataset = c.dataset")


def _block_table(w: Warehouse) -> DataFrame:
    path = writers.write_blocks(series(w).select("athlete_id", "block_name", "date", "Marathon_pred"), f"{scratch(w)}/blocks")
    return readers.read_table(w.spark, path)


register("s21_block_table", _block_table, 'SELECT athlete_id, block_name, date, "Marathon_pred" FROM series', "Marathon_pred")


def _exported(family: str):
    def build(w: Warehouse) -> DataFrame:
        root = export_files.write_export(w, f"{scratch(w)}/export", [family])
        if family == "activities":
            return clean.runs_table(readers.read_activities(w.spark, root)[0]).select(
                "athlete_id", "activityId", "date", "distance_miles", "avg_pace_mile", "pr")
        rows = readers.read_daily(w.spark, root, family)[0]
        return rows.drop("source_file", "calendarDate", "timestampLocal", "timestamp")
    return build


register("s05_s06_s13_activities_source", _exported("activities"),
         "SELECT athlete_id, activityId, date, distance_miles, avg_pace_mile, pr FROM runs", "distance_miles")
for _number, _family, _doubles in (
        ("08", "metrics", METRICS), ("09", "predictions", "raceTime5K raceTime10K raceTimeHalf raceTimeMarathon"),
        ("10", "readiness", "score recoveryTime acuteLoad hrvWeeklyAverage sleepScore"),
        ("11", "maxmet", "vo2MaxValue fitnessAge maxMet"),
        ("12", "history", "loadTunnelMin loadTunnelMax weeklyTrainingLoadSum")):
    register(f"s{_number}_{_family}_source", _exported(_family),
             f"SELECT * EXCLUDE (source_file, ts) FROM raw_{_family}", _doubles)


def _listed(w: Warehouse) -> DataFrame:
    root = export_files.write_export(w, f"{scratch(w)}/export", ["metrics", "maxmet"])
    return readers.list_files(w.spark, root).groupBy("family").agg(F.countDistinct("athlete_id").alias("athletes"))


register("s01_s02_s03_file_families", _listed,
         "SELECT 'metrics' AS family, count(DISTINCT athlete_id) AS athletes FROM raw_metrics UNION ALL "
         "SELECT 'maxmet', count(DISTINCT athlete_id) FROM raw_maxmet")


def _one_athlete(w: Warehouse) -> DataFrame:
    root = export_files.write_export(w, f"{scratch(w)}/export", ["maxmet"])
    rows, _ = readers.read_daily(w.spark, root, "maxmet", athlete_ids=["7", "11"])
    return rows.groupBy("athlete_id").agg(F.count(F.lit(1)).alias("rows"))


register("s04_listed_athletes", _one_athlete,
         "SELECT athlete_id, count(*) AS rows FROM raw_maxmet WHERE athlete_id IN ('7', '11') GROUP BY 1")


def _bundle(w: Warehouse) -> DataFrame:
    base = scratch(w)
    writers.write_table(master(w), f"{base}/daily_master")
    readers.load_bundle(w.spark, base, ["daily_master"])
    return w.spark.sql("SELECT athlete_id, count(*) AS days, sum(run_count) AS runs FROM daily_master GROUP BY athlete_id")


register("s22_bundle_views", _bundle,
         "SELECT athlete_id, count(*) AS days, CAST(sum(run_count) AS BIGINT) AS runs FROM master GROUP BY 1")
