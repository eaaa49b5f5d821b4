"""Queries over filters, projections, deduplication, daily joins and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.checks.oracle_tables import (clock, day_label, distance, fixed, first_by, grouped,
                                              hms, pace, signed)
from strideframe.checks.registry import register
from strideframe.checks.warehouse import Warehouse
from strideframe.functions import columns as X, constants as K
from strideframe.operators import clean, daily, temporal
from strideframe.plans import athlete_tables
from strideframe.sources import readers


def runs(w: Warehouse):
    return clean.runs_table(w.family("activities"))


def master(w: Warehouse):
    return daily.daily_master(runs(w), **{n: w.family(n) for n in (
        "metrics", "predictions", "maxmet", "readiness", "history")})


def days(w: Warehouse):
    return athlete_tables.analysis_series(master(w))


def kept_days(w: Warehouse):
    """The daily series, cached: one row per athlete and day, read by several branches of one
    query. A lost executor's part is computed again from its lineage. Equal plans share one
    cache entry, so repeated calls do not add copies."""
    return w.once("daily series", lambda: days(w).cache())


SCALED = ("duration_minutes distance_km distance_miles elevation_gain_m elevation_loss_m "
          "max_speed_mps avg_speed_mps avg_stride_length_m elapsed_duration_minutes "
          "moving_duration_minutes")
RUN_TOTALS = ("total_distance_km total_distance_miles total_duration_minutes total_moving_minutes "
              "total_elevation_gain_m avg_hr max_hr avg_pace_mile avg_stride_length_m "
              "total_training_load aerobic_te_avg anaerobic_te_avg avg_power max_power avg_cadence")
METRICS = "acwrPercent dailyTrainingLoadAcute dailyTrainingLoadChronic dailyAcuteChronicWorkloadRatio"
READINESS = ("readiness_score_first readiness_score_last readiness_score_mean recovery_time_last "
             "acute_load_last hrv_weekly_avg_last sleep_score_last")
MASTER = f"{RUN_TOTALS} {METRICS} vo2MaxValue fitnessAge maxMet {READINESS} load_tunnel_min load_tunnel_max"

# --- filters and projections ----------------------------------------------------------

register("f01_running_activities",
         lambda w: clean.running_activities(w.family("activities")).select(
             "athlete_id", "activityId", "activityType"),
         "SELECT athlete_id, activityId, activityType FROM raw_activities WHERE activityType = 'running'")

register("f02_x03_x05_unit_scaled_runs",
         lambda w: runs(w).select("activityId", "date", *SCALED.split(), "max_pace_mile",
                                  "max_pace_km", "avg_pace_mile", "avg_pace_km"),
         f"SELECT activityId, date, {SCALED.replace(' ', ', ')}, max_pace_mile, max_pace_km, "
         "avg_pace_mile, avg_pace_km FROM runs", SCALED)

ZONES = [f"hrTimeInZone_{i}" for i in range(1, 7)] + [f"powerTimeInZone_{i}" for i in range(1, 6)]
register("f03_zone_minutes",
         lambda w: runs(w).select("activityId", *[f"{z}_minutes" for z in ZONES]),
         "SELECT activityId, " + ", ".join(f"{z} / 1000 / 60 AS {z}_minutes" for z in ZONES) + " FROM runs",
         " ".join(f"{z}_minutes" for z in ZONES))

register("f04_f05_dropped_columns",
         lambda w: clean.drop_columns(athlete_tables.without_identifiers(w.family("history")),
                                      [*K.DROPPED_ACTIVITY_COLUMNS, "calendarDate"]),
         "SELECT * EXCLUDE (userProfilePK, deviceId, ts) FROM raw_history",
         "loadTunnelMin loadTunnelMax weeklyTrainingLoadSum")

register("f06_select_existing",
         lambda w: clean.select_existing(w.table("orders"), ["o_orderkey", "absent", "o_totalprice"]),
         "SELECT o_orderkey, o_totalprice FROM orders", "o_totalprice")

register("f07_drop_missing",
         lambda w: clean.not_null(runs(w), ["startLatitude", "startLongitude", "avgHr"]).select("activityId"),
         "SELECT activityId FROM runs WHERE startLatitude IS NOT NULL AND startLongitude IS NOT NULL "
         "AND avgHr IS NOT NULL")

register("f08_events_of_type",
         lambda w: clean.of_type(w.calendar(), "training_block_start"),
         "SELECT * FROM cal WHERE event_type = 'training_block_start'", "official_time_min")

register("f09_since_date",
         lambda w: clean.since(runs(w), "2024-01-15").where(X.year_of("start_time") >= 2023)
         .select("activityId", "date"),
         "SELECT activityId, date FROM runs WHERE date >= DATE '2024-01-15' AND year(date) >= 2023")

register("f10_f15_block_slice",
         lambda w: temporal.slice_blocks(daily.daily_runs(runs(w)), w.blocks()).select(
             "athlete_id", "date", "block_name", "total_distance_miles"),
         "SELECT d.athlete_id, d.date, b.block_name, d.total_distance_miles FROM daily_runs AS d "
         "JOIN blocks AS b ON d.athlete_id = b.athlete_id AND d.date BETWEEN b.start_date AND b.end_date",
         "total_distance_miles")

register("f12_label_contains_word",
         lambda w: temporal.label_contains(
             w.blocks().select("athlete_id", X.first_word("block_name").alias("word")),
             w.calendar(), ["athlete_id"], "word", "label")
         .select("athlete_id", F.col("_word").alias("word"), F.col("_label").alias("label")),
         "SELECT DISTINCT b.athlete_id, lower(split_part(b.block_name, ' ', 1)) AS word, c.label "
         "FROM blocks AS b JOIN cal AS c ON b.athlete_id = c.athlete_id "
         "AND contains(lower(c.label), lower(split_part(b.block_name, ' ', 1)))")

register("f13_positive_load",
         lambda w: daily.daily_runs(runs(w)).where(F.col("total_training_load") > 0)
         .select("athlete_id", "date", "total_training_load"),
         "SELECT athlete_id, date, total_training_load FROM daily_runs WHERE total_training_load > 0",
         "total_training_load")

register("f16_hrv_sentinel",
         lambda w: w.family("readiness").groupBy("athlete_id").agg(
             F.avg("hrvWeeklyAverage").alias("raw_mean"),
             F.avg(X.null_if("hrvWeeklyAverage", 511.0)).alias("clean_mean")),
         "SELECT athlete_id, avg(hrvWeeklyAverage) AS raw_mean, "
         "avg(nullif(hrvWeeklyAverage, 511)) AS clean_mean FROM raw_readiness GROUP BY athlete_id",
         "raw_mean clean_mean")

register("f17_x02_defaults",
         lambda w: w.family("activities").select(
             "activityId", F.struct("name", "locationName").alias("place")).select(
             "activityId", X.nested_get("place.locationName", "Unknown").alias("location"),
             X.nested_get("place.name", "Run").alias("name")),
         "SELECT activityId, coalesce(locationName, 'Unknown') AS location, coalesce(name, 'Run') AS name "
         "FROM raw_activities")

register("f18_f20_display_units",
         lambda w: runs(w).select("activityId", X.in_unit("distance_miles", "km").alias("km"),
                                  (F.col("duration_minutes") / 60).alias("hours")),
         "SELECT activityId, distance_miles * 1.609344 AS km, duration_minutes / 60 AS hours FROM runs",
         "km hours")

register("p18_nan_to_null",
         lambda w: X.nan_to_null(w.table("events").select("user_id", F.when(
             F.col("event_type") == "error", float("nan")).otherwise(F.col("value")).alias("v")))
         .groupBy("user_id").agg(F.avg("v").alias("mean"), F.count("v").alias("n")),
         "SELECT user_id, avg(value) FILTER (WHERE event_type <> 'error') AS mean, "
         "count(*) FILTER (WHERE event_type <> 'error') AS n FROM events GROUP BY user_id", "mean")

# --- deduplication --------------------------------------------------------------------

register("d01_keep_last_order_per_day",
         lambda w: clean.keep_one(w.table("orders").withColumn("o_orderdate", F.col("o_orderdate").cast("date")),
                                  ["o_custkey", "o_orderdate"], "last", ["o_orderkey"]),
         "SELECT * REPLACE (CAST(o_orderdate AS DATE) AS o_orderdate) FROM orders QUALIFY row_number() OVER "
         "(PARTITION BY o_custkey, CAST(o_orderdate AS DATE) ORDER BY o_orderkey DESC) = 1", "o_totalprice")

register("d02_keep_first_metrics_per_day",
         lambda w: clean.dedup_dates(w.family("metrics"), "first").drop("calendarDate"),
         "SELECT * EXCLUDE (ts) FROM metrics1", METRICS)

register("d03_duplicate_dates",
         lambda w: clean.duplicate_report(w.family("readiness"), "date"),
         "SELECT CAST(sum(n) - count(*) AS BIGINT) AS duplicated_rows, count(*) AS distinct_keys, "
         "arg_max(date, n * 100000 - date_diff('day', DATE '1970-01-01', date)) AS top_key, "
         "max(n) AS top_count FROM (SELECT date, count(*) AS n FROM raw_readiness GROUP BY date)")

# --- daily roll-ups and joins ---------------------------------------------------------

register("a01_a06_daily_runs", lambda w: daily.daily_runs(runs(w)), "SELECT * FROM daily_runs", RUN_TOTALS)

register("a07_a08_daily_readiness", lambda w: daily.daily_readiness(w.family("readiness")),
         "SELECT * FROM readiness1", READINESS)

register("a09_daily_history", lambda w: daily.daily_history(w.family("history")),
         "SELECT * FROM history1", "load_tunnel_min load_tunnel_max")


def _joined(name: str, step, family: str, columns: str, cte: str, rounded: str,
            prepare=lambda df: df) -> None:
    names = columns.split()
    register(
        name,
        lambda w: step(daily.daily_runs(runs(w)), prepare(w.family(family))).select(
            "athlete_id", "date", "run_count", *[F.col(f"`{c}`") for c in names]),
        "SELECT d.athlete_id, d.date, d.run_count, " + ", ".join(f's."{c}"' for c in names)
        + f" FROM daily_runs AS d LEFT JOIN {cte} AS s USING (athlete_id, date)", rounded)


_joined("j01_join_metrics", daily.join_metrics, "metrics", " ".join(K.METRIC_COLUMNS), "metrics1", METRICS)
_joined("j02_join_predictions", daily.join_predictions, "predictions", " ".join(K.PREDICTION_COLUMNS),
        "predictions1", "", daily.prediction_labels)
_joined("j03_join_maxmet", daily.join_maxmet, "maxmet", " ".join(K.MAXMET_COLUMNS), "maxmet1",
        "vo2MaxValue fitnessAge maxMet")
_joined("j04_join_readiness", daily.join_readiness, "readiness",
        "readiness_score_first readiness_score_mean readiness_level_last valid_sleep_any", "readiness1",
        "readiness_score_first readiness_score_mean")
_joined("j05_join_history", daily.join_history, "history",
        "training_status_first training_status load_tunnel_min", "history1", "load_tunnel_min")

register("q27_daily_master", master, "SELECT * FROM master", MASTER)

register("u01_union_by_name",
         lambda w: readers.union_tables(
             w.family("metrics").select("athlete_id", "date", "acwrPercent"),
             w.family("maxmet").select("athlete_id", "date", "maxMet"),
             w.family("history").select("athlete_id", "date", "trainingStatus")),
         "SELECT athlete_id, date, acwrPercent FROM raw_metrics UNION ALL BY NAME "
         "SELECT athlete_id, date, maxMet FROM raw_maxmet UNION ALL BY NAME "
         "SELECT athlete_id, date, trainingStatus FROM raw_history", "acwrPercent maxMet")

ORDER_DAY = "nullif(CAST(o_orderdate AS DATE), DATE '1998-10-03')"

# --- scalar functions -----------------------------------------------------------------

register("x01_pace_labels",
         lambda w: w.table("lineitem").select(
             "l_orderkey", "l_linenumber", X.pace_label(F.col("l_quantity") / 7 - 1).alias("mile"),
             X.pace_label(F.col("l_quantity") / 7 - 1, "km").alias("km")),
         f"SELECT l_orderkey, l_linenumber, {pace('(l_quantity / 7 - 1)', '1609.34e0')} AS mile, "
         f"{pace('(l_quantity / 7 - 1)', '1000e0')} AS km FROM lineitem")

register("x04_x08_x09_clock_text",
         lambda w: w.table("lineitem").select(
             "l_orderkey", "l_linenumber", X.seconds_to_hms("l_extendedprice").alias("hms"),
             X.minutes_label(F.col("l_extendedprice") / 97).alias("label"),
             X.prediction_minutes(X.seconds_to_hms("l_extendedprice")).alias("from_text"),
             X.prediction_minutes(F.col("l_quantity").cast("string")).alias("from_number")),
         f"SELECT l_orderkey, l_linenumber, {hms('l_extendedprice')} AS hms, "
         f"{clock('l_extendedprice / 97')} AS label, round_even(l_extendedprice, 0) / 60 AS from_text, "
         "l_quantity AS from_number FROM lineitem", "from_text from_number")

register("x06_x07_calendar_dates",
         lambda w: w.family("metrics").select(
             "athlete_id", "acwrPercent", X.calendar_date("calendarDate").alias("date"),
             X.normalize_date("acwrStatus").alias("bad")),
         "SELECT athlete_id, acwrPercent, date, CAST(NULL AS DATE) AS bad FROM raw_metrics", "acwrPercent")

register("x10_x11_labels",
         lambda w: w.table("orders").select(
             "o_orderkey", X.date_label(F.nullif(F.col("o_orderdate").cast("date"),
                                                 F.lit("1998-10-03").cast("date"))).alias("day"),
             X.distance_label(F.col("o_totalprice") / 7).alias("miles")),
         f"SELECT o_orderkey, {day_label(ORDER_DAY)} AS day, {distance('o_totalprice / 7')} AS miles FROM orders")

register("x12_x14_race_distance_and_pace",
         lambda w: clean.of_type(w.calendar(), "race").select(
             "athlete_id", "date", "label", X.upper_label("race_type").alias("kind"),
             X.standard_distance_miles("race_type").alias("miles"),
             (F.col("official_time_min") / X.standard_distance_miles("race_type")).alias("pace")),
         "SELECT athlete_id, date, label, upper(coalesce(race_type, 'race')) AS kind, m.miles, "
         "official_time_min / m.miles AS pace FROM cal AS c LEFT JOIN (VALUES ('marathon', 26.2188e0), "
         "('half', 13.1094e0), ('10k', 6.2137e0), ('5k', 3.1069e0)) AS m(t, miles) ON c.race_type = m.t "
         "WHERE event_type = 'race'", "miles pace")

register("x15_x16_error_classes",
         lambda w: w.table("orders").select(
             "o_orderkey", F.nullif(F.lit(5e5) - F.col("o_totalprice") * 2, F.lit(0.0)).alias("e"))
         .select("o_orderkey", X.error_sign(F.col("e") / 1e5).alias("sign"),
                 X.error_bias(F.col("e") / 1e5).alias("bias"), F.abs("e").alias("absolute")),
         "SELECT o_orderkey, CASE WHEN e < 0 THEN 'optimistic' WHEN e > 0 THEN 'conservative' ELSE 'neutral' END "
         "AS sign, CASE WHEN e / 1e5 < -2 THEN 'optimistic' WHEN e / 1e5 > 2 THEN 'conservative' ELSE 'neutral' END "
         "AS bias, abs(e) AS absolute FROM (SELECT o_orderkey, 5e5 - o_totalprice * 2 AS e FROM orders)", "absolute")

register("x19_x23_names_and_years",
         lambda w: w.calendar().select(
             "athlete_id", "date", X.year_of("date").alias("year"),
             X.short_block_name("label").alias("short"), X.title_label(F.lower("label")).alias("title"),
             X.first_word("label").alias("word")),
         "SELECT athlete_id, date, year(date) AS year, replace(label, ' Marathon', '') AS short, "
         "label AS title, lower(split_part(label, ' ', 1)) AS word FROM cal")

register("x20_x21_map_columns",
         lambda w: runs(w).select("activityId", X.marker_radius("distance_miles").alias("radius"),
                                  X.has_route_chord().alias("chord")),
         "SELECT activityId, sqrt(greatest(coalesce(distance_miles, 0), 0.2)) * 120 AS radius, "
         "coalesce(endLatitude IS NOT NULL AND endLongitude IS NOT NULL AND "
         "(round_even(startLatitude, 5) <> round_even(endLatitude, 5) OR "
         "round_even(startLongitude, 5) <> round_even(endLongitude, 5)), false) AS chord FROM runs", "radius")

register("x24_s18_nested_to_text",
         lambda w: _nested(w),
         "SELECT event_id, CASE WHEN k % 3 = 0 THEN NULL ELSE '[' || k || ',' || user_id || ']' END AS listed, "
         "CASE WHEN k % 5 = 0 THEN NULL ELSE '{\"k\":' || k || '}' END AS named FROM ev")


def _nested(w: Warehouse):
    from strideframe.sources.writers import parquet_safe
    k = F.col("k")
    return parquet_safe(w.events().select(
        "event_id",
        F.when(k % 3 == 0, F.array().cast("array<bigint>")).otherwise(
            F.array(k.cast("bigint"), F.col("user_id"))).alias("listed"),
        F.struct(F.when(k % 5 != 0, k).alias("k")).alias("named")))


register("x18_formatted_numbers",
         lambda w: w.table("lineitem").select(
             "l_orderkey", "l_linenumber", X.fixed_text(F.col("l_extendedprice") / 8).alias("plain"),
             X.signed_text(F.col("l_tax") - F.col("l_discount")).alias("signed"),
             X.fixed_text(F.col("l_extendedprice") / 8, 1, True).alias("grouped")),
         f"SELECT l_orderkey, l_linenumber, {fixed('l_extendedprice / 8')} AS plain, "
         f"{signed('(l_tax - l_discount)')} AS signed, {grouped('l_extendedprice / 8')} AS \"grouped\" FROM lineitem")
