"""Queries over calendars, windows, temporal joins and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from strideframe.checks.cleaning_queries import days, kept_days, runs
from strideframe.checks.oracle_tables import ROLLING, filled, rolling_std, week_end
from strideframe.checks.registry import register
from strideframe.checks.warehouse import Warehouse
from strideframe.functions import columns as X
from strideframe.operators import calendar, daily, rolling, stats, temporal
from strideframe.plans import blocks as B, races as R


def orders(w: Warehouse):
    return w.table("orders").withColumn("day", F.col("o_orderdate").cast("date"))


def lines(w: Warehouse):
    return w.table("lineitem").withColumn("day", F.col("l_shipdate").cast("date"))


def customer_days(w: Warehouse):
    return orders(w).groupBy("o_custkey", F.col("day").alias("date")).agg(
        F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))


def user_days(w: Warehouse):
    return w.events().groupBy("user_id", "date").agg(
        F.sum("value").alias("total"),
        F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("seen"))


ORDERS = "(SELECT *, CAST(o_orderdate AS DATE) AS day FROM orders)"
LINES = "(SELECT *, CAST(l_shipdate AS DATE) AS day FROM lineitem)"
CUSTOMER_DAYS = ("(SELECT o_custkey, CAST(o_orderdate AS DATE) AS date, sum(o_totalprice) AS total, "
                 "count(*) AS n FROM orders GROUP BY ALL)")
USER_DAYS = ("(SELECT user_id, CAST(ts AS DATE) AS date, sum(value) AS total, "
             "max(value) FILTER (WHERE event_type = 'view') AS seen FROM events GROUP BY ALL)")

# --- calendar -------------------------------------------------------------------------

register("a10_weekly_sum_per_flag",
         lambda w: calendar.period_totals(lines(w), ["l_returnflag"], "day", "l_quantity", "W-SUN", "quantity"),
         f"SELECT l_returnflag, p AS period_end, v AS quantity FROM ({filled(LINES, 'l_returnflag', week_end('day'), 'l_quantity')})",
         "quantity")
register("a10_weekly_sum_per_customer",
         lambda w: calendar.period_totals(orders(w), ["o_custkey"], "day", "o_totalprice", "W-SUN", "spent"),
         f"SELECT o_custkey, p AS period_end, v AS spent FROM ({filled(ORDERS, 'o_custkey', week_end('day'), 'o_totalprice')})",
         "spent")
register("a10_weekly_sum_overall",
         lambda w: calendar.period_totals(lines(w), [], "day", "l_quantity", "W-SUN", "quantity"),
         f"SELECT p AS period_end, v AS quantity FROM ({filled(LINES, '', week_end('day'), 'l_quantity')})",
         "quantity")
register("a11_weekly_sum_ending_monday",
         lambda w: calendar.period_totals(orders(w), ["o_orderstatus"], "day", "o_totalprice", "W-MON", "spent"),
         f"SELECT o_orderstatus, p AS period_end, v AS spent FROM ({filled(ORDERS, 'o_orderstatus', week_end('day', 'MON'), 'o_totalprice')})",
         "spent")
register("a12_peak_and_mean_week",
         lambda w: calendar.peak_and_mean(calendar.period_totals(
             orders(w), ["o_custkey"], "day", "o_totalprice", "W-MON"), ["o_custkey"], "total", "peak", "mean"),
         f"SELECT o_custkey, max(v) AS peak, avg(v) AS mean FROM ({filled(ORDERS, 'o_custkey', week_end('day', 'MON'), 'o_totalprice')}) GROUP BY 1",
         "peak mean")
register("a13_max_per_day",
         lambda w: calendar.max_per_day(orders(w), ["o_custkey"], "day", "o_totalprice"),
         f"SELECT o_custkey, day, max(o_totalprice) AS o_totalprice FROM {ORDERS} GROUP BY ALL", "o_totalprice")
register("a14_monthly_sum",
         lambda w: calendar.period_totals(orders(w), ["o_custkey"], "day", "o_totalprice", "M", "spent", period_col="month_end"),
         f"SELECT o_custkey, p AS month_end, v AS spent FROM ({filled(ORDERS, 'o_custkey', 'last_day(day)', 'o_totalprice', '1 MONTH')})",
         "spent")
register("a15_calendar_week_sum",
         lambda w: calendar.calendar_week_totals(orders(w), ["o_custkey"], "o_orderdate", "o_totalprice"),
         f"SELECT o_custkey, CAST(date_trunc('week', day) AS DATE) AS week, sum(o_totalprice) AS total FROM {ORDERS} GROUP BY ALL",
         "total")
register("a16_yearly_sum",
         lambda w: calendar.yearly_totals(orders(w), ["o_orderstatus"], "o_orderdate", "o_totalprice"),
         f"SELECT o_orderstatus, year(day) AS year, sum(o_totalprice) AS total FROM {ORDERS} GROUP BY ALL", "total")

# --- windows --------------------------------------------------------------------------

register("w01_rolling_std",
         lambda w: days(w).select("athlete_id", "date", *ROLLING),
         "SELECT athlete_id, date, " + ", ".join(f'"{c}"' for c in ROLLING) + " FROM days", " ".join(ROLLING))
register("w01_rolling_std_orders",
         lambda w: rolling.rolling_volatility(customer_days(w), ["o_custkey"], "date", {"total": "total"}, (3, 7)).drop("n"),
         f"SELECT o_custkey, date, total, {rolling_std('total', 3, 'o_custkey')} AS rolling_std_3_totald, "
         f"{rolling_std('total', 7, 'o_custkey')} AS rolling_std_7_totald FROM {CUSTOMER_DAYS}",
         "total rolling_std_3_totald rolling_std_7_totald")
register("w02_moving_average",
         lambda w: rolling.moving_average(customer_days(w), "total", ["o_custkey"], "mean7"),
         f"SELECT *, avg(total) OVER (PARTITION BY o_custkey ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW) AS mean7 FROM {CUSTOMER_DAYS}",
         "total mean7")
register("w03_forward_fill",
         lambda w: rolling.forward_fill(user_days(w), ["seen"], ["user_id"]),
         f"SELECT user_id, date, total, last_value(seen IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seen FROM {USER_DAYS}",
         "total seen")


def _with_final(w: Warehouse):
    last = F.max_by(F.struct("seen"), "date").getField("seen").alias("final")
    base = user_days(w)
    return base.join(base.groupBy("user_id").agg(last), ["user_id"])


FINAL = (f"(SELECT d.*, f.final FROM {USER_DAYS} AS d JOIN (SELECT user_id, arg_max_null(seen, date) AS final "
         f"FROM {USER_DAYS} GROUP BY 1) AS f USING (user_id))")
MARK = (f"(SELECT *, bool_and(coalesce(abs(seen - final) <= 40, false)) OVER (PARTITION BY user_id ORDER BY date "
        f"ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS stable FROM {FINAL})")
register("w04_stable_tail_rows",
         lambda w: rolling.mark_stable_tail(_with_final(w), "seen", "final", ["user_id"], "stable", tolerance=40.0),
         f"SELECT user_id, date, total, seen, final, stable FROM {MARK}", "total seen final")
register("w04_w05_stabilisation",
         lambda w: rolling.stabilisation(_with_final(w), "seen", "final", ["user_id"], tolerance=40.0)
         .withColumn("days_stable", X.days_between(F.lit("2024-01-31").cast("date"), "stable_date")),
         f"SELECT user_id, min(date) FILTER (WHERE stable) AS stable_date, date_diff('day', min(date) FILTER (WHERE stable), DATE '2024-01-31') AS days_stable FROM {MARK} GROUP BY 1")
register("w06_tail_mean",
         lambda w: rolling.tail_mean(user_days(w), "total", ["user_id"], "mean14"),
         f"SELECT user_id, avg(total) AS mean14 FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC) AS place FROM {USER_DAYS}) WHERE place <= 14 GROUP BY 1",
         "mean14")
register("w07_days_from_start",
         lambda w: rolling.with_days_from_start(customer_days(w), ["o_custkey"]),
         f"SELECT *, date_diff('day', min(date) OVER (PARTITION BY o_custkey), date) AS days_from_start FROM {CUSTOMER_DAYS}",
         "total")
register("w08_a21_first_last_drift",
         lambda w: user_days(w).groupBy("user_id").agg(
             rolling.value_at_first("seen").alias("first"), rolling.value_at_last("seen").alias("last"),
             rolling.drift("seen").alias("drift")),
         f"SELECT user_id, arg_min_null(seen, date) AS first, arg_max_null(seen, date) AS last, arg_max_null(seen, date) - arg_min_null(seen, date) AS drift FROM {USER_DAYS} GROUP BY 1",
         "first last drift")
register("w09_stability_band",
         lambda w: rolling.stability_band(user_days(w), "total"),
         f"SELECT *, total - 2 AS band_lower, total + 2 AS band_upper FROM {USER_DAYS}",
         "total seen band_lower band_upper")
register("w10_best_row_per_group",
         lambda w: rolling.top_row(w.table("orders").select("o_orderpriority", "o_orderkey", "o_totalprice", "o_custkey"),
                                   ["o_orderpriority"], F.col("o_totalprice")),
         "SELECT o_orderpriority, o_orderkey, o_totalprice, o_custkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey) = 1",
         "o_totalprice")

# --- temporal joins -------------------------------------------------------------------

URGENT = "o_orderpriority = '1-URGENT'"


def _asof_orders(w: Warehouse, direction: str):
    probe = orders(w).where(URGENT).select("o_orderkey", "o_custkey", "day")
    series = orders(w).where(f"NOT ({URGENT})").select(
        "o_custkey", F.col("day").alias("at"), "o_totalprice", F.col("o_orderkey").alias("matched_key"))
    return temporal.asof_join(probe, series, ["o_custkey"], "day", "at", ["o_totalprice", "matched_key"],
                              matched="matched_day", tie_break=["matched_key"], direction=direction)


def _asof_orders_sql(op: str) -> str:
    series = (f"(SELECT o_custkey, day AS at, arg_max(o_totalprice, o_orderkey) AS o_totalprice, "
              f"max(o_orderkey) AS matched_key FROM {ORDERS} WHERE NOT ({URGENT}) GROUP BY ALL)")
    return (f"SELECT l.o_orderkey, l.o_custkey, l.day, r.at AS matched_day, r.o_totalprice, r.matched_key "
            f"FROM (SELECT * FROM {ORDERS} WHERE {URGENT}) AS l ASOF LEFT JOIN {series} AS r "
            f"ON l.o_custkey = r.o_custkey AND l.day {op} r.at")


register("j06_asof_backward", lambda w: _asof_orders(w, "backward"), _asof_orders_sql(">="), "o_totalprice")
register("j06_asof_forward", lambda w: _asof_orders(w, "forward"), _asof_orders_sql("<="), "o_totalprice")


def _asof_events(w: Warehouse):
    events = w.table("events").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    probe = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    series = events.where("event_type = 'view'").select(
        "user_id", F.col("ts").alias("at"), F.col("event_id").alias("view_id"), "value")
    joined = temporal.asof_join(probe, series, ["user_id"], "ts", "at", ["view_id", "value"],
                                chunk=lambda t: F.to_date(t))
    return joined.select("event_id", "user_id", "view_id", "value")


register("j06_asof_chunked_timestamps", _asof_events,
         "SELECT l.event_id, l.user_id, r.event_id AS view_id, r.value FROM (SELECT * FROM events WHERE event_type = 'purchase') AS l "
         "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') AS r ON l.user_id = r.user_id AND l.ts >= r.ts",
         "value")

register("j07_interval_labels",
         lambda w: temporal.label_intervals(runs(w).select("athlete_id", "activityId", "date"), w.blocks()),
         "SELECT r.athlete_id, r.activityId, r.date, coalesce(arg_max(b.block_name, b.priority), 'Outside marathon blocks') AS marathon_block "
         "FROM runs AS r LEFT JOIN blocks AS b ON r.athlete_id = b.athlete_id AND r.date BETWEEN b.start_date AND b.end_date GROUP BY ALL")


def _order_blocks(w: Warehouse):
    """Ninety days before each urgent order; the later order has priority."""
    return orders(w).where(URGENT).select(
        "o_custkey", F.col("o_orderkey").cast("string").alias("block_name"),
        F.date_sub("day", 90).alias("start_date"), F.date_sub("day", 1).alias("end_date"),
        F.col("o_orderkey").alias("priority"))


register("j07_interval_labels_orders",
         lambda w: temporal.label_intervals(
             orders(w).select("o_orderkey", "o_custkey", F.col("day").alias("date")), _order_blocks(w),
             ["o_custkey"], out="block", default="none"),
         f"SELECT o.o_orderkey, o.o_custkey, o.day AS date, coalesce(CAST(max(b.o_orderkey) AS VARCHAR), 'none') AS block "
         f"FROM {ORDERS} AS o LEFT JOIN (SELECT * FROM {ORDERS} WHERE {URGENT}) AS b ON o.o_custkey = b.o_custkey "
         "AND o.day BETWEEN b.day - 90 AND b.day - 1 GROUP BY ALL")


def _nearest_orders(w: Warehouse):
    probe = orders(w).where(URGENT).select("o_orderkey", "o_custkey", "o_totalprice")
    others = orders(w).where(f"NOT ({URGENT})").select(
        "o_custkey", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("near_key"))
    return temporal.nearest_match(probe, others, ["o_custkey"], "o_totalprice", "price", ["near_key"],
                                  ["near_key", "price"], chunk_width=50_000.0)


register("j08_nearest_price", _nearest_orders,
         f"SELECT l.o_orderkey, l.o_custkey, l.o_totalprice, r.o_orderkey AS near_key, r.o_totalprice AS price "
         f"FROM (SELECT * FROM orders WHERE {URGENT}) AS l LEFT JOIN (SELECT * FROM orders WHERE NOT ({URGENT})) AS r "
         "ON l.o_custkey = r.o_custkey QUALIFY row_number() OVER (PARTITION BY l.o_orderkey ORDER BY "
         "abs(r.o_totalprice - l.o_totalprice) NULLS LAST, r.o_orderkey) = 1", "o_totalprice price")

register("j09_race_of_block",
         lambda w: B.block_races(w.blocks(), R.evaluate_races(w.calendar(), days(w))),
         "SELECT * FROM block_race", "actual_time final_prediction")

register("j11_prediction_of_race_type",
         lambda w: w.calendar().join(days(w).select("athlete_id", "date", *[f"`{p}_pred`" for p in ("5K", "10K", "Half", "Marathon")]),
                                     ["athlete_id", "date"]).select(
             "athlete_id", "date", "label", X.prediction_for_race_type("race_type").alias("chosen")),
         'SELECT athlete_id, date, label, CASE race_type WHEN \'5k\' THEN "5K_pred" WHEN \'10k\' THEN "10K_pred" '
         'WHEN \'half\' THEN "Half_pred" WHEN \'marathon\' THEN "Marathon_pred" END AS chosen '
         "FROM cal JOIN days USING (athlete_id, date)", "chosen")


def _overrides(w: Warehouse):
    return w.calendar().where("event_type = 'race' AND label = 'Cedar Marathon'").groupBy(
        "athlete_id", "label").agg(F.date_sub(F.min("date"), 3).alias("prediction_date"))


register("j12_prediction_date_override",
         lambda w: temporal.apply_overrides(R.race_calendar(w.calendar()), _overrides(w),
                                            ["athlete_id", "label"], "prediction_date"),
         "SELECT r.athlete_id, r.race_date, r.label, r.race_type, r.official_time_min, "
         "CAST(CASE WHEN r.label = 'Cedar Marathon' THEN min(r.race_date) OVER (PARTITION BY r.athlete_id, r.label) - 3 "
         "ELSE r.prediction_date END AS DATE) AS prediction_date FROM races AS r", "official_time_min")

# --- statistics -----------------------------------------------------------------------

register("a17_value_counts",
         lambda w: stats.most_frequent(stats.value_counts(w.family("readiness"), "level"), "level"),
         "SELECT level, count(*) AS n FROM raw_readiness WHERE level IS NOT NULL GROUP BY level")
register("a17_value_counts_customers",
         lambda w: stats.most_frequent(stats.value_counts(w.table("orders"), "o_custkey"), "o_custkey"),
         "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey")
register("a18_error_by_race_type",
         lambda w: R.error_by_race_type(R.evaluate_races(w.calendar(), days(w))),
         "SELECT race_type, avg(prediction_error) AS mean, stddev_samp(prediction_error) AS std, "
         "count(prediction_error) AS count FROM race_eval WHERE race_type IS NOT NULL GROUP BY race_type", "mean std")
register("a22_grand_totals",
         lambda w: stats.totals(w.table("orders"), n=F.count(F.lit(1)), total=F.sum("o_totalprice"),
                                first=F.min("o_orderdate").cast("date"), last=F.max("o_orderdate").cast("date"),
                                spread=F.avg(F.abs(F.col("o_totalprice") - 250000))),
         "SELECT count(*) AS n, sum(o_totalprice) AS total, CAST(min(o_orderdate) AS DATE) AS first, "
         "CAST(max(o_orderdate) AS DATE) AS last, avg(abs(o_totalprice - 250000)) AS spread FROM orders", "total spread")
register("a23_distinct_count",
         lambda w: stats.distinct_count(w.table("orders"), "o_custkey", ["o_orderstatus"]),
         "SELECT o_orderstatus, count(DISTINCT o_custkey) AS n FROM orders GROUP BY 1")
register("a24_distinct_values",
         lambda w: stats.distinct_values(w.family("readiness"), "level"),
         "SELECT DISTINCT level FROM raw_readiness WHERE level IS NOT NULL")
register("a26_correlation",
         lambda w: stats.correlation(w.family("readiness"), ["level"], "score", "sleepScore"),
         "SELECT level, corr(score, sleepScore) AS corr FROM raw_readiness GROUP BY level", "corr")
register("a27_linear_fit",
         lambda w: stats.linear_fit(w.table("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"),
         "SELECT l_returnflag, regr_slope(l_extendedprice, l_quantity) AS slope, regr_intercept(l_extendedprice, l_quantity) AS intercept, "
         "regr_r2(l_extendedprice, l_quantity) AS r2, count(*) AS n FROM lineitem GROUP BY 1", "slope intercept r2")


def _histogram_sql(source: str, value: str, bins: int, key: str = "") -> str:
    k, on = (f"{key}, ", f"USING ({key})") if key else ("", "ON true")
    group = f"GROUP BY {key}" if key else ""
    return (
        f"WITH b AS (SELECT {k}min({value}) AS lo, max({value}) AS hi FROM {source} {group}), "
        f"c AS (SELECT {k}least(CAST(floor(({value} - lo) / (hi - lo) * {bins}) AS BIGINT) + 1, {bins}) AS bin, "
        f"count(*) AS n FROM {source} JOIN b {on} WHERE {value} IS NOT NULL GROUP BY ALL), "
        f"s AS (SELECT {k}lo, hi, CAST(unnest(range(1, {bins} + 1)) AS BIGINT) AS bin FROM b) "
        f"SELECT {'s.' + key + ', ' if key else ''}s.bin, lo + (hi - lo) / {bins} * (s.bin - 1) AS bin_start, "
        f"lo + (hi - lo) / {bins} * s.bin AS bin_end, coalesce(c.n, 0) AS n FROM s LEFT JOIN c "
        f"ON s.bin = c.bin{f' AND s.{key} = c.{key}' if key else ''}")


register("a28_histogram",
         lambda w: stats.histogram(w.table("orders"), "o_totalprice", 30),
         _histogram_sql("orders", "o_totalprice", 30), "bin_start bin_end")
register("a28_histogram_per_status",
         lambda w: stats.histogram(w.table("orders"), "o_totalprice", 20, ["o_orderstatus"]),
         _histogram_sql("orders", "o_totalprice", 20, "o_orderstatus"), "bin_start bin_end")
BOX = ("WITH q AS (SELECT {k} AS g, quantile_cont({v}, 0.25) AS q1, quantile_cont({v}, 0.5) AS median, "
       "quantile_cont({v}, 0.75) AS q3 FROM {t} WHERE {k} IS NOT NULL AND {v} IS NOT NULL GROUP BY 1) "
       "SELECT g AS {k}, q1, median, q3, min({v}) FILTER (WHERE {v} >= q1 - 1.5 * (q3 - q1)) AS whisker_low, "
       "max({v}) FILTER (WHERE {v} <= q3 + 1.5 * (q3 - q1)) AS whisker_high, "
       "count(*) FILTER (WHERE {v} < q1 - 1.5 * (q3 - q1) OR {v} > q3 + 1.5 * (q3 - q1)) AS outliers "
       "FROM {t} JOIN q ON {k} = g WHERE {v} IS NOT NULL GROUP BY ALL")
register("a29_box_statistics",
         lambda w: stats.box_statistics(w.table("events"), ["event_type"], "value"),
         BOX.format(k="event_type", v="value", t="events"), "q1 median q3 whisker_low whisker_high")
register("a29_box_statistics_lines",
         lambda w: stats.box_statistics(w.table("lineitem"), ["l_returnflag"], "l_extendedprice"),
         BOX.format(k="l_returnflag", v="l_extendedprice", t="lineitem"), "q1 median q3 whisker_low whisker_high")
register("a29_error_boxes",
         lambda w: R.error_boxes(R.evaluate_races(w.calendar(), days(w))),
         BOX.format(k="race_type", v="prediction_error", t="race_eval"), "q1 median q3 whisker_low whisker_high")
PROFILED = ("score", "recoveryTime", "hrvWeeklyAverage", "sleepScore")
register("a30_column_profile",
         lambda w: stats.column_profile(w.family("readiness"), PROFILED),
         " UNION ALL ".join(
             f"SELECT '{c}' AS \"column\", count(*) AS rows, count(*) - count({c}) AS nulls, "
             f"(count(*) - count({c})) / count(*) AS null_share, avg({c}) AS mean, stddev_samp({c}) AS std, "
             f"min({c}) AS min, max({c}) AS max, quantile_cont({c}, 0.25)::DOUBLE AS q1, quantile_cont({c}, 0.5)::DOUBLE AS median, "
             f"quantile_cont({c}, 0.75)::DOUBLE AS q3 FROM raw_readiness" for c in PROFILED),
         "null_share mean std min max q1 median q3")
register("a31_common_range",
         lambda w: stats.common_range(w.table("lineitem"), "l_quantity", "l_extendedprice", ["l_returnflag"]),
         "SELECT l_returnflag, least(min(l_quantity), min(l_extendedprice)) AS range_min, "
         "greatest(max(l_quantity), max(l_extendedprice)) AS range_max FROM lineitem GROUP BY 1", "range_min range_max")
register("a34_mean_by_x",
         lambda w: stats.mean_by(runs(w), ["avg_pace_km"], "avgHr", "avg_hr"),
         "SELECT avg_pace_km, avg(avgHr) AS avg_hr FROM runs WHERE avg_pace_km IS NOT NULL AND avgHr IS NOT NULL GROUP BY 1",
         "avg_hr")

TREND_POINTS = 21


TREND_PASSES = 3


def _trend_sql(source: str, x: str, y: str) -> str:
    last = TREND_POINTS - 1
    fit = ("(SELECT point, gx AS x, (wxx * wy - wx * wxy) / (w * wxx - wx * wx) AS trend FROM "
           "(SELECT point, gx, sum(w) AS w, sum(w * dx) AS wx, sum(w * y) AS wy, sum(w * dx * dx) AS wxx, "
           "sum(w * dx * y) AS wxy FROM {rows} GROUP BY ALL))")
    at = f"(CASE WHEN hi > lo THEN (s.x - lo) / (hi - lo) * {last} ELSE 0 END)"
    i = f"least(floor({at}), {last - 1})::BIGINT"
    passes = []
    for k in range(1, TREND_PASSES + 1):
        # each row's fitted value on the broken line through the last fits, then bisquare weights
        res = f"(s.y - (line[{i} + 1] + (line[{i} + 2] - line[{i} + 1]) * ({at} - {i})))"
        passes.append(
            f"l{k} AS (SELECT list(trend ORDER BY point) AS line FROM f{k - 1}), "
            f"r{k} AS (SELECT s.*, {res} AS res FROM s, e, l{k}), "
            f"m{k} AS (SELECT quantile_cont(abs(res), 0.5) AS sc FROM r{k} WHERE point = 0), "
            f"b{k} AS (SELECT point, gx, dx, y, w * CASE WHEN res IS NULL OR coalesce(sc, 0) = 0 THEN 1e0 "
            f"WHEN abs(res / (6 * sc)) < 1 THEN pow(1 - (res / (6 * sc)) * (res / (6 * sc)), 2) ELSE 0e0 END AS w FROM r{k}, m{k}), "
            f"f{k} AS {fit.format(rows=f'b{k}')}")
    return (
        f"WITH d AS (SELECT CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL), "
        "e AS (SELECT min(x) AS lo, max(x) AS hi FROM d), "
        f"g AS (SELECT CAST(i AS BIGINT) AS point, lo + (hi - lo) * (i / {last}) AS gx FROM e, range({TREND_POINTS}) AS t(i)), "
        "h AS (SELECT point, gx, quantile_disc(abs(x - gx), 2e0 / 3) AS reach FROM g, d GROUP BY ALL), "
        "s AS (SELECT point, gx, x, x - gx AS dx, y, pow(1 - pow(least(abs(x - gx) / reach, 1), 3), 3) AS w FROM h, d), "
        f"f0 AS {fit.format(rows='s')}, " + ", ".join(passes) +
        f" SELECT point, x, trend FROM f{TREND_PASSES}")


register("a35_local_trend_acwr",
         lambda w: stats.local_trend(B.loaded_days(B.block_series(kept_days(w), w.blocks())),
                                     "rolling_std_7_Marathond", "dailyAcuteChronicWorkloadRatio", TREND_POINTS),
         _trend_sql("(SELECT * FROM series WHERE total_training_load > 0)", '"rolling_std_7_Marathond"',
                    "dailyAcuteChronicWorkloadRatio"), "x trend")
register("a35_local_trend_readiness",
         lambda w: stats.local_trend(B.loaded_days(B.block_series(kept_days(w), w.blocks())),
                                     "rolling_std_7_Marathond", "readiness_score_mean", TREND_POINTS),
         _trend_sql("(SELECT * FROM series WHERE total_training_load > 0)", '"rolling_std_7_Marathond"',
                    "readiness_score_mean"), "x trend")

# --- order and top rows ---------------------------------------------------------------

register("k01_k02_sorted_nulls_last",
         lambda w: w.family("readiness").select("athlete_id", "date", "score").orderBy(
             "date", F.col("score").asc_nulls_last(), "athlete_id"),
         "SELECT athlete_id, date, score FROM raw_readiness", "score")
register("k03_dearest_order_per_customer",
         lambda w: rolling.top_row(w.table("orders").select("o_custkey", "o_totalprice", "o_orderkey"),
                                   ["o_custkey"], F.col("o_totalprice"), largest=True),
         "SELECT o_custkey, o_totalprice, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
         "o_totalprice")
register("k05_head",
         lambda w: stats.head(w.table("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 20),
         "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 20", "o_totalprice")
register("k05_tail",
         lambda w: stats.tail(w.table("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 20),
         "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 20", "o_totalprice")
register("k06_random_sample",
         lambda w: stats.sample_rows(w.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus"), 500, 42, "o_orderkey"),
         "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders "
         "ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
register("k07_first_and_last_time",
         lambda w: stats.extremes(w.events().select("user_id", "date"), "date", ["user_id"]),
         "SELECT user_id, min(date) AS first, max(date) AS last FROM ev GROUP BY 1")
