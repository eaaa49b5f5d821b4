"""Operators against brute force and literals: pitfalls, skewed keys, input order."""

import datetime as dt
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strideframe.operators import calendar, clean, rolling, stats, temporal
from strideframe.plans import blocks as B, overview as O, races as R


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(days=n)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def skewed(n, seed):
    """A third of all rows belong to one key."""
    rng = random.Random(seed)
    return [("hot" if rng.random() < 1 / 3 else f"k{rng.randrange(40)}", rng.randrange(2000), i)
            for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_keep_one_ignores_row_order(spark, partitions):
    data = [("a", day(1), f"f{i % 3}", i % 5) for i in range(30)] + [("b", day(1), "f0", None)]
    random.Random(partitions).shuffle(data)
    df = spark.createDataFrame(data, "athlete_id string, date date, source_file string, x int").repartition(partitions)
    assert rows(clean.dedup_dates(df, "first"), "athlete_id") == [("a", day(1), "f0", 0), ("b", day(1), "f0", None)]
    assert rows(clean.dedup_dates(df, "last"), "athlete_id") == [("a", day(1), "f2", 4), ("b", day(1), "f0", None)]


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("chunked", [False, True])
def test_asof_join_equals_brute_force_on_a_hot_key(spark, direction, chunked):
    left, right = skewed(600, 1), skewed(600, 2)
    l = spark.createDataFrame(left, "k string, t int, id int").repartition(7)
    r = spark.createDataFrame(right, "k string, u int, rid int").repartition(5)
    got = temporal.asof_join(l, r, ["k"], "t", "u", ["rid"], tie_break=["rid"], direction=direction,
                             chunk=(lambda t: F.floor(t / 100)) if chunked else None)
    found = {g.id: (g.matched_time, g.rid) for g in got.collect()}
    assert len(found) == len(left)
    for k, t, i in left:
        hits = [(u, rid) for kk, u, rid in right if kk == k and (u <= t if direction == "backward" else u >= t)]
        if direction == "backward":
            want = max(hits, default=(None, None))
        else:
            first = min((u for u, _ in hits), default=None)
            want = (first, max((rid for u, rid in hits if u == first), default=None))
        assert found[i] == want


def test_asof_keeps_a_matched_row_with_null_payload(spark):
    l = spark.createDataFrame([("a", day(5)), ("a", day(0)), ("b", day(5)), ("a", None)], "k string, t date")
    r = spark.createDataFrame([("a", day(1), 1.0), ("a", day(4), None)], "k string, u date, x double")
    got = rows(temporal.asof_join(l, r, ["k"], "t", "u", ["x"]), "k", "t")
    assert got == [("a", None, None, None), ("a", day(0), None, None), ("a", day(5), day(4), None),
                   ("b", day(5), None, None)]


def test_nearest_match_equals_brute_force_on_a_hot_key(spark):
    left, right = skewed(500, 3), skewed(500, 4)
    l = spark.createDataFrame(left, "k string, v int, id int").repartition(6)
    r = spark.createDataFrame(right, "k string, w int, rid int").repartition(3)
    got = temporal.nearest_match(l, r, ["k"], "v", "w", ["rid"], ["rid"], chunk_width=50.0)
    found = {g.id: g.rid for g in got.collect()}
    assert len(found) == len(left)
    for k, v, i in left:
        best = min(((abs(w - v), rid) for kk, w, rid in right if kk == k), default=(None, None))
        assert found[i] == best[1]


def test_nearest_match_uses_rows_without_value_last(spark):
    l = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "k string, v double")
    r = spark.createDataFrame([("a", None, 1), ("a", 500.0, 2), ("b", None, 4), ("b", None, 3)],
                              "k string, w double, rid int")
    got = rows(temporal.nearest_match(l, r, ["k"], "v", "w", ["rid"], ["rid"]).select("k", "rid"), "k")
    assert got == [("a", 2), ("b", 3)]


def test_later_block_wins_and_others_are_outside(spark):
    blocks = spark.createDataFrame([("a", "One", day(0), day(5), 1), ("a", "Two", day(4), day(8), 2)],
                                   "athlete_id string, block_name string, start_date date, end_date date, priority int")
    df = spark.createDataFrame([("a", day(n)) for n in (0, 4, 5, 8, 9)] + [("b", day(4))], "athlete_id string, date date")
    got = [g[2] for g in rows(temporal.label_intervals(df, blocks), "athlete_id", "date")]
    out = "Outside marathon blocks"
    assert got == ["One", "Two", "Two", "Two", out, out]
    assert temporal.slice_blocks(df, blocks).count() == 6


def test_weeks_and_months_fill_gaps_per_key(spark):
    df = spark.createDataFrame([("a", dt.date(2024, 1, 7), 1.0), ("a", dt.date(2024, 1, 8), 2.0),
                                ("a", dt.date(2024, 1, 29), 4.0), ("b", dt.date(2024, 3, 31), None)],
                               "k string, d date, v double")
    weeks = rows(calendar.period_totals(df, ["k"], "d", "v", "W-SUN"), "k", "period_end")
    assert weeks == [("a", dt.date(2024, 1, 7), 1.0), ("a", dt.date(2024, 1, 14), 2.0), ("a", dt.date(2024, 1, 21), 0.0),
                     ("a", dt.date(2024, 1, 28), 0.0), ("a", dt.date(2024, 2, 4), 4.0), ("b", dt.date(2024, 3, 31), 0.0)]
    monday = rows(calendar.period_totals(df, ["k"], "d", "v", "W-MON").where("k = 'a'"), "period_end")
    assert [(m[1].day, m[2]) for m in monday] == [(8, 3.0), (15, 0.0), (22, 0.0), (29, 4.0)]
    months = rows(calendar.period_totals(df, [], "d", "v", "M"), "period_end")
    assert months == [(dt.date(2024, 1, 31), 7.0), (dt.date(2024, 2, 29), 0.0), (dt.date(2024, 3, 31), 0.0)]
    with pytest.raises(ValueError):
        calendar.period_totals(df, ["k"], "d", "v", "D")


def test_rolling_std_needs_a_full_window_without_nulls(spark):
    xs = [1.0, 2.0, 4.0, None, 5.0, 7.0, 9.0]
    df = spark.createDataFrame([("a", day(i * 3), x) for i, x in enumerate(xs)] + [("b", day(0), 1.0)],
                               "athlete_id string, date date, x double")
    got = [g[3] for g in rows(rolling.rolling_volatility(df, columns={"x": "x"}, windows=(3,)), "athlete_id", "date")]
    want = pd.Series(xs, dtype=float).rolling(3).std().tolist() + [np.nan]
    assert [None if g is None else round(g, 9) for g in got] == [None if np.isnan(x) else round(x, 9) for x in want]


def test_stable_date(spark):
    def first_stable(xs):
        df = spark.createDataFrame([("a", day(i), x, 100.0) for i, x in enumerate(xs)],
                                   "k string, date date, p double, final double")
        return rolling.stabilisation(df, "p", "final", ["k"]).first().stable_date
    assert first_stable([90.0, 101.0, 99.0, 102.0]) == day(1)
    assert first_stable([100.0, None, 100.0]) == day(2)       # a missing prediction is not stable
    assert first_stable([100.0, 103.0]) is None               # never settles


def test_forward_fill_moving_average_and_tail(spark):
    df = spark.createDataFrame([("a", day(i), x) for i, x in enumerate([None, 1.0, None, 3.0])], "k string, date date, x double")
    assert [r[2] for r in rows(rolling.forward_fill(df, ["x"], ["k"]), "date")] == [None, 1.0, 1.0, 3.0]
    assert [r[3] for r in rows(rolling.moving_average(df, "x", ["k"], "m", 2), "date")] == [None, 1.0, 1.0, 3.0]
    assert rolling.tail_mean(df, "x", ["k"], "m", 2).first().m == 3.0
    assert df.groupBy("k").agg(rolling.drift("x").alias("d")).first().d is None


def test_exact_percentiles_on_a_large_hot_group(spark):
    rng = np.random.default_rng(7)
    data = pd.DataFrame({"k": np.where(rng.random(40_000) < 0.7, "hot", "cold"), "v": rng.lognormal(3, 2, 40_000)})
    df = spark.createDataFrame(data).repartition(8)
    got = {r.k: r.quantiles for r in stats.exact_percentiles(df, ["k"], "v", (0.0, 0.25, 0.5, 0.75, 1.0)).collect()}
    for k, g in data.groupby("k"):
        assert got[k] == pytest.approx(g.v.quantile([0, 0.25, 0.5, 0.75, 1]).tolist(), rel=1e-12)
    with pytest.raises(ValueError):
        stats.exact_percentiles(df, [], "v", (0.5,))


def test_histogram_edges(spark):
    df = spark.createDataFrame([(float(x),) for x in (0, 1, 5, 10, 10)], "v double")
    assert [r[3] for r in rows(stats.histogram(df, "v", 2), "bin")] == [2, 3]
    same = spark.createDataFrame([(3.0,), (3.0,)], "v double")
    assert [tuple(r)[1:] for r in rows(stats.histogram(same, "v", 2), "bin")] == [(2.5, 3.0, 0), (3.0, 3.5, 2)]


def test_local_trend_follows_a_line(spark):
    df = spark.createDataFrame([(float(x), 2.0 * x + 1) for x in range(50)], "x double, y double")
    for r in stats.local_trend(df, "x", "y", 5).collect():
        assert r.trend == pytest.approx(2 * r.x + 1)


def test_duplicate_report(spark):
    df = spark.createDataFrame([("a",), ("a",), ("b",), (None,), (None,), (None,)], "k string")
    assert tuple(clean.duplicate_report(df, "k").first()) == (3, 3, "a", 2)


def test_label_contains_matches_inside_the_label(spark):
    words = spark.createDataFrame([("a", "QX"), ("a", "zz"), ("b", "Dogwood")], "k string, w string")
    labels = spark.createDataFrame([("a", "My qx race"), ("a", "Dogwood Marathon"), ("b", "Grand DOGWOOD run"), ("a", None)], "k string, l string")
    assert rows(temporal.label_contains(words, labels, ["k"], "w", "l"), "k") == [
        ("a", "qx", "My qx race"), ("b", "dogwood", "Grand DOGWOOD run")]


CALENDAR = [  # invented names, one athlete
    ("4/20/26", "race", "Alder Marathon", 170.583, "marathon"), ("1/7/26", "training_block_start", "Alder Build", None, None),
    ("11/9/25", "rest", "Rest", None, None), ("11/8/25", "race", "Birch Marathon", 164.48, "marathon"),
    ("8/4/25", "training_block_start", "Birch Build", None, None), ("8/2/25", "race", "Cedar", 36.567, "10k"),
    ("6/8/25", "race", "Dogwood Half", 82.35, "half"), ("2/8/25", "race", "Elm Marathon", 169.2833, "marathon"),
    ("11/3/24", "race", "Fir Half", 80.3, "half"), ("9/7/24", "race", "Gum Marathon", 180.933, "marathon"),
]


@pytest.fixture()
def calendar_events(spark):
    data = [("a", dt.datetime.strptime(d, "%m/%d/%y").date(), *rest) for d, *rest in CALENDAR]
    return spark.createDataFrame(data, "athlete_id string, date date, event_type string, label string, "
                                       "official_time_min double, race_type string")


def test_personal_bests(spark, calendar_events):
    runs = spark.createDataFrame(
        [("a", dt.datetime(2025, 11, 8, 8), 160.0, 1, 26.3, "Warm", "X"), ("a", dt.datetime(2025, 11, 8, 9), 160.0, 2, 26.2, "Race", "Y"),
         ("a", dt.datetime(2025, 8, 2, 9), 36.0, 3, 6.2, None, None), ("b", dt.datetime(2024, 11, 3, 9), 80.3, 4, 13.0, "Other", "Z")],
        "athlete_id string, start_time timestamp_ntz, duration_minutes double, activityId bigint, distance_miles double, "
        "name string, locationName string")
    table = R.personal_best_table(calendar_events, runs)
    by = {r.label: r for r in table.collect()}
    assert by["Birch Marathon"].matched_run_name == "Race" and by["Birch Marathon"].recorded_distance_miles == 26.2
    assert by["Fir Half"].matched_run_name == "No same-day run matched" and by["Fir Half"].matched_location == ""
    assert by["Cedar"].matched_run_name is None
    best = {r.race_type_label: (r.official_time_min, r.pace_label, r.event_date) for r in R.best_by_race_type(table).collect()}
    assert best == {"10K": (36.567, "5:53", dt.date(2025, 8, 2)), "HALF": (80.3, "6:08", dt.date(2024, 11, 3)),
                    "MARATHON": (164.48, "6:16", dt.date(2025, 11, 8))}
    head = R.personal_best_headline(table).first()
    assert (head.race_events, head.categories, head.fastest_pace_label, head.fastest_race, head.most_recent_race) == (
        7, 3, "5:53", "Cedar", "Apr 20, 2026")


def test_blocks_from_events(spark, calendar_events):
    got = rows(R.blocks_from_events(calendar_events).select("block_name", "start_date", "end_date"), "start_date")
    assert got == [("Birch Marathon", dt.date(2025, 8, 4), dt.date(2025, 11, 7)),
                   ("Alder Marathon", dt.date(2026, 1, 7), dt.date(2026, 4, 19))]


def master_days(spark, athletes=("a",), n=40):
    data = [(k, day(i), 5.0 + i, 200.0 - i / 4, 40.0 + i, 50.0 if i else None, 10.0, 60.0) for k in athletes for i in range(n)]
    df = spark.createDataFrame(data, "athlete_id string, date date, total_distance_miles double, Marathon_pred double, "
                                     "total_training_load double, vo2MaxValue double, readiness_score_mean double, hrv_weekly_avg_clean double")
    df = df.withColumns({p: F.lit(None).cast("double") for p in ("5K_pred", "10K_pred", "Half_pred")})
    return rolling.rolling_volatility(df)


def test_block_summary_and_override(spark):
    days = master_days(spark, ("a", "b"))
    events = spark.createDataFrame([("a", day(30), "race", "Dogwood Marathon", 195.0, "marathon"),
                                    ("a", day(2), "race", "dogwood again", 300.0, None)],
                                   "athlete_id string, date date, event_type string, label string, official_time_min double, race_type string")
    races = R.evaluate_races(events, days)
    row = races.where("label = 'Dogwood Marathon'").first()
    assert row.prediction_date_matched == day(29) and row.relevant_prediction == 192.75
    assert row.prediction_error == -2.25 and row.error_category == "optimistic"
    assert races.where("race_type is null").first().error_category == "neutral"
    moved = spark.createDataFrame([("a", "Dogwood Marathon", day(20))], "athlete_id string, label string, prediction_date date")
    both = R.evaluate_races(events, days, moved).where("label = 'Dogwood Marathon'").first()
    assert both.relevant_prediction == 195.0 and both.prediction_date_matched == day(20)
    dates = R.evaluate_races(events, days, moved, override_errors=False).where("label = 'Dogwood Marathon'").first()
    assert dates.relevant_prediction == 192.75 and dates.prediction_date_matched == day(20)
    blocks = spark.createDataFrame([("a", "Dogwood Marathon", day(10), day(29), 1), ("b", "Dogwood Marathon", day(10), day(29), 1)],
                                   "athlete_id string, block_name string, start_date date, end_date date, priority int")
    late = races.where("label = 'Dogwood Marathon'")
    summary = {r.athlete_id: r for r in B.block_summary(B.block_series(days, blocks), blocks, late).collect()}
    a = summary["a"]
    assert (a.race_date, a.prediction_bias, a.stable_date, a.days_stable_before_race) == (day(30), "optimistic", day(21), 9)
    assert a.prediction_drift == pytest.approx(192.75 - 197.5) and a.vo2_drift == 0.0
    assert a.last_14_day_avg_prediction == pytest.approx(sum(200 - i / 4 for i in range(16, 30)) / 14)
    b = summary["b"]                       # no race: the athlete with equal dates stays apart
    assert b.race_date is None and b.stable_date is None and b.prediction_bias == "neutral"
    picks = {r.finding: r.block_name for r in O.key_findings(B.block_summary(B.block_series(days, blocks), blocks, late)).where("athlete_id = 'a'").collect()}
    assert picks["closest_prediction"] == "Dogwood Marathon" and len(picks) == 5


def test_order_codes_sort_like_doubles(spark):
    import struct
    rng = random.Random(3)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.0 ** -1022, 1.7976931348623157e308, float("inf"), float("-inf"), 1.0, -2.5]
    values += [struct.unpack("<d", struct.pack("<Q", rng.getrandbits(64)))[0] for _ in range(500)]
    values = [v for v in values if v == v]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", stats.order_code(F.col("v")).alias("c")).collect()
    for r in got:
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.c == (0 if r.v == 0 else bits if r.v > 0 else -1 - bits)


def test_select_ranks_with_ties_negatives_and_a_hot_key(spark):
    rng = np.random.default_rng(5)
    keys = np.where(rng.random(20_000) < 0.8, "hot", np.where(rng.random(20_000) < 0.5, "a", "b"))
    values = np.round(rng.normal(0, 1e3, 20_000)) * rng.choice([1.0, 1e-300, 1e300], 20_000)
    data = pd.DataFrame({"k": keys, "_v": values})
    df = spark.createDataFrame(data).repartition(6)
    wanted = [(k, j, r) for k, g in data.groupby("k") for j, r in enumerate([0, len(g) // 3, len(g) - 1, len(g) // 2])]
    got = {(r.k, r._j): r._value for r in stats.select_ranks(df, ["k"], spark.createDataFrame(wanted, "k string, _j int, _r long")).collect()}
    for k, j, r in wanted:
        assert got[(k, j)] == sorted(data[data.k == k]._v)[r]
    bounded = stats.select_ranks(df, ["k"], spark.createDataFrame(wanted, "k string, _j int, _r long"), bounded_keys=3).collect()
    assert {(r.k, r._j): r._value for r in bounded} == got


def test_column_profile_quartiles(spark):
    data = pd.DataFrame({"a": [1.0, None, 3.0, 4.0, 10.0], "b": [None] * 5})
    df = spark.createDataFrame([(a, None) for a in (1.0, None, 3.0, 4.0, 10.0)], "a double, b double")
    got = {r.column: r for r in stats.column_profile(df, ["a", "b"]).collect()}
    assert [got["a"].q1, got["a"].median, got["a"].q3] == data.a.dropna().quantile([0.25, 0.5, 0.75]).tolist()
    assert got["b"].q1 is None and got["b"].rows == 5 and got["b"].nulls == 5


def test_interval_labels_by_change_points_equal_day_by_day(spark):
    rng = random.Random(4)
    base = dt.date(2024, 1, 1)
    blocks, rows = [], []
    for athlete in ("hot", "a", "b"):
        for b in range(60 if athlete == "hot" else 5):
            start = base + dt.timedelta(days=rng.randint(0, 300))
            blocks.append((athlete, f"B{b % 7}", rng.randint(1, 3), start, start + dt.timedelta(days=rng.randint(-2, 40))))
        rows += [(athlete, base + dt.timedelta(days=d)) for d in range(-5, 360, 3)]
    blocks.append(("a", "Same", 2, base, base))
    blocks.append(("a", "Samf", 2, base, base))
    bdf = spark.createDataFrame(blocks, "athlete_id string, block_name string, priority int, start_date date, end_date date")
    got = {(r.athlete_id, r.date): r.marathon_block for r in temporal.label_intervals(
        spark.createDataFrame(rows, "athlete_id string, date date"), bdf).collect()}
    for athlete, day_ in rows:
        holding = [(p, n) for a, n, p, s, e in blocks if a == athlete and s <= day_ <= e]
        assert got[(athlete, day_)] == (max(holding)[1] if holding else "Outside marathon blocks")


def test_box_statistics_compute_their_input_once(spark, tmp_path):
    """Every further reading of the input would run its shuffle again."""
    spark.sparkContext.setCheckpointDir(str(tmp_path / "shared"))
    df = spark.range(0, 90).selectExpr("id % 2 as g", "id as v").groupBy("v").agg(F.max("g").alias("g"))
    out = stats.box_statistics(df, ["g"], "v")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 90") == 0
    assert [(r.g, r.q1, r["median"], r.q3, r.whisker_low, r.whisker_high, r.outliers) for r in out.orderBy("g").collect()] == [
        (0, 22.0, 44.0, 66.0, 0, 88, 0), (1, 23.0, 45.0, 67.0, 1, 89, 0)]
