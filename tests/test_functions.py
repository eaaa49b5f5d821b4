"""Scalar functions against literal values, with one test per known pitfall."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from strideframe.functions import columns as X


def values(spark, ddl, rows, *exprs):
    df = spark.createDataFrame(rows, ddl).coalesce(1)
    return [tuple(r) for r in df.select(*[e.alias(f"c{i}") for i, e in enumerate(exprs)]).collect()]


def test_pace(spark):
    got = values(spark, "s double", [(3.0,), (0.0,), (-1.0,), (None,), (float("nan"),), (26.8224,), (4.4711,)],
                 X.pace_label("s"), X.pace_label("s", "km"))
    assert got == [("8:56", "5:33"), (None, None), (None, None), (None, None), (None, None),
                   ("1:00", "0:37"), ("6:00", "3:44")]  # 5:59.9 carries into the minute


def test_clock_text(spark):
    got = values(spark, "s double", [(0.5,), (1.5,), (59.5,), (3600.0,), (360000.0,), (None,)],
                 X.seconds_to_hms("s"))
    assert [g[0] for g in got] == ["00:00:00", "00:00:02", "00:01:00", "01:00:00", "100:00:00", None]
    got = values(spark, "m double", [(0.15,), (59.999,), (164.48,), (None,)], X.minutes_label("m"))
    assert [g[0] for g in got] == ["0:09", "1:00:00", "2:44:29", "N/A"]


def test_prediction_minutes(spark):
    got = values(spark, "p string", [("02:30:30",), ("150.5",), ("x",), ("1:2",), (None,)],
                 X.prediction_minutes("p"))
    assert [g[0] for g in got] == [150.5, 150.5, None, None, None]


def test_ties_round_to_even_in_labels(spark):
    got = values(spark, "x double", [(2.25,), (0.15,), (2.35,), (1234.56,), (-0.25,), (None,)],
                 X.fixed_text("x"), X.signed_text("x"), X.distance_label("x"))
    assert got == [("2.2", "+2.2", "2.2 mi"), ("0.1", "+0.1", "0.1 mi"), ("2.4", "+2.4", "2.4 mi"),
                   ("1234.6", "+1234.6", "1,234.6 mi"), ("-0.2", "-0.2", "-0.2 mi"), (None, None, "N/A")]


def test_calendar_dates(spark):
    day = dt.date(2024, 6, 19)
    got = values(spark, "d string", [("1718755200000",), ("2024-06-19",), ("2024-06-19T23:59:59.9",),
                                     ("bad",), (None,)], X.calendar_date("d"))
    assert [g[0] for g in got] == [day, day, day, None, None]


def test_local_time_ignores_the_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = values(spark, "m double", [(1718755200123.0,)], X.epoch_ms_to_timestamp("m"),
                     X.epoch_ms_to_date("m"), X.calendar_date("m"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert got == [(dt.datetime(2024, 6, 19, 0, 0, 0, 123000), dt.date(2024, 6, 19), dt.date(2024, 6, 19))]


def test_error_classes(spark):
    got = values(spark, "e double", [(-0.1,), (0.0,), (2.1,), (-2.1,), (2.0,), (None,)],
                 X.error_sign("e"), X.error_bias("e"))
    assert got == [("optimistic", "neutral"), ("neutral", "neutral"), ("conservative", "conservative"),
                   ("optimistic", "optimistic"), ("conservative", "neutral"), ("neutral", "neutral")]


def test_labels_and_lookups(spark):
    got = values(spark, "t string", [("half",), ("MARATHON",), ("ultra",), (None,)],
                 X.standard_distance_miles("t"), X.upper_label("t"))
    assert got == [(13.1094, "HALF"), (26.2188, "MARATHON"), (None, "ULTRA"), (None, "RACE")]
    got = values(spark, "d date", [(dt.date(2025, 11, 8),), (None,)], X.date_label("d"))
    assert [g[0] for g in got] == ["Nov 08, 2025", "N/A"]
    assert values(spark, "b string", [("Cedar Marathon",)], X.short_block_name("b"), X.first_word("b"),
                  X.title_label(F.lower("b"))) == [("Cedar", "cedar", "Cedar Marathon")]


def test_nan_and_sentinels(spark):
    df = spark.createDataFrame([(float("nan"), 511.0), (1.0, 50.0)], "x double, h double")
    row = X.nan_to_null(df).agg(F.avg("x"), F.avg(X.null_if("h", 511.0))).first()
    assert tuple(row) == (1.0, 50.0)


def test_route_chord_and_radius(spark):
    ddl = "startLatitude double, startLongitude double, endLatitude double, endLongitude double, d double"
    got = values(spark, ddl, [(1.0, 2.0, 1.0, 2.0, 4.0), (1.0, 2.0, 1.000001, 2.0, None), (1.0, 2.0, 1.1, 2.0, 0.1),
                              (1.0, 2.0, None, 2.0, 9.0)], X.has_route_chord(), X.marker_radius("d"))
    assert [g[0] for g in got] == [False, False, True, False]
    assert [g[1] for g in got] == pytest.approx([240.0, 0.2 ** 0.5 * 120, 0.2 ** 0.5 * 120, 360.0])


def test_race_report_text(spark):
    ddl = ("prediction_error double, prediction_bias string, days_stable_before_race bigint, "
           "peak_weekly_mileage double, avg_weekly_mileage double, vo2_drift double, avg_readiness double, avg_hrv double")
    got = values(spark, ddl, [(-4.25, "optimistic", 12, 70.04, 50.25, -1.25, 61.0, None)], X.race_report("mi", "The watch"))
    assert got[0][0] == (
        "Volume: 50.2 mi a week, 70.0 mi at most | Readiness: 61.0 | HRV: N/A | VO2 change: -1.2 | "
        "Forecast of The watch: 4.2 min too fast | Days settled: 12")
