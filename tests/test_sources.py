"""Readers and sinks on hand-made files."""

import datetime as dt

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from strideframe.plans import athlete_tables
from strideframe.sources import readers, writers

DAY = dt.date(2024, 6, 19)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def test_files_are_routed_by_name(spark, export):
    files = readers.list_files(spark, export).where("athlete_id = '001'")
    found = {r.source_file: r.family for r in files.collect()}
    assert found["a_0_summarizedActivities.json"] == "activities"
    assert found["MetricsAcuteTrainingLoad_1.json"] == "metrics"
    assert found["MetricsMaxMetData_1.json"] == "maxmet"
    assert found["RunRacePredictions_1.json"] == "predictions"
    assert found["TrainingReadinessDTO_1.json"] == "readiness"
    assert found["TrainingHistory_1.json"] == "history"
    assert found["unrelated.json"] is None


def test_first_matching_rule_wins(spark):
    names = ["metrics_summarizedActivities.json", "metricsmaxmetdata.json", "Metrics.json"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    assert [r[0] for r in df.select(readers.family_of(F.col("n"))).collect()] == [
        "activities", "maxmet", "metrics"]


def test_activities_are_flattened_with_lineage_and_rejects(spark, export):
    good, bad = readers.read_activities(spark, export)
    assert rows(good.select("athlete_id", "source_file", "activityId"), "athlete_id", "activityId") == [
        ("001", "a_0_summarizedActivities.json", 1), ("001", "a_0_summarizedActivities.json", 2),
        ("001", "a_0_summarizedActivities.json", 3), ("001", "a_0_summarizedActivities.json", 4),
        ("bob+1", "x_summarizedActivities.json", 1)]
    assert rows(bad.select("athlete_id", "source_file", "reason"), "source_file") == [
        ("001", "b_summarizedActivities.json", "malformed JSON")]


def test_athlete_filter_and_single_layout(spark, export):
    one, _ = readers.read_activities(spark, export, athlete_ids=["bob+1"])
    assert one.count() == 1
    single, _ = readers.read_activities(spark, f"{export}/001", layout="single")
    assert single.select("athlete_id").distinct().collect()[0][0] == "001"
    with pytest.raises(ValueError):
        readers.read_activities(spark, export, layout="other")


def test_daily_master_from_export(spark, export):
    raw = readers.read_export(spark, export)
    tables = athlete_tables.build_tables(raw)
    master = tables["daily_master"]
    by = {(r.athlete_id, r.date): r for r in master.collect()}
    assert set(by) == {("001", DAY), ("001", dt.date(2024, 6, 21)), ("bob+1", DAY)}
    day = by["001", DAY]
    assert (day.run_count, day.pr_count) == (2, 1)
    assert day.total_distance_miles == pytest.approx(20.0)
    assert day.avg_pace_mile == pytest.approx(26.8224 / 1.5)
    assert day.avg_hr == 150.0 and day.avg_power is None
    assert (day.acwrPercent, day.acwrStatus) == (10.0, "OPTIMAL")          # first kept
    assert day["5K_pred"] == "00:19:50" and day["Marathon_pred"] == "100:00:00"  # last kept
    assert day["10K_pred"] is None
    assert (day.readiness_score_first, day.readiness_score_last) == (60.0, 40.0)
    assert (day.readiness_score_mean, day.readiness_snapshots) == (50.0, 2)
    assert (day.readiness_level_last, day.recovery_time_last) == ("MODERATE", 600.0)
    assert day.valid_sleep_any is True and day.vo2MaxValue == 55.0
    assert day.training_status == "PRODUCTIVE" and day.load_tunnel_max is None
    # the other athlete has the same date and none of these sources
    other = by["bob+1", DAY]
    assert other.acwrStatus is None and other.total_distance_km == pytest.approx(5.0)
    assert by["001", dt.date(2024, 6, 21)].avg_pace_mile is None
    series = athlete_tables.analysis_series(master)
    clean_day = [r for r in series.collect() if (r.athlete_id, r.date) == ("001", DAY)][0]
    assert clean_day.hrv_weekly_avg_clean is None
    assert clean_day["Marathon_pred"] == pytest.approx(6000.0)


def test_runs_table_columns(spark, export):
    raw = readers.read_export(spark, export)
    run = athlete_tables.build_tables(raw)["runs"].where("athlete_id='001' and activityId=1").first()
    assert run.start_time == dt.datetime(2024, 6, 19, 7) and run.date == DAY
    assert run.duration_minutes == 60 and run.distance_km == pytest.approx(16.09344)
    assert run.avg_pace_mile == "8:56" and run.max_pace_km == "3:20"
    assert run.hrTimeInZone_1_minutes == 1.0 and run.powerTimeInZone_5_minutes == 2.0
    assert run.hrTimeInZone_2_minutes is None
    assert "startTimeLocal" not in run.asDict()


def test_events_csv_with_fallback(spark, tmp_path):
    path = tmp_path / "calendar.csv"
    path.write_text("date,event_type,label,official_time_min,race_type\n"
                    "11/8/25,race,Cedar Marathon,164.48,marathon\n11/9/25,rest,Rest,,\n")
    events = readers.read_events(spark, str(tmp_path / "none.csv"), str(path), athlete_id="a")
    assert rows(events, "date") == [
        ("a", dt.date(2025, 11, 8), "race", "Cedar Marathon", 164.48, "marathon"),
        ("a", dt.date(2025, 11, 9), "rest", "Rest", None, None)]
    with pytest.raises(AnalysisException):
        readers.read_events(spark, str(tmp_path / "none.csv"), athlete_id="a")


def test_save_tables_and_manifest(spark, export, tmp_path):
    out = str(tmp_path / "out")
    manifest = athlete_tables.process_export(spark, export, out)
    found = {(r.athlete_id, r.dataset): r for r in manifest.collect()}
    runs = found["001", "runs"]
    assert runs.saved and runs.rows == 3 and runs.first_date == DAY
    assert "distance_km" in runs.column_names and runs.columns == len(runs.column_names)
    empty = found["bob+1", "metrics"]
    assert not empty.saved and empty.reason == "DataFrame is empty"
    stored = readers.read_table(spark, f"{out}/runs", ["athlete_id", "activityId"], ["001"])
    assert rows(stored, "activityId") == [("001", 1), ("001", 2), ("001", 4)]
    with pytest.raises(AnalysisException):
        athlete_tables.process_export(spark, export, out, overwrite=False)
    # one athlete again: the other athlete's files stay
    athlete_tables.process_export(spark, export, out, athlete_ids=["bob+1"])
    assert readers.read_table(spark, f"{out}/runs").count() == 4
    bundle = readers.load_bundle(spark, out, ["runs", "daily_master"], cache=["daily_master"])
    assert spark.table("runs").count() == 4 and bundle["daily_master"].is_cached
    bundle["daily_master"].unpersist()


def test_nested_columns_become_text(spark):
    df = spark.sql("select array(1,2) a, array() e, named_struct('x', 1) s, "
                   "map('k', 1) m, cast(null as array<int>) n")
    assert tuple(writers.parquet_safe(df).first()) == ("[1,2]", None, '{"x":1}', '{"k":1}', None)


def test_manifest_reasons(spark):
    runs = spark.createDataFrame([("a", DAY)], "athlete_id string, date date")
    found = {r.dataset: r.reason for r in writers.manifest(
        {"runs": runs, "metrics": None, "history": 3}, {"runs": "/x"}).collect()}
    assert found == {"runs": None, "metrics": "DataFrame is None",
                     "history": "Object is not a DataFrame"}


def test_union_fills_missing_columns(spark):
    a, b = spark.sql("select 1 x, 2 y"), spark.sql("select 3 x")
    assert rows(readers.union_tables(a, b), "x") == [(1, 2), (3, None)]


def test_tables_by_athlete_have_a_bounded_number_of_folders(spark, tmp_path):
    import os
    path = str(tmp_path / "t")
    df = spark.range(400).selectExpr("cast(id as string) as athlete_id", "id as v")
    writers.write_table(df, path)
    assert len([d for d in os.listdir(path) if "=" in d]) <= 64
    # some athletes again, one of them new: the others stay as they are, also in the same folders
    writers.write_table(spark.sql("select '7' as athlete_id, -1L as v union all select '7', -2L union all select 'new', 5L"), path)
    stored = readers.read_table(spark, path)
    assert stored.columns == ["athlete_id", "v"] and stored.count() == 402
    assert rows(stored.where("v < 0 or athlete_id in ('6', '7', 'new')"), "v") == [("7", -2), ("7", -1), ("new", 5), ("6", 6)]
    assert rows(readers.read_table(spark, path, athlete_ids=["7", "9"]), "v") == [("7", -2), ("7", -1), ("9", 9)]
