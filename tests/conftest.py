import json
import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]").appName("strideframe-tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
        .getOrCreate())
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


DAY_MS = 86_400_000
EPOCH_2024_06_19 = 1_718_755_200_000


def activity(i, **fields):
    base = {
        "activityId": i, "activityType": "running", "name": f"Run {i}", "locationName": "Town",
        "startTimeLocal": EPOCH_2024_06_19 + 7 * 3_600_000, "duration": 3_600_000.0,
        "elapsedDuration": 3_700_000.0, "movingDuration": 3_500_000.0, "distance": 1_609_344.0,
        "elevationGain": 12_300.0, "elevationLoss": 4_500.0, "maxSpeed": 0.5, "avgSpeed": 0.3,
        "avgStrideLength": 110.0, "avgHr": 150.0, "maxHr": 175.0, "activityTrainingLoad": 80.0,
        "aerobicTrainingEffect": 3.0, "anaerobicTrainingEffect": 1.0, "pr": False,
        "hrTimeInZone_1": 60_000.0, "powerTimeInZone_5": 120_000.0}
    return {**base, **fields}


@pytest.fixture()
def export(tmp_path):
    """Two athletes with equal dates, odd files and every edge row the readers must bear."""
    root = tmp_path / "raw export"

    def put(path, content):
        target = root / path
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(content if isinstance(content, str) else json.dumps(content))

    put("001/wellness/a_0_summarizedActivities.json", [{"summarizedActivitiesExport": [
        activity(1), activity(2, pr=True, avgSpeed=0.0, avgHr=None),
        activity(3, activityType="treadmill_running"),
        activity(4, startTimeLocal=EPOCH_2024_06_19 + 2 * DAY_MS, avgSpeed=None),
    ]}])
    put("001/wellness/b_summarizedActivities.json", '[{"summarizedActivitiesExport": [{"activ')
    put("001/wellness/c_summarizedActivities.json", [])
    put("bob+1/x_summarizedActivities.json", {"summarizedActivitiesExport": [
        activity(1, distance=500_000.0)]})
    put("001/metrics/MetricsAcuteTrainingLoad_1.json", [
        {"calendarDate": EPOCH_2024_06_19, "acwrPercent": 10, "acwrStatus": "OPTIMAL"},
        {"calendarDate": EPOCH_2024_06_19, "acwrPercent": 20, "acwrStatus": "HIGH"}])
    put("001/metrics/MetricsAcuteTrainingLoad_2.json", [
        {"calendarDate": "2024-06-19", "acwrPercent": 30, "acwrStatus": "LOW"}])
    put("001/metrics/RunRacePredictions_1.json", [
        {"calendarDate": "2024-06-19", "raceTime5K": 1200, "raceTime10K": 2500.5,
         "raceTimeHalf": 5400, "raceTimeMarathon": 11400}])
    put("001/metrics/RunRacePredictions_2.json", [
        {"calendarDate": "2024-06-19T00:00:00.0", "raceTime5K": 1190, "raceTime10K": None,
         "raceTimeHalf": 5400, "raceTimeMarathon": 360000}])
    put("001/metrics/TrainingReadinessDTO_1.json", [
        {"calendarDate": "2024-06-19", "timestampLocal": "2024-06-19T06:00:00.0", "score": None,
         "level": "LOW", "hrvWeeklyAverage": 511, "validSleep": False},
        {"calendarDate": "2024-06-19", "timestampLocal": "2024-06-19T09:00:00.0", "score": 60,
         "level": "MODERATE", "recoveryTime": 600, "validSleep": True},
        {"calendarDate": "2024-06-19", "timestampLocal": "2024-06-19T20:00:00.0", "score": 40,
         "level": None, "recoveryTime": None}])
    put("001/metrics/MetricsMaxMetData_1.json", [
        {"calendarDate": "2024-06-19", "vo2MaxValue": 55.0, "maxMet": 15.7, "deviceId": 9}])
    put("001/metrics/TrainingHistory_1.json", [
        {"calendarDate": "2024-06-19", "trainingStatus": "PRODUCTIVE", "loadTunnelMin": 100},
        {"calendarDate": "bad", "trainingStatus": "PEAKING", "loadTunnelMin": 50}])
    put("001/metrics/unrelated.json", [{"calendarDate": "2024-06-19"}])
    put("stray_summarizedActivities.json", {"summarizedActivitiesExport": [activity(99)]})
    return str(root)
