"""Explicit read schemas: an absent JSON field reads as NULL and no inference pass is needed."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(spec: str) -> T.StructType:
    """Fields as `name type, name type`; readable before a session exists."""
    fields = T.StructType()
    for field in spec.split(","):
        name, kind = field.split()
        fields = fields.add(name, kind)
    return fields


_ZONES = ", ".join([f"hrTimeInZone_{i} double" for i in range(1, 7)]
                   + [f"powerTimeInZone_{i} double" for i in range(1, 6)])

ACTIVITY = _struct(f"""
    activityId long, activityType string, name string, locationName string,
    startTimeLocal double, duration double, elapsedDuration double, movingDuration double,
    distance double, elevationGain double, elevationLoss double, maxSpeed double,
    avgSpeed double, avgStrideLength double, avgHr double, maxHr double, avgPower double,
    maxPower double, avgDoubleCadence double, activityTrainingLoad double,
    aerobicTrainingEffect double, anaerobicTrainingEffect double, pr boolean,
    vO2MaxValue double, startLatitude double, startLongitude double, endLatitude double,
    endLongitude double, {_ZONES}""")

# calendarDate is read as text: files hold either epoch milliseconds or ISO dates.
DAILY = {
    "metrics": _struct("""
        calendarDate string, acwrPercent double, acwrStatus string, acwrStatusFeedback string,
        dailyTrainingLoadAcute double, dailyTrainingLoadChronic double,
        dailyAcuteChronicWorkloadRatio double"""),
    "predictions": _struct("""
        calendarDate string, raceTime5K double, raceTime10K double, raceTimeHalf double,
        raceTimeMarathon double"""),
    "readiness": _struct("""
        calendarDate string, timestampLocal string, timestamp string, score double,
        level string, recoveryTime double, acuteLoad double, hrvWeeklyAverage double,
        sleepScore double, validSleep boolean"""),
    "maxmet": _struct("""
        calendarDate string, vo2MaxValue double, fitnessAge double,
        fitnessAgeDescription string, maxMet double, sport string, deviceId string"""),
    "history": _struct("""
        calendarDate string, loadTunnelMin double, loadTunnelMax double,
        weeklyTrainingLoadSum double, trainingStatus string, fitnessLevelTrend string,
        loadLevelTrend string, userProfilePK string, deviceId string"""),
}

EVENTS_CSV = _struct(
    "date string, event_type string, label string, official_time_min double, race_type string")


def activities_file(extra: T.StructType | None = None) -> T.StructType:
    fields = T.StructType(ACTIVITY.fields + (extra.fields if extra else []))
    return T.StructType([T.StructField("summarizedActivitiesExport", T.ArrayType(fields))])
