"""The training schema read out of the star-schema tables.

The given `events` table stands in for a device export: a user is an athlete and each
event feeds one or more families. The mapping is plain SQL text that both Spark and the
checking engine evaluate, so that registered queries run the library's own code over whole
tables. Literals such as 3e0 are doubles in both dialects.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from strideframe.functions import columns as X

_ZONES = {**{f"hrTimeInZone_{i}": f"value * {i}e3" for i in range(1, 7)},
          **{f"powerTimeInZone_{i}": f"k * {i}e3" for i in range(1, 6)}}

# family -> (event types that have measures, {column: SQL text}); other events give rows of NULL measures
FAMILIES: dict[str, tuple[str, dict[str, str]]] = {
    "activities": ("", {
        "activityId": "event_id",
        "activityType": "CASE WHEN event_type IN ('click', 'view', 'signup') THEN 'running' "
                        "WHEN event_type = 'purchase' THEN 'treadmill_running' ELSE 'cycling' END",
        "name": "CASE WHEN k % 8 = 0 THEN NULL ELSE 'Run ' || CAST(k % 8 AS STRING) END",
        "locationName": "CASE WHEN k % 6 = 0 THEN NULL ELSE 'Town ' || CAST(k % 6 AS STRING) END",
        "duration": "(20e0 + value) * 60000e0",
        "elapsedDuration": "(21e0 + value) * 60000e0",
        "movingDuration": "(20e0 + value) * 57000e0",
        "distance": "CASE WHEN k % 13 = 0 THEN NULL ELSE (3e0 + value / 10e0) * 100000e0 END",
        "elevationGain": "k * 100e0",
        "elevationLoss": "k * 90e0",
        "maxSpeed": "(3e0 + k / 50e0) / 10e0",
        "avgSpeed": "CASE WHEN k % 17 = 0 THEN 0e0 WHEN k % 19 = 0 THEN NULL "
                    "ELSE (2e0 + k / 60e0) / 10e0 END",
        "avgStrideLength": "90e0 + k / 7e0",
        "avgHr": "CASE WHEN k % 10 = 0 THEN NULL ELSE 120e0 + k / 3e0 END",
        "maxHr": "150e0 + k",
        "avgPower": "CASE WHEN k % 4 = 0 THEN NULL ELSE 200e0 + k / 3e0 END",
        "maxPower": "250e0 + k",
        "avgDoubleCadence": "160e0 + k / 7e0",
        "activityTrainingLoad": "CASE WHEN k % 12 = 0 THEN NULL ELSE value / 3.017331e0 END",
        "aerobicTrainingEffect": "k / 21e0",
        "anaerobicTrainingEffect": "k / 33e0",
        "pr": "k % 9 = 0",
        "vO2MaxValue": "45e0 + k / 11e0",
        "startLatitude": "CASE WHEN k % 11 = 0 THEN NULL ELSE user_id % 60 - 30e0 + value / 299.7173e0 END",
        "startLongitude": "user_id % 100 - 50e0 + k / 30e0",
        "endLatitude": "CASE WHEN k % 11 = 0 OR k % 7 = 0 THEN NULL "
                       "WHEN k % 5 = 0 THEN user_id % 60 - 30e0 + value / 299.7173e0 "
                       "ELSE user_id % 60 - 30e0 + value / 289.7173e0 END",
        "endLongitude": "CASE WHEN k % 7 = 0 THEN NULL ELSE user_id % 100 - 50e0 + k / 30e0 END",
        **_ZONES,
    }),
    "metrics": ("'click', 'error', 'purchase'", {
        "acwrPercent": "value",
        "acwrStatus": "CASE k % 4 WHEN 0 THEN 'OPTIMAL' WHEN 1 THEN 'HIGH' WHEN 2 THEN 'LOW' END",
        "acwrStatusFeedback": "'FEEDBACK_' || CAST(k % 5 AS STRING)",
        "dailyTrainingLoadAcute": "100e0 + value",
        "dailyTrainingLoadChronic": "120e0 + k * 1.0131170737e0",
        "dailyAcuteChronicWorkloadRatio": "(100e0 + value) / (120e0 + k * 1.0131170737e0)",
    }),
    "predictions": ("'view', 'purchase', 'error', 'click'", {
        "raceTime5K": "CASE WHEN k % 12 = 0 THEN NULL ELSE 1200e0 + k * 1.5e0 END",
        "raceTime10K": "2500e0 + k * 3e0",
        "raceTimeHalf": "5500e0 + k * 6.1e0",
        "raceTimeMarathon": "CASE WHEN k % 15 = 0 THEN NULL ELSE 11400e0 + k * 2.2e0 END",
    }),
    "readiness": ("", {
        "score": "CASE WHEN event_type = 'error' THEN NULL ELSE k * 1.0031170737e0 END",
        "level": "CASE WHEN k % 5 = 0 THEN NULL WHEN k < 30 THEN 'LOW' "
                 "WHEN k < 70 THEN 'MODERATE' ELSE 'HIGH' END",
        "recoveryTime": "CASE WHEN k % 6 = 0 THEN NULL ELSE value * 10e0 END",
        "acuteLoad": "100e0 + value",
        "hrvWeeklyAverage": "CASE WHEN k % 20 = 0 THEN 511e0 WHEN k % 7 = 0 THEN NULL "
                            "ELSE 40e0 + k * 0.3173110737e0 END",
        "sleepScore": "CASE WHEN k % 3 = 0 THEN NULL ELSE 50e0 + k / 3e0 END",
        "validSleep": "CASE WHEN k % 4 = 0 THEN NULL ELSE k % 2 = 0 END",
    }),
    "maxmet": ("'signup', 'click'", {
        "vo2MaxValue": "CASE WHEN k % 8 = 0 THEN NULL ELSE 45e0 + k / 7e0 END",
        "fitnessAge": "20e0 + k / 3e0",
        "fitnessAgeDescription": "'AGE_' || CAST(k % 3 AS STRING)",
        "maxMet": "12e0 + k / 30e0",
        "sport": "CASE WHEN k % 5 = 0 THEN NULL WHEN k % 2 = 0 THEN 'RUNNING' ELSE 'CYCLING' END",
        "deviceId": "CAST(k AS STRING)",
    }),
    "history": ("'view', 'purchase'", {
        "loadTunnelMin": "value",
        "loadTunnelMax": "value + k",
        "weeklyTrainingLoadSum": "value * 3e0",
        "trainingStatus": "CASE k % 6 WHEN 0 THEN 'PRODUCTIVE' WHEN 1 THEN 'PEAKING' "
                          "WHEN 2 THEN 'RECOVERY' WHEN 3 THEN 'STRAINED' WHEN 4 THEN 'MAINTAINING' END",
        "fitnessLevelTrend": "CASE k % 3 WHEN 0 THEN 'UP' WHEN 1 THEN 'DOWN' END",
        "loadLevelTrend": "CASE k % 4 WHEN 0 THEN 'RISING' WHEN 1 THEN 'FALLING' END",
        "userProfilePK": "CAST(user_id AS STRING)",
        "deviceId": "CAST(k AS STRING)",
    }),
}
SOURCE_FILE = "'part_' || CAST(k % 3 AS STRING)"

_RACE_TYPE = ("CASE WHEN k % 24 < 8 THEN 'marathon' WHEN k % 24 < 12 THEN 'half' "
              "WHEN k % 24 < 16 THEN '10k' WHEN k % 24 < 20 THEN '5k' END")
CALENDAR = {
    "event_type": "CASE WHEN event_type = 'purchase' THEN 'race' "
                  "WHEN event_type = 'signup' THEN 'training_block_start' ELSE 'rest' END",
    "label": "CASE WHEN event_type = 'error' THEN 'Rest' ELSE "
             "(CASE WHEN (k + 4 * user_id) % 16 < 4 THEN 'Alder' WHEN (k + 4 * user_id) % 16 < 8 THEN 'Birch' "
             "WHEN (k + 4 * user_id) % 16 < 12 THEN 'Cedar' ELSE 'Dogwood' END) || "
             "(CASE WHEN event_type = 'purchase' THEN ' Marathon' ELSE ' Build' END) END",
    "official_time_min": "CASE WHEN event_type <> 'purchase' OR (user_id + k) % 7 = 0 THEN NULL "
                         "WHEN k % 24 < 8 THEN 190e0 + value / 23e0 "
                         "WHEN k % 24 < 12 THEN 91e0 + value / 53e0 "
                         "WHEN k % 24 < 16 THEN 41e0 + value / 53e0 "
                         "WHEN k % 24 < 20 THEN 20e0 + value / 97e0 ELSE 60e0 + value END",
    "race_type": f"CASE WHEN event_type = 'purchase' THEN {_RACE_TYPE} END",
}
# a calendar holds the events that are entries of one; clicks and views are none
CALENDAR_ROWS = "event_type IN ('purchase', 'signup', 'error')"



def _measures(name: str) -> dict[str, str]:
    kinds, columns = FAMILIES[name]
    return {c: f"CASE WHEN event_type IN ({kinds}) THEN {sql} END" for c, sql in columns.items()} if kinds else columns


# (name, first day, last day, priority); neighbouring blocks overlap.
BLOCKS = (
    ("Alder Marathon", "2024-01-02", "2024-01-12", 1),
    ("Birch Marathon", "2024-01-10", "2024-01-21", 2),
    ("Cedar Marathon", "2024-01-20", "2024-01-29", 3),
)


class Warehouse:
    """The training tables of one data directory, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._frames: dict[str, DataFrame] = {}

    def once(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The DataFrame of this name, built on first use: building a plan has a cost too."""
        if name not in self._frames:
            self._frames[name] = build()
        return self._frames[name]

    def table(self, name: str) -> DataFrame:
        return self.once(name, lambda: self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet"))

    def events(self) -> DataFrame:
        return self.once("mapped events", self._mapped_events)

    def _mapped_events(self) -> DataFrame:
        return self.table("events").select(
            "event_id", "user_id", F.col("user_id").cast("string").alias("athlete_id"),
            F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("ts").cast("date").alias("date"),
            "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))

    def family(self, name: str) -> DataFrame:
        """Raw rows of one family, as the readers deliver them."""
        rows, columns = self.events(), _measures(name)
        day = F.datediff("date", F.lit("1970-01-01").cast("date")) * F.lit(86_400_000).cast("bigint")
        millis = (day + F.hour("ts") * 3_600_000 + F.minute("ts") * 60_000
                  + F.floor(F.date_part(F.lit("SECOND"), "ts") * 1000))
        extra = {}
        if name == "activities":
            extra["startTimeLocal"] = millis.cast("double")
        else:
            text = F.when(F.col("k") % 2 == 0, day.cast("string")).otherwise(F.col("date").cast("string"))
            extra["calendarDate"] = text
        if name == "readiness":
            extra["timestampLocal"] = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
        raw = rows.select("athlete_id", F.expr(SOURCE_FILE).alias("source_file"),
                          *[F.expr(sql).alias(c) for c, sql in columns.items()],
                          *[expr.alias(c) for c, expr in extra.items()])
        return raw if name == "activities" else raw.withColumn("date", X.calendar_date("calendarDate"))

    def raw(self) -> dict[str, DataFrame]:
        return {name: self.family(name) for name in FAMILIES}

    def calendar(self) -> DataFrame:
        return self.events().where(CALENDAR_ROWS).select(
            "athlete_id", "date", *[F.expr(sql).alias(c) for c, sql in CALENDAR.items()])

    def blocks(self) -> DataFrame:
        spans = F.array(*[
            F.struct(F.lit(n).alias("block_name"), F.lit(a).cast("date").alias("start_date"),
                     F.lit(b).cast("date").alias("end_date"), F.lit(p).cast("bigint").alias("priority"))
            for n, a, b, p in BLOCKS])
        return self.events().select("athlete_id").distinct().select("athlete_id", F.inline(spans))


# --- the same tables as common table expressions for the checking engine --------------

def _columns(columns: dict[str, str]) -> str:
    return ", ".join(f'{sql} AS "{name}"' for name, sql in columns.items())


def _family_sql(name: str) -> str:
    return f"SELECT athlete_id, {SOURCE_FILE} AS source_file, ts, date, {_columns(_measures(name))} FROM ev"


BASE_CTES = {
    "ev": ("SELECT event_id, user_id, CAST(user_id AS VARCHAR) AS athlete_id, ts, "
           "CAST(ts AS DATE) AS date, event_type, value, "
           "CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events"),
    **{f"raw_{name}": _family_sql(name) for name in FAMILIES},
    "cal": f"SELECT athlete_id, date, {_columns(CALENDAR)} FROM ev WHERE {CALENDAR_ROWS}",
    "blocks": (
        "SELECT a.athlete_id, b.* FROM (SELECT DISTINCT athlete_id FROM ev) AS a CROSS JOIN (VALUES "
        + ", ".join(f"('{n}', DATE '{a}', DATE '{b}', {p})" for n, a, b, p in BLOCKS)
        + ") AS b(block_name, start_date, end_date, priority)"),
}
