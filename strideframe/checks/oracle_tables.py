"""The training tables as SQL for the checking engine, and small SQL text helpers."""

from __future__ import annotations

import re

from strideframe.checks.warehouse import BASE_CTES

PREDICTIONS = ("5K", "10K", "Half", "Marathon")
RAW_SECONDS = {"5K": "raceTime5K", "10K": "raceTime10K", "Half": "raceTimeHalf",
               "Marathon": "raceTimeMarathon"}
WINDOWS = (7, 15, 30)


def pace(speed: str, metres: str) -> str:
    p = f"({metres} / {speed} / 60)"
    total = f"CAST(floor({p}) * 60 + round_even(({p} - floor({p})) * 60, 0) AS BIGINT)"
    return f"CASE WHEN {speed} > 0 THEN printf('%d:%02d', {total} // 60, {total} % 60) END"


def hms(seconds: str) -> str:
    t = f"CAST(round_even({seconds}, 0) AS BIGINT)"
    return (f"CASE WHEN {seconds} IS NOT NULL THEN "
            f"printf('%02d:%02d:%02d', {t} // 3600, ({t} % 3600) // 60, {t} % 60) END")


def clock(minutes: str) -> str:
    t = f"CAST(round_even(({minutes}) * 60, 0) AS BIGINT)"
    return (f"CASE WHEN ({minutes}) IS NULL THEN 'N/A' WHEN {t} // 3600 > 0 THEN "
            f"printf('%d:%02d:%02d', {t} // 3600, ({t} % 3600) // 60, {t} % 60) "
            f"ELSE printf('%d:%02d', ({t} % 3600) // 60, {t} % 60) END")


def minutes_of(text: str) -> str:
    h, m, s = (f"CAST(split_part({text}, ':', {i}) AS DOUBLE)" for i in (1, 2, 3))
    return f"CASE WHEN {text} IS NOT NULL THEN ({h} * 3600 + {m} * 60 + {s}) / 60 END"


def day_label(date: str) -> str:
    return f"coalesce(strftime({date}, '%b %d, %Y'), 'N/A')"


def fixed(value: str, decimals: int = 1) -> str:
    return f"format('{{:.{decimals}f}}', {value})"


def grouped(value: str) -> str:
    return f"format('{{:,.1f}}', {value})"


def distance(miles: str) -> str:
    return f"CASE WHEN {miles} IS NULL THEN 'N/A' ELSE {grouped(miles)} || ' mi' END"


def signed(value: str) -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN (CASE WHEN {value} >= 0 THEN '+' ELSE '' END) || {fixed(value)} END"


def week_end(date: str, last: str = "SUN") -> str:
    """ISO weekday of the last day: SUN is 7, MON is 1."""
    n = {"SUN": 7, "MON": 1}[last]
    return f"CAST({date} + CAST((({n} - isodow({date})) % 7 + 7) % 7 AS INTEGER) AS DATE)"


def filled(source: str, keys: str, end: str, value: str, step: str = "7 DAY") -> str:
    """Totals per key and period with the empty periods between as zero."""
    on = " AND ".join([f"s.{k} = t.{k}" for k in keys.split(", ") if k] + ["s.p = t.p"])
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    picked = "".join(f"s.{k}, " for k in keys.split(", ") if k)
    if step == "1 MONTH":
        span = ("unnest(generate_series(CAST(date_trunc('month', min(p)) AS TIMESTAMP), "
                "CAST(max(p) AS TIMESTAMP), INTERVAL 1 MONTH))")
        spine = f"SELECT {lead}last_day(CAST(x AS DATE)) AS p FROM (SELECT {lead}{span} AS x FROM tot {group})"
    else:
        span = (f"unnest(generate_series(CAST(min(p) AS TIMESTAMP), CAST(max(p) AS TIMESTAMP), "
                f"INTERVAL {step}))")
        spine = f"SELECT {lead}CAST(x AS DATE) AS p FROM (SELECT {lead}{span} AS x FROM tot {group})"
    return (f"WITH tot AS (SELECT {lead}{end} AS p, coalesce(sum({value}), 0) AS v FROM {source} "
            f"GROUP BY ALL), spine AS ({spine}) "
            f"SELECT {picked}s.p, coalesce(t.v, 0e0) AS v FROM spine AS s LEFT JOIN tot AS t ON {on}")


def first_by(table: str, order: str, pick: str = "first") -> str:
    """One row per athlete and date; NULL orders below every value."""
    way = "ASC NULLS FIRST" if pick == "first" else "DESC NULLS LAST"
    terms = ", ".join(f"{c.strip()} {way}" for c in order.split(","))
    return (f"SELECT * FROM {table} QUALIFY row_number() OVER "
            f"(PARTITION BY athlete_id, date ORDER BY {terms}) = 1")


def _history_last(column: str, pick: str = "max") -> str:
    order = ("source_file || '!' || coalesce(trainingStatus, '') || '!' || "
             "coalesce(fitnessLevelTrend, '') || '!' || coalesce(loadLevelTrend, '')")
    return f"arg_{pick}({column}, {order}) FILTER (WHERE {column} IS NOT NULL)"


def _snapshot(column: str, pick: str = "max") -> str:
    return f"arg_{pick}({column}, ts) FILTER (WHERE {column} IS NOT NULL)"


def rolling_std(column: str, rows: int, keys: str = "athlete_id") -> str:
    over = (f"OVER (PARTITION BY {keys} ORDER BY date ROWS BETWEEN {rows - 1} PRECEDING "
            f"AND CURRENT ROW)")
    return f"CASE WHEN count({column}) {over} = {rows} THEN stddev_samp({column}) {over} END"


ROLLING = [f"rolling_std_{n}_{p}d" for p in PREDICTIONS for n in WINDOWS]
_MASTER_RUNS = """
    count(activityId) AS run_count, coalesce(sum(distance_km), 0) AS total_distance_km,
    coalesce(sum(distance_miles), 0) AS total_distance_miles,
    coalesce(sum(duration_minutes), 0) AS total_duration_minutes,
    coalesce(sum(moving_duration_minutes), 0) AS total_moving_minutes,
    coalesce(sum(elevation_gain_m), 0) AS total_elevation_gain_m, avg(avgHr) AS avg_hr,
    max(maxHr) AS max_hr,
    CASE WHEN avg(avg_speed_mps) > 0 THEN 26.8224 / avg(avg_speed_mps) END AS avg_pace_mile,
    avg(avg_stride_length_m) AS avg_stride_length_m,
    coalesce(sum(activityTrainingLoad), 0) AS total_training_load,
    avg(aerobicTrainingEffect) AS aerobic_te_avg, avg(anaerobicTrainingEffect) AS anaerobic_te_avg,
    CAST(coalesce(sum(CAST(pr AS INTEGER)), 0) AS BIGINT) AS pr_count, avg(avgPower) AS avg_power,
    max(maxPower) AS max_power, avg(avgDoubleCadence) AS avg_cadence"""

CTES = {
    **BASE_CTES,
    "runs": f"""
        SELECT *, ts AS start_time, duration / 1000 / 60 AS duration_minutes,
          distance / 100000 AS distance_km, distance / 160934.4 AS distance_miles,
          elevationGain / 100 AS elevation_gain_m, elevationLoss / 100 AS elevation_loss_m,
          maxSpeed * 10 AS max_speed_mps, avgSpeed * 10 AS avg_speed_mps,
          {pace('(maxSpeed * 10)', '1609.34e0')} AS max_pace_mile,
          {pace('(maxSpeed * 10)', '1000e0')} AS max_pace_km,
          {pace('(avgSpeed * 10)', '1609.34e0')} AS avg_pace_mile,
          {pace('(avgSpeed * 10)', '1000e0')} AS avg_pace_km,
          avgStrideLength / 100 AS avg_stride_length_m,
          elapsedDuration / 1000 / 60 AS elapsed_duration_minutes,
          movingDuration / 1000 / 60 AS moving_duration_minutes
        FROM raw_activities WHERE activityType = 'running'""",
    "daily_runs": f"SELECT athlete_id, date, {_MASTER_RUNS} FROM runs GROUP BY athlete_id, date",
    "metrics1": first_by("raw_metrics", "source_file, acwrPercent, acwrStatus, acwrStatusFeedback, "
                         "dailyTrainingLoadAcute, dailyTrainingLoadChronic"),
    "predictions1": "SELECT *, " + ", ".join(f'{hms(RAW_SECONDS[p])} AS "{p}_pred"' for p in PREDICTIONS)
                    + " FROM (" + first_by("raw_predictions", ", ".join(["source_file", *RAW_SECONDS.values()]),
                                           "last") + ")",
    "maxmet1": first_by("raw_maxmet", "source_file, vo2MaxValue, fitnessAge, maxMet, sport", "last"),
    "readiness1": f"""
        SELECT athlete_id, date, {_snapshot('score', 'min')} AS readiness_score_first,
          {_snapshot('score')} AS readiness_score_last, avg(score) AS readiness_score_mean,
          {_snapshot('level')} AS readiness_level_last,
          {_snapshot('recoveryTime')} AS recovery_time_last,
          {_snapshot('acuteLoad')} AS acute_load_last,
          {_snapshot('hrvWeeklyAverage')} AS hrv_weekly_avg_last,
          {_snapshot('sleepScore')} AS sleep_score_last, bool_or(validSleep) AS valid_sleep_any,
          count(score) AS readiness_snapshots
        FROM raw_readiness GROUP BY athlete_id, date""",
    "history1": f"""
        SELECT athlete_id, date, min(loadTunnelMin) AS load_tunnel_min,
          {_history_last('trainingStatus', 'min')} AS training_status_first,
          {_history_last('trainingStatus')} AS training_status_last,
          {_history_last('trainingStatus')} AS training_status,
          {_history_last('fitnessLevelTrend')} AS fitness_level_trend,
          {_history_last('loadLevelTrend')} AS load_level_trend,
          max(loadTunnelMax) AS load_tunnel_max
        FROM raw_history GROUP BY athlete_id, date""",
    "master": """
        SELECT d.*, m.acwrPercent, m.acwrStatus, m.acwrStatusFeedback, m.dailyTrainingLoadAcute,
          m.dailyTrainingLoadChronic, m.dailyAcuteChronicWorkloadRatio,
          p."5K_pred", p."10K_pred", p."Half_pred", p."Marathon_pred",
          x.vo2MaxValue, x.fitnessAge, x.fitnessAgeDescription, x.maxMet,
          r.* EXCLUDE (athlete_id, date), h.* EXCLUDE (athlete_id, date)
        FROM daily_runs AS d
        LEFT JOIN metrics1 AS m USING (athlete_id, date)
        LEFT JOIN predictions1 AS p USING (athlete_id, date)
        LEFT JOIN maxmet1 AS x USING (athlete_id, date)
        LEFT JOIN readiness1 AS r USING (athlete_id, date)
        LEFT JOIN history1 AS h USING (athlete_id, date)""",
    "days0": "SELECT * REPLACE (" + ", ".join(
        f'{minutes_of(chr(34) + p + "_pred" + chr(34))} AS "{p}_pred"' for p in PREDICTIONS)
        + "), nullif(hrv_weekly_avg_last, 511) AS hrv_weekly_avg_clean FROM master",
    "days": "SELECT *, " + ", ".join(
        f'{rolling_std(chr(34) + p + "_pred" + chr(34), n)} AS "rolling_std_{n}_{p}d"'
        for p in PREDICTIONS for n in WINDOWS) + " FROM days0",
    "races": "SELECT athlete_id, date AS race_date, label, race_type, official_time_min, "
             "CAST(date - 1 AS DATE) AS prediction_date FROM cal WHERE event_type = 'race'",
    "race_eval0": """
        SELECT r.*, d.date AS prediction_date_matched, d."5K_pred", d."10K_pred", d."Half_pred",
          d."Marathon_pred", CASE r.race_type WHEN '5k' THEN d."5K_pred" WHEN '10k' THEN d."10K_pred"
            WHEN 'half' THEN d."Half_pred" WHEN 'marathon' THEN d."Marathon_pred" END
            AS relevant_prediction, """ + ", ".join(f'd."{c}"' for c in ROLLING) + """
        FROM races AS r ASOF LEFT JOIN days AS d
          ON r.athlete_id = d.athlete_id AND r.prediction_date >= d.date""",
    "race_eval": """
        SELECT *, relevant_prediction - official_time_min AS prediction_error,
          CASE WHEN relevant_prediction - official_time_min < 0 THEN 'optimistic'
            WHEN relevant_prediction - official_time_min > 0 THEN 'conservative'
            ELSE 'neutral' END AS error_category
        FROM race_eval0""",
    "series": """
        SELECT d.*, b.block_name, date_diff('day', min(d.date) OVER (PARTITION BY d.athlete_id,
          b.block_name), d.date) AS days_from_start
        FROM days AS d JOIN blocks AS b
          ON d.athlete_id = b.athlete_id AND d.date BETWEEN b.start_date AND b.end_date""",
    "block_race": """
        SELECT b.athlete_id, b.block_name, r.race_date, r.official_time_min AS actual_time,
          r.relevant_prediction AS final_prediction
        FROM blocks AS b LEFT JOIN race_eval AS r ON b.athlete_id = r.athlete_id
          AND contains(lower(r.label), lower(split_part(b.block_name, ' ', 1)))
        QUALIFY row_number() OVER (PARTITION BY b.athlete_id, b.block_name ORDER BY
          r.prediction_date, r.label, r.race_date, r.official_time_min NULLS FIRST,
          r.relevant_prediction NULLS FIRST) = 1""",
    "marked": """
        SELECT s.*, c.race_date, c.actual_time, c.final_prediction,
          bool_and(coalesce(abs(s."Marathon_pred" - c.final_prediction) <= 2, false)) OVER later
            AS stable, row_number() OVER (PARTITION BY s.athlete_id, s.block_name
              ORDER BY s.date DESC) AS place
        FROM series AS s LEFT JOIN block_race AS c USING (athlete_id, block_name)
        WINDOW later AS (PARTITION BY s.athlete_id, s.block_name ORDER BY s.date
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
    "weekly_mon": filled("series", "athlete_id, block_name", week_end("date", "MON"),
                         "total_distance_miles"),
    "summary0": """
        SELECT athlete_id, block_name, any_value(race_date) AS race_date,
          any_value(actual_time) AS actual_time, any_value(final_prediction) AS final_prediction,
          avg("rolling_std_7_Marathond") AS mean_volatility,
          max("rolling_std_7_Marathond") AS max_volatility,
          min(date) FILTER (WHERE stable) AS stable_date,
          avg("Marathon_pred") FILTER (WHERE place <= 14) AS last_14_day_avg_prediction,
          arg_min_null("Marathon_pred", date) AS first_prediction,
          avg(total_training_load) AS avg_training_load, avg(readiness_score_mean) AS avg_readiness,
          arg_max_null(vo2MaxValue, date) - arg_min_null(vo2MaxValue, date) AS vo2_drift,
          avg(hrv_weekly_avg_clean) AS avg_hrv
        FROM marked GROUP BY athlete_id, block_name""",
    "summary": """
        SELECT s.athlete_id, s.block_name, s.race_date, s.actual_time, s.final_prediction,
          s.final_prediction - s.actual_time AS prediction_error,
          CASE WHEN s.final_prediction - s.actual_time < -2 THEN 'optimistic'
            WHEN s.final_prediction - s.actual_time > 2 THEN 'conservative'
            ELSE 'neutral' END AS prediction_bias, s.mean_volatility, s.max_volatility,
          s.stable_date, date_diff('day', s.stable_date, s.race_date) AS days_stable_before_race,
          w.peak_weekly_mileage, w.avg_weekly_mileage, s.last_14_day_avg_prediction,
          s.final_prediction - s.first_prediction AS prediction_drift, s.avg_training_load,
          s.avg_readiness, s.vo2_drift, s.avg_hrv
        FROM summary0 AS s LEFT JOIN (SELECT athlete_id, block_name, max(v) AS peak_weekly_mileage,
          avg(v) AS avg_weekly_mileage FROM weekly_mon GROUP BY ALL) AS w
          USING (athlete_id, block_name)""",
    "pb": f"""
        WITH r AS (SELECT athlete_id, date AS event_date, label, race_type, official_time_min,
            upper(coalesce(race_type, 'race')) AS race_type_label,
            CASE lower(race_type) WHEN 'marathon' THEN 26.2188e0 WHEN 'half' THEN 13.1094e0
              WHEN '10k' THEN 6.2137e0 WHEN '5k' THEN 3.1069e0 END AS distance_miles_standard
          FROM cal WHERE event_type = 'race' AND official_time_min IS NOT NULL),
        m AS (SELECT r.athlete_id, r.event_date, r.official_time_min, u.name, u.locationName,
            u.distance_miles
          FROM (SELECT DISTINCT athlete_id, event_date, official_time_min FROM r) AS r
          JOIN runs AS u ON r.athlete_id = u.athlete_id AND r.event_date = u.date
          QUALIFY row_number() OVER (PARTITION BY r.athlete_id, r.event_date, r.official_time_min
            ORDER BY abs(u.duration_minutes - r.official_time_min) NULLS LAST,
              u.distance_miles NULLS LAST, u.activityId) = 1)
        SELECT r.*, distance_miles_standard AS distance_value,
          {distance('distance_miles_standard')} AS distance_display,
          {clock('r.official_time_min')} AS official_time_label,
          r.official_time_min / distance_miles_standard AS pace_minutes,
          {clock('r.official_time_min / distance_miles_standard')} AS pace_label,
          CASE WHEN m.athlete_id IS NULL THEN 'No same-day run matched' ELSE m.name END
            AS matched_run_name,
          CASE WHEN m.athlete_id IS NULL THEN '' ELSE m.locationName END AS matched_location,
          m.distance_miles AS recorded_distance_miles
        FROM r LEFT JOIN m USING (athlete_id, event_date, official_time_min)""",
    "ranges": "SELECT athlete_id, block_name, min(date) AS start_date, max(date) AS end_date "
              "FROM series GROUP BY ALL",
    "atlas": f"""
        SELECT u.athlete_id, u.activityId, u.activityType, u.date, year(u.date) AS year,
          u.distance_miles, u.distance_miles AS distance_display,
          {fixed('u.distance_miles')} || ' mi' AS distance_label,
          coalesce(u.avg_pace_mile, 'N/A') AS pace_label,
          coalesce(u.locationName, 'Unknown') AS location_label, coalesce(u.name, 'Run') AS run_name,
          sqrt(greatest(coalesce(u.distance_miles, 0), 0.2)) * 120 AS radius_m, u.startLatitude,
          u.startLongitude, u.endLatitude, u.endLongitude,
          u.endLatitude IS NOT NULL AND u.endLongitude IS NOT NULL AND
            (round_even(u.startLatitude, 5) <> round_even(u.endLatitude, 5)
             OR round_even(u.startLongitude, 5) <> round_even(u.endLongitude, 5)) AS has_route_chord,
          coalesce((SELECT arg_max(b.block_name, b.priority) FROM blocks AS b WHERE
            b.athlete_id = u.athlete_id AND u.date BETWEEN b.start_date AND b.end_date),
            'Outside marathon blocks') AS marathon_block
        FROM runs AS u WHERE u.startLatitude IS NOT NULL AND u.startLongitude IS NOT NULL""",
}


def with_ctes(select: str, rounded: str = "") -> str:
    """Prefix a query with the tables it names, and round its double columns."""
    needed: dict[str, None] = {}

    def visit(sql: str) -> None:
        for name in CTES:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                visit(CTES[name])
                needed[name] = None

    visit(select)
    if rounded:
        terms = ", ".join(f'round("{c}", 6) + 0e0 AS "{c}"' for c in rounded.split())
        select = f"SELECT * REPLACE ({terms}) FROM ({select})"
    elif select.startswith("WITH"):
        select = f"SELECT * FROM ({select})"
    prefix = ", ".join(f"{name} AS ({CTES[name].strip()})" for name in needed)
    return f"WITH {prefix} {select}" if prefix else select
