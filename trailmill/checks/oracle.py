"""DuckDB SQL for the registered queries.

Written from the definitions, not from the Spark plans: the rolling anchor is
the largest label text, boxes number every row, the nearest station is picked
from all pairs of the hour. Nothing here scales or needs to.
"""

from __future__ import annotations


def r2(x: str) -> str:
    return f"(round_even(({x}) * 100.0::DOUBLE, 0) / 100.0::DOUBLE)"


def label(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %I:%M %p')"


UPLOAD = "(l_orderkey * 10 + l_linenumber)"
MOVING = "CAST(l_quantity * 1800 AS BIGINT)"
SPEED = "(l_extendedprice / (l_quantity * 1800.0::DOUBLE))"
KIND = """CASE l_returnflag || l_linestatus WHEN 'RO' THEN 'Run' WHEN 'RF' THEN 'Ride'
  WHEN 'NO' THEN 'Walk' WHEN 'NF' THEN 'Hike' WHEN 'AF' THEN 'Swim' ELSE 'Yoga' END"""

RAW = f"""raw AS (SELECT
  {UPLOAD} * 100000 + l_partkey AS id, {UPLOAD} AS upload_id, l_suppkey AS athlete_id,
  'Activity ' || {UPLOAD} AS name, {KIND} AS type,
  CASE WHEN l_partkey % 11 <> 0 THEN l_partkey END AS gear_id,
  l_extendedprice AS distance, {SPEED} AS average_speed,
  {SPEED} * (1.0::DOUBLE + l_discount * 5.0::DOUBLE) AS max_speed,
  l_quantity * l_linenumber AS total_elevation_gain,
  l_quantity * 20.0::DOUBLE AS elev_high, l_quantity * 10.0::DOUBLE AS elev_low,
  {MOVING} AS moving_time, {MOVING} + l_linenumber * 60 AS elapsed_time,
  l_shipdate + to_seconds((l_orderkey * 7919 + l_linenumber * 104729) % 86400) AS start_date,
  l_shipdate + to_seconds((l_orderkey * 7919 + l_linenumber * 104729) % 86400) AS start_date_local,
  CASE WHEN l_linenumber <> 7 THEN 100.0::DOUBLE + l_quantity + l_tax / 8.0::DOUBLE END
    AS average_heartrate,
  CASE WHEN l_linenumber <> 7 THEN 100.0::DOUBLE + l_quantity + l_tax * 500.125::DOUBLE END
    AS max_heartrate,
  CASE WHEN l_tax <> 0 THEN l_quantity * (1.0::DOUBLE + l_tax) / 16.0::DOUBLE END AS suffer_score,
  CAST((l_orderkey * 37) % 18001 AS DOUBLE) / 100.0::DOUBLE - 90.0::DOUBLE AS start_latitude,
  CAST((l_orderkey * 101) % 36001 AS DOUBLE) / 100.0::DOUBLE - 180.0::DOUBLE AS start_longitude
  FROM lineitem)"""

GEAR = """gear AS (SELECT p_partkey AS id, p_name || ' #' || p_partkey AS name,
  p_brand AS brand_name, p_size > 25 AS retired,
  p_retailprice * 1000.0::DOUBLE / 1609.34::DOUBLE AS distance
  FROM part)"""

OBS = """picked AS (SELECT o_custkey % 10 AS station_id, o_orderkey, o_totalprice,
  o_orderdate + to_hours(o_orderkey % 24) AS obs_hour,
  row_number() OVER (PARTITION BY o_custkey % 10, o_orderdate + to_hours(o_orderkey % 24)
    ORDER BY o_orderkey) AS place FROM orders),
obs AS (SELECT station_id, CAST(station_id * 15 - 67 AS DOUBLE) AS lat,
  CAST(station_id * 36 - 162 AS DOUBLE) AS lon, obs_hour,
  CAST(CAST(floor(o_totalprice) AS BIGINT) % 45 - 5 AS DOUBLE) * 9 / 5 + 32 AS temp,
  CAST(o_orderkey % 101 AS DOUBLE) AS rhum FROM picked WHERE place = 1)"""

NEAR = """points AS (SELECT DISTINCT date_trunc('hour', start_date_local) AS h,
  start_latitude AS la, start_longitude AS lo FROM raw),
pairs AS (SELECT h, la, lo, temp, rhum, row_number() OVER (PARTITION BY h, la, lo ORDER BY
  round_even(12742.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE,
    pow(sin(radians(lat - la) / 2), 2)
    + cos(radians(la)) * cos(radians(lat)) * pow(sin(radians(lon - lo) / 2), 2)))), 6),
  station_id) AS place FROM points JOIN obs ON obs_hour = h),
weather AS (SELECT * FROM pairs WHERE place = 1)"""

CONVERTED = {
    "distance": r2("raw.distance / 1609.34::DOUBLE"),
    "average_speed": r2("average_speed * 2.23694::DOUBLE"),
    "max_speed": r2("max_speed * 2.23694::DOUBLE"),
    "total_elevation_gain": r2("total_elevation_gain * 3.28084::DOUBLE"),
    "elev_high": r2("elev_high * 3.28084::DOUBLE"),
    "elev_low": r2("elev_low * 3.28084::DOUBLE"),
}

NEAREST_HOUR = (
    "CAST(CAST(round_even((hour(start_date_local) * 3600 + minute(start_date_local) * 60 "
    "+ second(start_date_local)) / 3600.0::DOUBLE, 0) AS INTEGER) % 24 AS INTEGER)"
)
FEATURES = f"""
  strftime(start_date_local, '%H:%M:%S') AS start_time_local_24h,
  {NEAREST_HOUR} AS start_time_local_24h_hour,
  strftime(start_date_local, '%I:%M %p') AS start_time_local_12h,
  dayname(start_date_local) AS weekday,
  CAST(isodow(start_date_local) - 1 AS INTEGER) AS weekday_num,
  monthname(start_date_local) AS month,
  CAST(month(start_date_local) AS INTEGER) AS month_num,
  CAST(date_trunc('month', start_date_local) AS DATE) AS monthly_date,
  CAST(date_trunc('month', start_date_local) AS DATE) AS month_year,
  strftime(start_date_local, '%b %Y') AS month_year_name,
  CAST(year(start_date_local) AS INTEGER) AS year"""


def acts(weather: bool = False, wrap: bool = True) -> str:
    """CTEs up to ``acts``, the enriched activities."""
    wrapped = " % 86400" if wrap else ""
    columns = ", ".join(
        f"{x} AS {'distance_activity' if c == 'distance' else c}" for c, x in CONVERTED.items()
    )
    seen = ", temp, rhum" if weather else ""
    joined = """LEFT JOIN weather ON h = date_trunc('hour', start_date_local)
      AND la = start_latitude AND lo = start_longitude""" if weather else ""
    parts = [RAW, GEAR] + ([OBS, NEAR] if weather else [])
    return f"""WITH {", ".join(parts)},
acts AS (SELECT raw.id AS id_activity, upload_id, athlete_id, raw.name AS name_activity, type,
  gear_id, {columns}, moving_time{wrapped} AS moving_time, elapsed_time{wrapped} AS elapsed_time,
  start_date, start_date_local, average_heartrate, max_heartrate, suffer_score,
  gear.name AS name_gear, brand_name, retired, gear.distance AS distance_gear{seen}, {FEATURES}
  FROM raw LEFT JOIN gear ON gear_id = gear.id {joined})"""


ANCHOR = f"(SELECT strptime(max({label('start_date_local')}), '%Y-%m-%d %I:%M %p') FROM acts)"
DEFAULT_TYPES = "type IN ('Run', 'Hike', 'Walk', 'Ride')"
ROLLING = f"start_date_local >= {ANCHOR} - INTERVAL 12 MONTH"


def chosen(weather: bool = False, where: str = f"{DEFAULT_TYPES} AND {ROLLING}") -> str:
    return (
        acts(weather)
        + f", f AS (SELECT * FROM acts WHERE {where} AND brand_name IS NOT NULL) "
    )


def dsum(x: str) -> str:
    return f"CAST(coalesce(sum(CAST({x} AS DECIMAL(18,2))), 0) AS DOUBLE)"


def hours(x: str) -> str:
    return r2(f"CAST(coalesce(sum({x}), 0) AS DOUBLE) / 3600.0::DOUBLE")


def average(x: str) -> str:
    return r2(f"CAST(sum(CAST({x} AS DECIMAL(38,10))) AS DOUBLE) / count({x})")


ROW_HOURS = r2("moving_time / 3600.0::DOUBLE")
TOTALS = {
    "distance": ("Distance", dsum("distance_activity")),
    "elevation": ("Elevation", dsum("total_elevation_gain")),
    "time": ("Time", hours("moving_time")),
}
UPLOADS = {"activities": ("Activities", "count(upload_id)")} | TOTALS
COUNTS = {"activities": ("Activities", "count(*)")} | TOTALS
OVERVIEW = COUNTS | {
    "elevation": ("Elevation", f"CAST(trunc({r2(dsum('total_elevation_gain'))}) AS BIGINT)")
}


def grouped(keys: dict[str, str], measure: tuple[str, str], base: str | None = None) -> str:
    present = " AND ".join(f"{c} IS NOT NULL" for c in keys.values())
    columns = ", ".join(f'{c} AS "{n}"' for n, c in keys.items())
    name, value = measure
    return (
        f'{base or chosen()} SELECT {columns}, {value} AS "{name}" FROM f '
        f"WHERE {present} GROUP BY {', '.join(keys.values())}"
    )


MONTH = {"Month": "month_year"}
TYPE = {"Activity Type": "type"}
GEAR_KEY = {"Gear": "name_gear"}
BRAND_GEAR = {"Gear Brand": "brand_name", "Gear": "name_gear"}


def box(
    key: str, name: str, value: str, points: bool = False, base: str | None = None, shown: str | None = None
) -> str:
    """``base`` defines ``f`` (the chosen activities); ``shown`` replaces the key column."""
    position = {
        q: f"least(greatest({p} * n - 0.5, 0), n - 1)::DOUBLE"
        for q, p in (("q1", "0.25::DOUBLE"), ("median", "0.5::DOUBLE"), ("q3", "0.75::DOUBLE"))
    }
    picks = ", ".join(
        f"max(CASE WHEN i = floor({p}) THEN v END) AS {q}_lo, "
        f"max(CASE WHEN i = ceil({p}) THEN v END) AS {q}_hi, "
        f"any_value({p} - floor({p})) AS {q}_s"
        for q, p in position.items()
    )
    quartiles = ", ".join(
        f"{q}_s * {q}_hi + (1.0::DOUBLE - {q}_s) * {q}_lo AS {q}" for q in position
    )
    shown = shown or f'w.k AS "{name}"'
    base = f"""{base or chosen()}, s AS (SELECT {key} AS k, {value} AS v FROM f
      WHERE {key} IS NOT NULL AND {value} IS NOT NULL),
    o AS (SELECT k, v, row_number() OVER (PARTITION BY k ORDER BY v) - 1 AS i,
      count(*) OVER (PARTITION BY k) AS n FROM s),
    p AS (SELECT k, n, {picks} FROM o GROUP BY k, n),
    q AS (SELECT k, n, {quartiles} FROM p),
    w AS (SELECT s.k, n, q1, median, q3,
      least(q1, min(CASE WHEN v >= q1 * 2.5::DOUBLE - q3 * 1.5::DOUBLE THEN v END)) AS lower_whisker,
      greatest(q3, max(CASE WHEN v <= q3 * 2.5::DOUBLE - q1 * 1.5::DOUBLE THEN v END))
        AS upper_whisker FROM s JOIN q ON s.k = q.k GROUP BY s.k, n, q1, median, q3)"""
    flagged = "(v < lower_whisker OR v > upper_whisker)"
    if points:
        return f'{base} SELECT s.k AS "{name}", v AS value, {flagged} AS is_outlier FROM s JOIN w ON s.k = w.k'
    return f"""{base} SELECT {shown}, n, q1, median, q3, lower_whisker, upper_whisker,
      CAST(count(*) FILTER (WHERE {flagged}) AS BIGINT) AS n_outliers
      FROM w JOIN s ON s.k = w.k GROUP BY ALL"""


BOXES = {
    "distance": "distance_activity",
    "elevation": "total_elevation_gain",
    "time": ROW_HOURS,
    "avg_speed": "average_speed",
    "max_speed": "max_speed",
    "avg_heartrate": "average_heartrate",
    "max_heartrate": "max_heartrate",
    "effort": "suffer_score",
}
SCATTER = {
    "distance": ("distance_activity", "Distance (mi)"),
    "elevation": ("total_elevation_gain", "Elevation (ft)"),
    "time": (ROW_HOURS, "Time (hrs)"),
    "avg_speed": ("average_speed", "Avg speed (mph)"),
    "avg_heartrate": ("average_heartrate", "Avg Heart Rate"),
    "effort": ("suffer_score", "Relative Effort"),
}
MEANS = {
    "avg_speed": ("average_speed", "Avg Speed (mph)"),
    "max_speed": ("max_speed", "Max Speed (mph)"),
    "avg_heartrate": ("average_heartrate", "Avg Heart Rate"),
    "max_heartrate": ("max_heartrate", "Max Heart Rate"),
    "avg_effort": ("suffer_score", "Avg Relative Effort"),
}


def scatter(x: tuple[str, str], y: tuple[str, str]) -> str:
    return (
        f'{chosen(True)} SELECT {x[0]} AS "{x[1]}", {y[0]} AS "{y[1]}", '
        'type AS "Activity Type" FROM f'
    )


SUMMARY = f"""{acts()} SELECT brand_name AS "Brand Name", name_gear AS "Gear", retired AS "Retired",
  count(upload_id) AS "Total Activities", {dsum("distance_activity")} AS "Total Distance",
  {r2("max(distance_activity)")} AS "Max Distance",
  {dsum("total_elevation_gain")} AS "Total Elevation",
  {r2("max(total_elevation_gain)")} AS "Max Elevation",
  {hours("moving_time")} AS "Total Time",
  {r2("max(moving_time) / 3600.0::DOUBLE")} AS "Max Time",
  {average("average_speed")} AS "Avg Speed", {r2("max(max_speed)")} AS "Max Speed",
  {average("average_heartrate")} AS "Avg Heart Rate",
  {r2("max(max_heartrate)")} AS "Max Heart Rate",
  strftime(min(start_date_local), '%Y-%m-%d') AS "First Activity Date",
  strftime(max(start_date_local), '%Y-%m-%d') AS "Last Activity Date"
  FROM acts WHERE brand_name IS NOT NULL AND name_gear IS NOT NULL AND retired IS NOT NULL
  GROUP BY brand_name, name_gear, retired"""

DETAIL = f"""{acts(True)} SELECT strftime(start_date_local, '%Y-%m-%d') AS start_date_local,
  start_time_local_12h, type, name_activity, brand_name, name_gear, distance_activity,
  total_elevation_gain, elev_high, elev_low, {ROW_HOURS} AS moving_time, average_speed, max_speed,
  average_heartrate, max_heartrate, temp, rhum, start_time_local_24h_hour, weekday FROM acts"""

KPIS = f"""{chosen()}, t AS (SELECT count(DISTINCT upload_id) AS a,
  coalesce(CAST(sum(CAST(distance_activity * 100 AS BIGINT)) AS BIGINT), 0) AS d,
  CAST(round_even({dsum("total_elevation_gain")}, 0) AS BIGINT) AS e,
  CAST(coalesce(sum(moving_time), 0) AS BIGINT) AS s FROM f)
  SELECT a AS "Activities",
  format('{{:,}}', d // 100) || '.' || CASE WHEN d % 10 = 0 THEN CAST((d % 100) // 10 AS VARCHAR)
    ELSE lpad(CAST(d % 100 AS VARCHAR), 2, '0') END || ' mi' AS "Distance",
  format('{{:,}}', e) || ' ft' AS "Elevation",
  (s // 3600) || ' hrs ' || ((s % 3600) // 60) || ' min' AS "Time" FROM t"""

FUSED_VALUES = ", ".join(f'{v} AS "{n}"' for n, v in OVERVIEW.values())
FUSED = f"""{chosen()} SELECT 'total' AS level, month_year AS "Month", NULL AS "Activity Type",
  {FUSED_VALUES} FROM f WHERE month_year IS NOT NULL GROUP BY month_year
  UNION ALL SELECT 'split', month_year, type, {FUSED_VALUES} FROM f
  WHERE month_year IS NOT NULL AND type IS NOT NULL GROUP BY month_year, type"""

# New York is UTC-5 in November, when the snapshot below is taken.
REFRESHED = "(SELECT max(start_date_local) + INTERVAL 1 DAY FROM acts)"
STAMP = label(f"{REFRESHED} - INTERVAL 5 HOUR")
STATUS = f"""{acts()} SELECT {STAMP} AS last_refresh,
  (SELECT max({label("start_date_local")}) FROM acts) AS last_activity"""
FRESHNESS = f"""{acts()}, a AS (SELECT {STAMP} AS last_refresh,
  CAST(floor(date_diff('second', strptime({STAMP}, '%Y-%m-%d %I:%M %p') + INTERVAL 5 HOUR,
    {REFRESHED} + INTERVAL 10 DAY) / 86400.0::DOUBLE) AS BIGINT) AS age_days)
  SELECT last_refresh, age_days, CASE WHEN age_days < 7 THEN 'ok' WHEN age_days <= 14 THEN 'warn'
    ELSE 'error' END AS status FROM a"""


def report_sql() -> dict[str, str]:
    found = {"overview_kpis": KPIS, "overview_fused": FUSED, "gear_summary": SUMMARY}
    weekday_label = "CAST(weekday_num + 1 AS VARCHAR) || '-' || weekday"
    for m in UPLOADS:
        found[f"overview_{m}_by_month"] = grouped(MONTH, OVERVIEW[m])
        found[f"overview_{m}_by_month_type"] = grouped(MONTH | TYPE, OVERVIEW[m])
        found[f"gear_{m}"] = grouped(BRAND_GEAR, UPLOADS[m])
        found[f"timing_month_{m}"] = grouped({"Month": "monthly_date"} | TYPE, UPLOADS[m])
        found[f"timing_weekday_{m}"] = grouped(
            {"weekday_num": "weekday_num", "Weekday": weekday_label} | TYPE, UPLOADS[m]
        )
        found[f"timing_hour_{m}"] = grouped({"Hour": "start_time_local_24h_hour"} | TYPE, UPLOADS[m])
        found[f"gear_{m}_by_month"] = grouped(MONTH | GEAR_KEY, COUNTS[m])
    for m, column, name in (
        ("avg_speed", "average_speed", "Avg Speed"),
        ("avg_heartrate", "average_heartrate", "Avg Heart Rate"),
        ("avg_effort", "suffer_score", "Avg Relative Effort"),
    ):
        found[f"gear_{m}_by_month"] = grouped(MONTH | GEAR_KEY, (name, average(column)))
    for m, value in BOXES.items():
        found[f"gear_box_{m}"] = box("name_gear", "Gear", value)
        if m not in ("distance", "elevation", "time"):
            found[f"perf_box_{m}"] = box("month_year", "Month", value)
            found[f"perf_points_{m}"] = box("month_year", "Month", value, points=True)
        found[f"gear_points_{m}"] = box("name_gear", "Gear", value, points=True)
    axes = {"temp": ("temp", "Temperature (°F)"), "rhum": ("rhum", "Relative Humidity (%)")}
    found["weather_temp_rhum"] = scatter(axes["temp"], axes["rhum"])
    for m, measure in SCATTER.items():
        for x, axis in axes.items():
            found[f"weather_{x}_{m}"] = scatter(axis, measure)
    for m, (column, name) in MEANS.items():
        found[f"perf_{m}_by_month_type"] = grouped(MONTH | TYPE, (name, average(column)))
    season = "make_date(2025, month(start_date_local), 1)"
    for m, measure in UPLOADS.items():
        key = "timing_month_seasonal" + ("" if m == "activities" else f"_{m}")
        found[key] = grouped({"Month": season} | TYPE, measure, chosen(where=DEFAULT_TYPES))
    found["activity_detail"] = DETAIL
    for key, column in (("domain_types", "type"), ("domain_brands", "brand_name")):
        found[key] = (
            f"{acts()} SELECT {column}, count(*) AS n FROM acts WHERE {column} IS NOT NULL "
            f"GROUP BY {column}"
        )
    found["domain_years"] = (
        f"{acts()} SELECT 'All' AS label, -2 AS position UNION ALL SELECT 'Rolling 12 Months', -1 "
        "UNION ALL SELECT DISTINCT CAST(year AS VARCHAR), CAST(9999 - year AS INTEGER) FROM acts"
    )
    found["status_latest"] = STATUS
    found["status_freshness"] = FRESHNESS
    return found


CALENDAR = """id_activity, moving_time, elapsed_time, start_date_local, start_time_local_24h,
  start_time_local_24h_hour, start_time_local_12h, weekday, weekday_num, month, month_num,
  monthly_date, month_year, month_year_name, year"""
TABLE_COLUMNS = f"""id_activity, upload_id, name_activity, type,
  CAST(gear_id AS VARCHAR) AS gear_id, distance_activity, average_speed, max_speed,
  total_elevation_gain, elev_high, elev_low, moving_time, elapsed_time, average_heartrate,
  max_heartrate, suffer_score, start_date, start_date_local, name_gear, brand_name, retired,
  distance_gear, start_time_local_24h, start_time_local_24h_hour, start_time_local_12h,
  weekday, weekday_num, month, month_num, monthly_date, month_year, month_year_name,
  {STAMP} AS refresh_date, year"""
RAW_COLUMNS = """id, upload_id, athlete_id, name, type, gear_id, distance, average_speed, max_speed,
  total_elevation_gain, elev_high, elev_low, moving_time, elapsed_time, start_date,
  start_date_local, average_heartrate, max_heartrate, suffer_score"""
DURATION = """(elapsed_time // 86400) || ' days '
  || lpad(CAST((elapsed_time % 86400) // 3600 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST((elapsed_time % 3600) // 60 AS VARCHAR), 2, '0') || ':'
  || lpad(CAST(elapsed_time % 60 AS VARCHAR), 2, '0')"""


def stage_sql() -> dict[str, str]:
    pick = "SELECT id_activity, type, start_date_local, brand_name FROM f"
    strict = "start_date_local >= (SELECT max(start_date_local) FROM acts) - INTERVAL 12 MONTH"
    year = "type = 'Run' AND year = 2000 AND brand_name IN ('Brand#1', 'Brand#2', 'Brand#3')"
    converted = ", ".join(f"{x} AS {c}" for c, x in CONVERTED.items())
    near = f"""WITH {RAW}, {OBS}, {NEAR} SELECT id, temp, rhum FROM raw LEFT JOIN weather
      ON h = date_trunc('hour', start_date_local) AND la = start_latitude AND lo = start_longitude"""
    raw = f"WITH {RAW} SELECT"
    return {
        "select_rolling_default": f"{chosen()} {pick}",
        "select_rolling_strict": f"{chosen(where=f'{DEFAULT_TYPES} AND {strict}')} {pick}",
        "select_year_brands": f"{chosen(where=year)} {pick}",
        "select_all_years": f"{chosen(where=DEFAULT_TYPES)} {pick}",
        "select_nothing": f"{chosen(where='false')} {pick}",
        "landing_pages": f"""{raw} id, upload_id, athlete_id, type,
          CAST(gear_id AS VARCHAR) AS gear_id, distance, moving_time, start_date_local,
          start_latitude, start_longitude FROM raw WHERE upload_id % 10 <> 7""",
        "landing_files": f"""{raw} id, upload_id, athlete_id, type,
          CAST(gear_id AS VARCHAR) AS gear_id, distance, moving_time, start_date_local,
          start_latitude, start_longitude FROM raw""",
        "landing_until_end": f"""{raw} id, upload_id, athlete_id, type,
          CAST(gear_id AS VARCHAR) AS gear_id, distance, moving_time, start_date_local,
          start_latitude, start_longitude FROM raw
          WHERE upload_id // 1000 < (SELECT (min(upload_id // 1000) + max(upload_id // 1000)) // 2 FROM raw)""",
        "refresh_pipeline": f"""{acts(True)} SELECT {TABLE_COLUMNS}, athlete_id, temp, rhum FROM acts""",
        "fallback_table": f"""{acts(True)} SELECT id_activity, upload_id, type, name_gear,
          distance_activity, temp FROM acts""",
        "stored_overview_distance_by_month_type": grouped(MONTH | TYPE, OVERVIEW["distance"]),
        "stored_select_year": f"""{chosen(where=f"{DEFAULT_TYPES} AND year = 2000")} {pick}""",
        "stored_rolling_anchor": f"""{acts()} SELECT {ANCHOR} AS anchor,
          {ANCHOR} - INTERVAL 12 MONTH AS window_start""",
        "stored_domain_years": f"{acts()} SELECT 'All' AS label, -2 AS position UNION ALL SELECT 'Rolling 12 Months', -1 "
        "UNION ALL SELECT DISTINCT CAST(year AS VARCHAR), CAST(9999 - year AS INTEGER) FROM acts",
        "stored_load_year": f"""{chosen(where=f"{DEFAULT_TYPES} AND year = 2000")} {pick}""",
        "landing_rejects": f"""{raw} '["Rate limit"]' AS errors, count(*) AS pages FROM raw
          WHERE upload_id % 10 = 7""",
        "events_flat": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events",
        "activities_flat": f"{raw} {RAW_COLUMNS} FROM raw",
        "activities_converted": f"{raw} id, {converted} FROM raw",
        "activities_positions": f"{raw} id, start_latitude, start_longitude FROM raw",
        "activities_enriched": f"{acts()} SELECT {CALENDAR} FROM acts",
        "activities_unwrapped": f"{acts(wrap=False)} SELECT id_activity, moving_time, elapsed_time FROM acts",
        "activities_season": f"""{acts()} SELECT id_activity,
          make_date(2025, month(start_date_local), 1) AS monthly_date FROM acts""",
        "durations_text": f"""{acts(wrap=False)} SELECT id_activity, {DURATION} AS duration,
          elapsed_time AS seconds, (elapsed_time // 3600) || ' hrs '
          || ((elapsed_time % 3600) // 60) || ' min' AS label,
          {r2("elapsed_time / 3600.0::DOUBLE")} AS hours FROM acts""",
        "records_round_trip": f"""{acts()} SELECT athlete_id, {CALENDAR}, distance_activity,
          name_gear, {STAMP} AS refresh_date FROM acts""",
        "table_refresh_reload": f"""{acts(True)} SELECT athlete_id, {CALENDAR}, distance_activity,
          temp, rhum, {STAMP} AS refresh_date FROM acts""",
        "gear_converted": f"""WITH {GEAR} SELECT id, name, brand_name, retired,
          round_even(distance * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE AS distance FROM gear""",
        "gear_ids": f"{raw} DISTINCT gear_id FROM raw WHERE gear_id IS NOT NULL",
        "gear_used": f"""WITH {RAW}, {GEAR} SELECT id, name, brand_name FROM gear
          WHERE id IN (SELECT gear_id FROM raw)""",
        "gear_join": f"""{acts()} SELECT id_activity, gear_id, name_activity, name_gear, brand_name,
          retired FROM acts""",
        "gear_join_spread": f"""WITH {RAW}, {GEAR} SELECT raw.id AS id, gear_id, gear.name AS name,
          brand_name FROM raw LEFT JOIN gear ON gear_id = gear.id""",
        "weather_observations": f"WITH {OBS} SELECT * FROM obs",
        "weather_join": near,
        "weather_join_grid": near,
        "weather_join_shuffled": near,
        "pages_appended": f"""{raw} id, type, CASE WHEN gear_id IS NULL THEN distance END AS distance,
          gear_id FROM raw""",
        "nan_cleaned": f"{raw} id, CASE WHEN distance >= 20000 THEN distance END AS distance FROM raw",
        "rolling_anchor": f"""{acts()} SELECT {ANCHOR} AS anchor,
          {ANCHOR} - INTERVAL 12 MONTH AS window_start""",
        "table_columns": f"{acts()} SELECT {TABLE_COLUMNS} FROM acts",
    }


ATHLETE_LABEL = f"strptime(max({label('start_date_local')}), '%Y-%m-%d %I:%M %p')"


def athlete_chosen(strict: bool = False) -> str:
    """CTEs up to ``f``: the default selection with each athlete's own rolling year."""
    anchor = "max(start_date_local)" if strict else ATHLETE_LABEL
    return (
        acts()
        + f""", an AS (SELECT athlete_id AS a_id, {anchor} - INTERVAL 12 MONTH AS start
          FROM acts WHERE athlete_id IS NOT NULL GROUP BY athlete_id),
        f AS (SELECT acts.* FROM acts JOIN an ON athlete_id = a_id
          WHERE {DEFAULT_TYPES} AND start_date_local >= start AND brand_name IS NOT NULL) """
    )


def athlete_sql() -> dict[str, str]:
    athlete = {"athlete_id": "athlete_id"}
    pick = "SELECT athlete_id, id_activity, type, start_date_local, brand_name FROM f"
    pair = "struct_pack(a := athlete_id, m := month_year)"
    return {
        "athlete_anchors": f"""{acts()} SELECT athlete_id, {ATHLETE_LABEL} AS anchor,
          {ATHLETE_LABEL} - INTERVAL 12 MONTH AS start FROM acts WHERE athlete_id IS NOT NULL GROUP BY athlete_id""",
        "athlete_select_rolling": f"{athlete_chosen()} {pick}",
        "athlete_select_rolling_strict": f"{athlete_chosen(strict=True)} {pick}",
        "athlete_distance_by_month": grouped(athlete | MONTH, OVERVIEW["distance"], athlete_chosen()),
        "athlete_activities_by_month_type": grouped(
            athlete | MONTH | TYPE, OVERVIEW["activities"], athlete_chosen()
        ),
        "athlete_box_avg_speed": box(
            pair, "Month", "average_speed", base=athlete_chosen(),
            shown="struct_extract(w.k, 'a') AS athlete_id, struct_extract(w.k, 'm') AS \"Month\"",
        ),
        "athlete_domain_types": f"""{acts()} SELECT athlete_id, type, count(*) AS n,
          CAST(row_number() OVER (PARTITION BY athlete_id ORDER BY count(*) DESC, type) AS INTEGER) AS position
          FROM acts WHERE athlete_id IS NOT NULL AND type IS NOT NULL GROUP BY athlete_id, type""",
    }


def oracle_queries() -> dict[str, str]:
    return report_sql() | stage_sql() | athlete_sql()
