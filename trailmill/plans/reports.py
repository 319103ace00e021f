"""Report frames.

Each family below is a table of (key, what varies); the frames themselves are
built by :func:`~trailmill.operators.rollup.rollup`,
:func:`~trailmill.operators.boxes.box_summary` or a projection. Unless a
function says otherwise it takes a frame that a ``Selection`` already filtered.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.numeric import half_even, truncated
from trailmill.functions.temporal import UTC_NOW, day_text, refresh_time
from trailmill.functions.text import (
    grouped_hundredths,
    grouped_integer,
    hours2,
    hours_minutes,
    ordered_weekday,
)
from trailmill.operators import boxes
from trailmill.operators import rollup as r
from trailmill.operators.boxes import box_points, box_summary
from trailmill.operators.rollup import fused_rollup, rollup
from trailmill.operators.selection import latest_label
from trailmill.operators.shape import derive, quoted, title_headers

Frame = Callable[[DataFrame], DataFrame]

MONTH = {"Month": "month_year"}
TYPE = {"Activity Type": "type"}
GEAR = {"Gear": "name_gear"}
BRAND_GEAR = {"Gear Brand": "brand_name", "Gear": "name_gear"}


# Overview ------------------------------------------------------------------

def overview_kpis(df: DataFrame) -> DataFrame:
    """One row: distinct activities and three totals as text, in one pass."""
    totals = df.agg(
        F.expr("count(distinct upload_id) AS Activities"),
        F.expr(f"{r.unit_total('distance_activity')} AS _distance"),
        F.expr(r.total("total_elevation_gain", "_elevation")),
        F.expr(f"{r.second_total('moving_time')} AS _seconds"),
    )
    return totals.selectExpr(
        "Activities",
        f"concat({grouped_hundredths('_distance')}, ' mi') AS Distance",
        f"concat({grouped_integer(truncated('rint(_elevation)'))}, ' ft') AS Elevation",
        f"{hours_minutes('_seconds')} AS Time",
    )


def overview_kpis_approx(df: DataFrame, error: float = 0.01) -> DataFrame:
    """Activities by sketch, for interactive use on very large selections."""
    return df.agg(F.expr(f"approx_count_distinct(upload_id, {error}D) AS Activities"))


OVERVIEW = {
    "activities": r.rows("Activities"),
    "distance": r.total("distance_activity", "Distance"),
    "elevation": r.whole_total("total_elevation_gain", "Elevation"),
    "time": r.hour_total("moving_time", "Time"),
}


def overview_series(measure: str, by_type: bool) -> Frame:
    keys = MONTH | TYPE if by_type else MONTH
    return lambda df: rollup(df, keys, [OVERVIEW[measure]], first_seen=True)


def overview_fused(df: DataFrame) -> DataFrame:
    """All eight overview series from one scan and one shuffle."""
    (month,), (kind,) = MONTH.items(), TYPE.items()
    return fused_rollup(df, month, kind, list(OVERVIEW.values()))


# Gear ----------------------------------------------------------------------

def _totals(activities: str) -> dict[str, str]:
    return {
        "activities": activities,
        "distance": r.total("distance_activity", "Distance"),
        "elevation": r.total("total_elevation_gain", "Elevation"),
        "time": r.hour_total("moving_time", "Time"),
    }


UPLOAD_TOTALS = _totals(r.filled("upload_id", "Activities"))


def gear_totals(measure: str) -> Frame:
    """By brand and gear; the brand chart and the gear chart share it."""
    return lambda df: rollup(df, BRAND_GEAR, [UPLOAD_TOTALS[measure]])


GEAR_MONTHLY = _totals(r.rows("Activities")) | {
    "avg_speed": r.mean("average_speed", "Avg Speed"),
    "avg_heartrate": r.mean("average_heartrate", "Avg Heart Rate"),
    "avg_effort": r.mean("suffer_score", "Avg Relative Effort"),
}


def gear_monthly(measure: str) -> Frame:
    return lambda df: rollup(df, MONTH | GEAR, [GEAR_MONTHLY[measure]], first_seen=True)


# Value expression and bin widths of each box measure.
BOXES = {
    "distance": ("distance_activity", boxes.HUNDREDTHS),
    "elevation": ("total_elevation_gain", boxes.HUNDREDTHS),
    "time": (hours2("moving_time"), boxes.HUNDREDTHS),  # rounded per row
    "avg_speed": ("average_speed", boxes.HUNDREDTHS),
    "max_speed": ("max_speed", boxes.HUNDREDTHS),
    "avg_heartrate": ("average_heartrate", boxes.RAW),
    "max_heartrate": ("max_heartrate", boxes.RAW),
    "effort": ("suffer_score", boxes.RAW),
}


def _box(build: Callable[..., DataFrame], measure: str, key: str, name: str) -> Frame:
    """Per-key results are joined as their measured size allows."""
    value, widths = BOXES[measure]
    return lambda df: build(df, key, value, name=name, widths=widths)


def gear_box(measure: str) -> Frame:
    return _box(box_summary, measure, "name_gear", "Gear")


def gear_points(measure: str) -> Frame:
    return _box(box_points, measure, "name_gear", "Gear")


def month_box(measure: str) -> Frame:
    return _box(box_summary, measure, "month_year", "Month")


def month_points(measure: str) -> Frame:
    return _box(box_points, measure, "month_year", "Month")


def gear_summary(df: DataFrame) -> DataFrame:
    """Thirteen measures per gear over the unfiltered frame, most recently
    used first within active and retired gear."""
    keys = ["brand_name", "name_gear", "retired"]
    measures = [
        r.filled("upload_id", "Total_Activities"),
        r.total("distance_activity", "Total_Distance"),
        _top("distance_activity", "Max_Distance"),
        r.total("total_elevation_gain", "Total_Elevation"),
        _top("total_elevation_gain", "Max_Elevation"),
        r.hour_total("moving_time", "Total_Time"),
        f"{hours2('max(moving_time)')} AS Max_Time",
        r.mean("average_speed", "Avg_Speed"),
        _top("max_speed", "Max_Speed"),
        r.mean("average_heartrate", "Avg_Heart_Rate"),
        _top("max_heartrate", "Max_Heart_Rate"),
        "min(start_date_local) AS First_Activity_Date",
        "max(start_date_local) AS Last_Activity_Date",
    ]
    measured = df.dropna(subset=keys).groupBy(*keys).agg(*map(F.expr, measures))
    ordered = measured.orderBy("retired", F.desc("Last_Activity_Date"), "brand_name", "name_gear")
    dates = {c: day_text(c) for c in ("First_Activity_Date", "Last_Activity_Date")}
    return title_headers(derive(ordered, dates).withColumnRenamed("name_gear", "Gear"))


def _top(column: str, name: str) -> str:
    return f"{half_even(f'max({column})')} AS {name}"


# Weather -------------------------------------------------------------------

TEMPERATURE = ("temp", "Temperature (°F)")
HUMIDITY = ("rhum", "Relative Humidity (%)")
SCATTER = {
    "distance": ("distance_activity", "Distance (mi)"),
    "elevation": ("total_elevation_gain", "Elevation (ft)"),
    "time": (hours2("moving_time"), "Time (hrs)"),  # rounded per row
    "avg_speed": ("average_speed", "Avg speed (mph)"),
    "avg_heartrate": ("average_heartrate", "Avg Heart Rate"),
    "effort": ("suffer_score", "Relative Effort"),
}


def scatter(x: tuple[str, str], y: tuple[str, str]) -> Frame:
    """Every activity as a point; a narrow projection, no shuffle of its own."""

    chosen = [x, y, ("type", "Activity Type")]
    return lambda df: df.selectExpr(*[f"{value} AS {quoted(label)}" for value, label in chosen])


# Performance ---------------------------------------------------------------

MEANS = {
    "avg_speed": ("average_speed", "Avg Speed (mph)"),
    "max_speed": ("max_speed", "Max Speed (mph)"),  # the mean of the maxima
    "avg_heartrate": ("average_heartrate", "Avg Heart Rate"),
    "max_heartrate": ("max_heartrate", "Max Heart Rate"),  # the mean of the maxima
    "avg_effort": ("suffer_score", "Avg Relative Effort"),
}


def performance(measure: str) -> Frame:
    return lambda df: rollup(df, MONTH | TYPE, [r.mean(*MEANS[measure])])


# Timing --------------------------------------------------------------------

def timing_month(measure: str) -> Frame:
    return _timing({"Month": "monthly_date"} | TYPE, measure)


def timing_hour(measure: str) -> Frame:
    return _timing({"Hour": "start_time_local_24h_hour"} | TYPE, measure)


def _timing(keys: dict[str, str], measure: str) -> Frame:
    return lambda df: rollup(df, keys, [UPLOAD_TOTALS[measure]])


def timing_weekday(measure: str) -> Frame:
    keys = {"weekday_num": "weekday_num", "Weekday": "weekday"} | TYPE
    label = {"Weekday": ordered_weekday("weekday_num", "Weekday")}
    return lambda df: derive(_timing(keys, measure)(df), label)


# Tables and status ---------------------------------------------------------

DETAIL = (
    "start_date_local", "start_time_local_12h", "type", "name_activity", "brand_name",
    "name_gear", "distance_activity", "total_elevation_gain", "elev_high", "elev_low",
    "moving_time", "average_speed", "max_speed", "average_heartrate", "max_heartrate",
    "temp", "rhum", "start_time_local_24h_hour", "weekday",
)


def activity_detail(df: DataFrame) -> DataFrame:
    """Nineteen columns of every activity, unfiltered."""
    shown = {
        "moving_time": hours2("moving_time"),
        "start_date_local": day_text("start_date_local"),
    }
    return df.selectExpr(*[f"{shown.get(c, c)} AS {c}" for c in DETAIL])


def status_latest(df: DataFrame) -> DataFrame:
    """One row: the latest refresh stamp and the latest activity label."""
    return df.agg(F.expr("max(refresh_date) AS last_refresh")).select(
        "last_refresh", latest_label(df).scalar().alias("last_activity")
    )


def status_freshness(df: DataFrame, now: Column | None = None) -> DataFrame:
    """One row: whole days since the last refresh and what to tell the user.

    Under 7 days is ``ok``, up to 14 ``warn``, beyond that ``error``. ``now``
    is naive UTC.
    """
    now = F.expr(UTC_NOW) if now is None else now
    stamped = df.agg(F.expr("max(refresh_date) AS last_refresh")).withColumn("_now", now)
    seconds = f"timestampdiff(SECOND, {refresh_time('last_refresh')}, _now)"
    aged = stamped.selectExpr("last_refresh", f"floor({seconds} / 86400D) AS age_days")
    status = "CASE WHEN age_days < 7 THEN 'ok' WHEN age_days <= 14 THEN 'warn' ELSE 'error' END"
    return aged.selectExpr("*", f"{status} AS status")
