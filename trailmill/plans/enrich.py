"""Raw activity records to the analysis-ready frame."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from trailmill.functions import temporal as t
from trailmill.functions import units
from trailmill.functions.numeric import not_nan
from trailmill.operators.joins import BROADCAST_ROWS, fits_broadcast, left_enrich
from trailmill.operators.nearest import attach_nearest
from trailmill.operators.shape import derive, drop_suffixed, flatten_structs

SENSOR = ("average_heartrate", "max_heartrate", "suffer_score")
TIMES = ("start_date", "start_date_local")
DURATIONS = ("moving_time", "elapsed_time")
TRANSIENT = ("start_latlng", "end_latlng", "start_latitude", "start_longitude")


def convert_activities(flat: DataFrame) -> DataFrame:
    """Metric to imperial, NaN sensor values to NULL."""
    converted = {
        "distance": units.miles2("distance"),
        "average_speed": units.mph2("average_speed"),
        "max_speed": units.mph2("max_speed"),
        "total_elevation_gain": units.feet2("total_elevation_gain"),
        "elev_high": units.feet2("elev_high"),
        "elev_low": units.feet2("elev_low"),
    }
    return derive(flat, converted | {name: not_nan(name) for name in SENSOR})


def convert_gear(gear: DataFrame) -> DataFrame:
    return derive(gear, {"distance": units.miles("distance")}).drop("converted_distance")


def split_position(df: DataFrame) -> DataFrame:
    """``[lat, lon]`` to two columns; NULL when the array is empty."""
    ends = {"start_latitude": "get(start_latlng, 0)", "start_longitude": "get(start_latlng, 1)"}
    return derive(df, ends)


def naive_times(df: DataFrame) -> DataFrame:
    """Start times as whole-second wall clocks, from ISO text or timestamps."""
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    return derive(df, {n: (t.wall_clock if n in text else t.whole_second)(n) for n in TIMES})


def wrap_durations(df: DataFrame, wrap_24h: bool = True) -> DataFrame:
    """Durations as a clock face shows them; ``wrap_24h=False`` keeps them whole."""
    return derive(df, {n: t.wrap_day(n) for n in DURATIONS}) if wrap_24h else df


def calendar(df: DataFrame, month_mode: str = "calendar") -> DataFrame:
    """Clock, weekday, month and year features of the local start.

    ``month_mode`` is ``calendar`` or ``seasonal`` (all years folded into one).
    """
    start = "start_date_local"
    monthly = {"calendar": t.month_start, "seasonal": t.season_month}[month_mode]
    return derive(
        df,
        {
            "start_time_local_24h": t.clock24(start),
            "start_time_local_24h_hour": t.nearest_hour(start),
            "start_time_local_12h": t.clock12(start),
            "weekday": t.weekday_name(start),
            "weekday_num": t.weekday_number(start),
            "month": t.month_name(start),
            "month_num": f"month({start})",
            "monthly_date": monthly(start),
            "month_year": t.month_start(start),
            "month_year_name": t.month_label(start),
            "year": f"year({start})",
        },
    )


def stamp(df: DataFrame, refreshed: Column | str = t.UTC_NOW) -> DataFrame:
    """Add ``refresh_date``, from the naive UTC time of the snapshot: an
    expression as text, or a column that no row decides, such as a scalar
    subquery. Its label is made once, in a subquery of its own."""
    if isinstance(refreshed, str):
        return derive(df, {"refresh_date": t.refresh_stamp(refreshed)})
    timed = df.sparkSession.range(1).select(refreshed.alias("_refreshed"))
    label = timed.selectExpr(f"{t.refresh_stamp('_refreshed')} AS label").scalar()
    return df.withColumn("refresh_date", label)


def enrich(
    raw: DataFrame,
    gear: DataFrame,
    observations: DataFrame | None = None,
    *,
    refreshed: Column | str = t.UTC_NOW,
    gear_rows_at_most: int | None = None,
    gear_keys: DataFrame | None = None,
    stations_at_most: int | None = None,
    hours_at_most: int | None = None,
    wrap_24h: bool = True,
    month_mode: str = "calendar",
    rebalance: bool = False,
) -> DataFrame:
    """One row per activity with gear, weather and calendar columns.

    Every step is a projection except the gear lookup (broadcast when gear is
    provably or measurably small) and the weather lookup; leave
    ``observations`` out when no weather column is needed, as a left join
    under a sum cannot be pruned away. ``rebalance`` lets partitions be sized by
    year for a store, before the calendar columns are there: these follow from
    the start, so they are derived behind the shuffle instead of carried by it.
    Behind a gear lookup that is a shuffle itself, partitions are of bounded size
    already and whole rows are not moved a second time; each then holds all years.
    ``gear_keys`` are the ``gear_id`` of ``raw`` where these are cheaper to read.
    """
    small = fits_broadcast(gear, gear_rows_at_most)
    placed = split_position(naive_times(convert_activities(flatten_structs(raw))))
    if observations is not None:
        placed = attach_nearest(
            placed, observations, stations_at_most=stations_at_most, hours_at_most=hours_at_most
        )
    geared = left_enrich(
        placed,
        convert_gear(gear),
        "gear_id",
        "id",
        ("_activity", "_gear"),
        rows_at_most=BROADCAST_ROWS if small else sys.maxsize,
        counted=gear_keys,
    )
    if rebalance and small:
        geared = derive(geared.drop(*TRANSIENT), {"year": "year(start_date_local)"}).hint("rebalance", "year")
    dated = calendar(wrap_durations(geared, wrap_24h), month_mode)
    return drop_suffixed(stamp(dated, refreshed).drop(*TRANSIENT))
