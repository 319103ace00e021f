"""Nearest observation of the same hour.

Both plans below end in one left join of the activities to a row per hour (or
per hour and grid cell) that carries a short array of candidate observations;
the nearest is then picked inside the row. No pair of activity and station is
ever emitted as a row, the activity count cannot change, and activity ids need
not be unique.
"""

from __future__ import annotations

import math
from itertools import product

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.geo import arc_km, chord, unit_vector
from trailmill.functions.numeric import half_even
from trailmill.functions.temporal import hour_number
from trailmill.operators.joins import spread_left_lookup
from trailmill.operators.shape import without

DIRECT_STATIONS = 64  # Up to here a whole hour's stations fit one row's array.
BROADCAST_OBSERVATIONS = 1_000_000  # About 50 bytes each.
CELL = 1 / 64  # Cube edge on the unit sphere, about 100 km.
REACHES = (1 / 16, 1 / 4)  # Search edges, about 400 and 1,600 km.
PAST = 1_000_000  # Beyond any cube number on the unit sphere.
SLACK = 1e-8  # Covers the 1 mm grain distances are compared with.

_POINT = ("_x", "_y", "_z")
_OBSERVATION = (*_POINT, "station_id", "temp", "rhum")
_CELL_KEYS = ["_hour", "_cx", "_cy", "_cz"]


def attach_nearest(
    activities: DataFrame,
    observations: DataFrame,
    *,
    time: str = "start_date_local",
    lat: str = "start_latitude",
    lon: str = "start_longitude",
    stations_at_most: int | None = None,
    hours_at_most: int | None = None,
    max_km: float | None = None,
    split_hot: bool = False,
) -> DataFrame:
    """Add ``temp`` and ``rhum`` of the nearest station that reported in the
    activity's wall-clock hour; NULL where no station did.

    Distances are compared to 1 mm, then by station id. ``stations_at_most``
    is a bound the caller can prove on the number of stations; without a small
    one, candidates are first narrowed per grid cell. With ``hours_at_most``,
    a checked bound on the hours observed, a small feed is broadcast and the
    activities never move. Otherwise they are shuffled by hour (and cell):
    adaptive execution then splits a skewed hour, and ``split_hot`` plans that
    split up front.
    """
    hourly = observations.where("lat IS NOT NULL AND lon IS NOT NULL").selectExpr(
        f"{hour_number('obs_hour')} AS _hour",
        *_aliased(unit_vector("lat", "lon"), _POINT),
        "station_id", "temp", "rhum",
    )
    keyed = activities.selectExpr(
        "*", f"{hour_number(time)} AS _hour", *_aliased(unit_vector(lat, lon), _POINT)
    )
    if stations_at_most is not None and stations_at_most <= DIRECT_STATIONS:
        keys = ["_hour"]
        packed = f"collect_list(struct({', '.join(_OBSERVATION)})) AS _near"
        candidates = hourly.groupBy("_hour").agg(F.expr(packed))
    else:
        keys = _CELL_KEYS
        keyed = keyed.selectExpr("*", *_cells(_POINT, CELL, "_c"))
        candidates = cell_candidates(keyed.select(*keys), hourly)

    if stations_at_most and (hours_at_most or math.inf) * stations_at_most <= BROADCAST_OBSERVATIONS:
        joined = keyed.join(F.broadcast(candidates), keys, "left")
    elif split_hot:
        joined = spread_left_lookup(keyed, candidates, keys)
    else:
        joined = keyed.join(candidates, keys, "left")
    scratch = [*keys, *_POINT, "_near"]
    return joined.selectExpr(without(*scratch), f"{_pick(max_km)} AS _best").selectExpr(
        without("_best"), "_best.temp AS temp", "_best.rhum AS rhum"
    )


def _aliased(values: tuple[str, ...], names: tuple[str, ...]) -> list[str]:
    return [f"{value} AS {name}" for value, name in zip(values, names)]


def _pick(max_km: float | None) -> str:
    """The candidate with the smallest (distance, station id)."""
    km = half_even(arc_km(chord(_POINT, ("o._x", "o._y", "o._z"))), 6)
    ranked = (
        f"transform(_near, o -> named_struct('km', {km}, 'station_id', o.station_id, "
        "'temp', o.temp, 'rhum', o.rhum))"
    )
    if max_km is not None:
        ranked = f"filter({ranked}, o -> o.km <= {float(max_km)}D)"
    return f"if(_z IS NOT NULL AND _x IS NOT NULL, array_min({ranked}), NULL)"


def _cells(point: tuple[str, str, str], edge: float, name: str) -> list[str]:
    return [f"cast(floor({p} / {edge!r}D) as int) AS {name}{a}" for p, a in zip(point, "xyz")]


def cell_candidates(cells: DataFrame, hourly: DataFrame) -> DataFrame:
    """Per occupied (hour, cell): every observation that is nearest to some
    point of the cell.

    Any point of a cell lies within ``radius`` of its centre, so with ``d`` the
    distance from the centre to its nearest observation, only observations
    within ``d + 2 * radius`` of the centre can be nearest to a point inside.
    The search looks at the 27 cubes around the centre, which hold everything
    within one cube edge; a cell is settled once that edge covers the bound.
    Unsettled cells try wider cubes and at last the whole hour, so the result
    is exact however sparse the stations are.

    Observations are packed per (hour, cube), so a cell meets one row at each
    width and narrows its array in place: no pair of cell and observation is a
    row. Settled cells pass the wider searches by, so each is planned once.
    """
    spread = CELL * math.sqrt(3) + SLACK  # 2 * radius
    centre = tuple(f"((_c{a} + 0.5D) * {CELL!r}D)" for a in "xyz")
    middle = ("_mx", "_my", "_mz")
    packed = F.expr(f"collect_list(struct({', '.join(_OBSERVATION)})) AS _list")
    squares = " + ".join(f"({m} - o.{p}) * ({m} - o.{p})" for m, p in zip(middle, _POINT))
    near = f"filter(_list, (o, i) -> get(_squares, i) <= (_d + {spread!r}D) * (_d + {spread!r}D))"

    found = (
        cells.dropna()
        .distinct()
        .join(hourly.select("_hour").distinct(), ["_hour"], "left_semi")
    )
    for k, edge in enumerate((*REACHES, None)):
        settled = "_near IS NOT NULL" if k else "false"
        if edge is None:
            lists, keys = hourly.groupBy("_hour").agg(packed), ["_hour"]
        else:
            keys = ["_hour", "_bx", "_by", "_bz"]
            lists = _neighbourhood(hourly, edge).groupBy(*keys).agg(packed)
            # A settled cell asks for a cube that does not exist.
            past = f"if({settled}, {PAST} + _cx, _bx)"
            cubes = found.selectExpr("*", *_cells(centre, edge, "_b"))
            found = cubes.withColumn("_bx", F.expr(past))
        met = (
            # Merge: size estimates do not see the 27 copies, so left alone
            # Spark may broadcast far more than its threshold.
            found.join(lists.hint("merge"), keys, "left")
            .selectExpr("*", *_aliased(centre, middle))
            .selectExpr("*", f"if({settled}, NULL, transform(_list, o -> {squares})) AS _squares")
            .selectExpr("*", "sqrt(array_min(_squares)) AS _d")
        )
        done = "true" if edge is None else f"coalesce(_d + {spread!r}D <= {edge!r}D, false)"
        chosen = f"if({done}, {near}, NULL)"
        found = met.selectExpr(*_CELL_KEYS, f"coalesce(_near, {chosen}) AS _near" if k else f"{chosen} AS _near")
    return found


def _neighbourhood(hourly: DataFrame, edge: float) -> DataFrame:
    """Each observation once per cube of the 27 around its own."""
    cubes = product((-1, 0, 1), repeat=3)
    steps = ", ".join(f"struct({i} AS i, {j} AS j, {k} AS k)" for i, j, k in cubes)
    return (
        hourly.selectExpr("*", *_cells(_POINT, edge, "_o"))
        .selectExpr("*", f"explode(array({steps})) AS _s")
        .selectExpr(
            *hourly.columns, "_ox + _s.i AS _bx", "_oy + _s.j AS _by", "_oz + _s.k AS _bz"
        )
    )
