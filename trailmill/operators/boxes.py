"""Box-plot distributions, exact, without sorting a whole group in one task.

A box needs the values at six ranks of each group (two per quartile). Instead
of numbering a group's rows, values are counted, and the search for a rank is
narrowed bin by bin: bins are counted over the group, only the bins that hold
a wanted rank are opened, and values are numbered inside those. A window
therefore only ever sees one group's bins or one bin's values, however large
the group is, and all counting combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.numeric import not_nan
from trailmill.operators.joins import BROADCAST_ROWS
from trailmill.operators.shape import quoted

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}
HUNDREDTHS = (10.24,)  # Two-decimal values: at most 1,024 of them per bin.
RAW = (10.24, 0.01)  # Unrounded values: bins are opened twice.

LOW_FENCE = "(q1 * 2.5D - q3 * 1.5D)"
HIGH_FENCE = "(q3 * 2.5D - q1 * 1.5D)"


def box_summary(
    df: DataFrame,
    key: str,
    value: str,
    *,
    name: str | None = None,
    widths: Sequence[float] = HUNDREDTHS,
    method: str = "hazen",
    keys_at_most: int | None = None,
) -> DataFrame:
    """Per key: ``n``, quartiles, whiskers and the number of outliers.

    ``value`` is an expression. ``hazen`` takes rank ``p * n - 0.5``
    (zero-based) with linear interpolation, the usual box-plot default;
    ``linear`` takes ``p * (n - 1)``. ``approx`` trades exact quartiles for
    one pass with a mergeable sketch and is never used unless asked for.
    ``keys_at_most`` is a bound the caller can prove; it lets the per-key
    results be broadcast.
    """
    name = name or key
    samples = _samples(df, key, value)
    # Bins are columns of the counting aggregate and are known to be set, so
    # every later step has the same filters below it and reuses its exchange.
    bins = [f"floor(_value / {width}D) AS _bin{level}" for level, width in enumerate(widths)]
    binned = samples.selectExpr("*", *bins).dropna()
    counted = binned.groupBy(*binned.columns).agg(F.expr("count(1) AS _rows"))
    if method == "approx":
        quartiles = _sketched(samples)
    else:
        quartiles = _ranked(counted, widths, method, keys_at_most)

    statistics = ["n", *QUARTILES]
    outside = f"_value < least(q1, {LOW_FENCE}) OR _value > greatest(q3, {HIGH_FENCE})"
    with_whiskers = (
        counted.join(_small(quartiles, keys_at_most), ["_key"])
        .groupBy("_key", *statistics)
        .agg(
            F.expr(f"min(if(_value >= {LOW_FENCE}, _value, NULL)) AS _low"),
            F.expr(f"max(if(_value <= {HIGH_FENCE}, _value, NULL)) AS _high"),
            F.expr(f"sum(if({outside}, _rows, 0L)) AS n_outliers"),
        )
    )
    return with_whiskers.selectExpr(
        f"_key AS {quoted(name)}",
        *statistics,
        "least(q1, _low) AS lower_whisker",
        "greatest(q3, _high) AS upper_whisker",
        "n_outliers",
    )


def box_points(
    df: DataFrame,
    key: str,
    value: str,
    *,
    name: str | None = None,
    widths: Sequence[float] = HUNDREDTHS,
    keys_at_most: int | None = None,
) -> DataFrame:
    """Every sample with a flag for those outside the whiskers."""
    whiskers = box_summary(df, key, value, name="_key", widths=widths, keys_at_most=keys_at_most)
    edges = whiskers.select("_key", "lower_whisker", "upper_whisker")
    return (
        _samples(df, key, value)
        .join(_small(edges, keys_at_most), ["_key"])
        .selectExpr(
            f"_key AS {quoted(name or key)}",
            "_value AS value",
            "_value < lower_whisker OR _value > upper_whisker AS is_outlier",
        )
    )


def _samples(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.selectExpr(f"{key} AS _key", f"{not_nan(value)} AS _value").dropna()


def _small(per_key: DataFrame, keys_at_most: int | None, rows_per_key: int = 1) -> DataFrame:
    """Broadcast only behind a proven bound; else adaptive execution decides
    by the measured size."""
    if keys_at_most is not None and keys_at_most * rows_per_key <= BROADCAST_ROWS:
        return F.broadcast(per_key)
    return per_key


def _position(p: float, method: str) -> str:
    raw = {"hazen": f"n * {p}D - 0.5D", "linear": f"(n - 1) * {p}D"}[method]
    return f"least(greatest({raw}, 0D), cast(n - 1 as double))"


def _ranks(method: str) -> list[str]:
    """The wanted zero-based ranks, two per quartile."""
    positions = [_position(p, method) for p in QUARTILES.values()]
    return [f"{end}({position})" for position in positions for end in ("floor", "ceil")]


def _holds(rank: str) -> str:
    return f"(_lo <= {rank} AND {rank} < _hi)"


def _ranked(
    counted: DataFrame, widths: Sequence[float], method: str, keys_at_most: int | None
) -> DataFrame:
    ranks = _ranks(method)
    wanted = " OR ".join(_holds(rank) for rank in ranks)

    opened: DataFrame | None = None  # bins that hold a wanted rank: <= 6 per key
    group = ["_key"]
    for level in range(len(widths)):
        name = f"_bin{level}"
        carried = [] if opened is None else ["n", "_start"]
        bins = (
            _restrict(counted, opened, group, keys_at_most)
            .groupBy(*group, name, *carried)
            .agg(F.expr("sum(_rows) AS _rows"))
        )
        if opened is None:
            bins = bins.selectExpr("*", "sum(_rows) OVER (PARTITION BY _key) AS n", "0L AS _start")
        opened = (
            _numbered(bins, group, name)
            .where(wanted)
            .selectExpr(*group, name, "n", "_lo AS _start")
        )
        group = [*group, name]

    inside = _restrict(counted, opened, group, keys_at_most)
    at_ranks = _numbered(inside, group, "_value").where(wanted)
    found = at_ranks.groupBy("_key", "n").agg(
        *[F.expr(f"max(if({_holds(r)}, _value, NULL)) AS _r{i}") for i, r in enumerate(ranks)]
    )
    picked = []
    for i, (quartile, p) in enumerate(QUARTILES.items()):
        position = _position(p, method)
        share = f"({position} - floor({position}))"
        picked.append(f"{share} * _r{2 * i + 1} + (1D - {share}) * _r{2 * i} AS {quartile}")
    return found.selectExpr("_key", "n", *picked)


def _restrict(
    counted: DataFrame, opened: DataFrame | None, keys: list[str], keys_at_most: int | None
) -> DataFrame:
    if opened is None:
        return counted
    return counted.join(_small(opened, keys_at_most, 6), keys)


def _numbered(frame: DataFrame, group: list[str], order: str) -> DataFrame:
    """Add the half-open rank interval ``[_lo, _hi)`` of each row."""
    upto = (
        f"sum(_rows) OVER (PARTITION BY {', '.join(group)} ORDER BY {order} "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    )
    return frame.selectExpr("*", f"_start + {upto} AS _hi").selectExpr("*", "_hi - _rows AS _lo")


def _sketched(samples: DataFrame) -> DataFrame:
    sketches = [f"percentile_approx(_value, {p}D, 10000) AS {q}" for q, p in QUARTILES.items()]
    return samples.groupBy("_key").agg(F.expr("count(1) AS n"), *map(F.expr, sketches))
