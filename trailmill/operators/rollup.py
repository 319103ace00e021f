"""Grouped series.

One function covers every grouped chart: rows with a missing key are left out,
sums of nothing are zero, means skip missing values, and results come ordered
by key or by first activity. All aggregates keep primitive buffers, so Spark
combines them map-side in the hash aggregate and a hot month or gear costs one
row per task in the shuffle.

A measure is an aggregate expression with its alias, as SQL text.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.numeric import from_units, half_even, not_nan, to_units, truncated
from trailmill.functions.text import hours2
from trailmill.operators.shape import quoted

FIRST_SEEN = "_first_seen"


def rows(name: str) -> str:
    return f"count(1) AS {quoted(name)}"


def filled(column: str, name: str) -> str:
    """Non-null values."""
    return f"count({column}) AS {quoted(name)}"


def unit_total(column: str) -> str:
    """Exact sum in hundredths."""
    return f"coalesce(sum({to_units(column)}), 0L)"


def total(column: str, name: str) -> str:
    return f"{from_units(unit_total(column))} AS {quoted(name)}"


def whole_total(column: str, name: str) -> str:
    """Rounded to two decimals, then cut to an integer."""
    return f"{truncated(half_even(from_units(unit_total(column))))} AS {quoted(name)}"


def second_total(column: str) -> str:
    return f"coalesce(sum({column}), 0L)"


def hour_total(column: str, name: str) -> str:
    return f"{hours2(second_total(column))} AS {quoted(name)}"


def mean(column: str, name: str) -> str:
    """Mean rounded to two decimals; the values themselves are not rounded.

    The sum is exact to ten decimals, so the last digit does not depend on
    partitioning. A sum of up to 28 digits before the point fits.
    """
    exact = f"try_cast({not_nan(column)} as decimal(38, 10))"
    average = f"cast(sum({exact}) as double) / nullif(count({exact}), 0L)"
    return f"{half_even(average)} AS {quoted(name)}"


def rollup(
    df: DataFrame,
    keys: Mapping[str, str],
    measures: Sequence[str],
    *,
    first_seen: bool = False,
    time: str = "start_date_local",
) -> DataFrame:
    """Group by ``keys`` (output name to column) and compute ``measures``.

    ``first_seen`` orders groups by their first activity, else by key.
    """
    present = df.dropna(subset=list(keys.values()))
    grouped = present.groupBy(*[F.expr(f"{quoted(c)} AS {quoted(n)}") for n, c in keys.items()])
    if not first_seen:
        return grouped.agg(*map(F.expr, measures)).orderBy(*keys)
    first = F.expr(f"min({time}) AS {FIRST_SEEN}")
    return grouped.agg(*map(F.expr, measures), first).orderBy(FIRST_SEEN, *keys).drop(FIRST_SEEN)


def fused_rollup(
    df: DataFrame, outer: tuple[str, str], inner: tuple[str, str], measures: Sequence[str]
) -> DataFrame:
    """Totals by ``outer`` and by ``outer`` and ``inner`` in one scan.

    ``level`` is ``total`` or ``split``. A missing inner key still counts in
    the total, and is left out of the split.
    """
    a, b = F.col(quoted(outer[1])), F.col(quoted(inner[1]))
    fused = (
        df.dropna(subset=[outer[1]])
        .groupingSets([[a], [a, b]], a, b)
        .agg(F.expr("grouping_id() AS _level"), *map(F.expr, measures))
        .where(f"_level = 1 OR {quoted(inner[1])} IS NOT NULL")
    )
    values = [quoted(c) for c in fused.columns[3:]]
    return fused.selectExpr(
        "if(_level = 0, 'split', 'total') AS level",
        f"{quoted(outer[1])} AS {quoted(outer[0])}",
        f"{quoted(inner[1])} AS {quoted(inner[0])}",
        *values,
    )
