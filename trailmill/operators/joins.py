"""Left lookups of the activity fact into dimensions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.operators.shape import quoted

BROADCAST_ROWS = 100_000  # A dimension row is ~100 bytes, so ~10 MB at most.
HOT_SHARE = 0.001  # At most 1 / HOT_SHARE keys can hold more than this share.
SALTS = 64  # Parts a hot key is spread over.


def fits_broadcast(
    df: DataFrame, rows_at_most: int | None = None, limit: int = BROADCAST_ROWS
) -> bool:
    """Whether ``df`` is known, or checked, to hold no more than ``limit`` rows.

    ``rows_at_most`` is a bound the caller can prove; without one the rows are
    counted, and counting stops at ``limit + 1``.
    """
    if rows_at_most is not None:
        return rows_at_most <= limit
    return df.limit(limit + 1).count() <= limit


def hot_keys(df: DataFrame, keys: Sequence[str], share: float = HOT_SHARE) -> DataFrame:
    """Keys that hold more than ``share`` of the rows that have one; fewer than
    ``1/share``.

    Counts combine map-side, so a hot key costs one row per map task here; the
    total is taken from the same counts.
    """
    held = df.groupBy(*keys).agg(F.expr("count(1) AS rows_held"))
    bar = held.agg(F.expr(f"sum(rows_held) * {share}D AS bar")).scalar()
    return held.where(F.col("rows_held") > bar).select(*keys)


def left_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    *,
    rows_at_most: int | None = None,
    limit: int = BROADCAST_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left outer equi join on same-named keys.

    A right side within ``limit`` rows is broadcast and the fact never moves.
    A larger one is joined by a shuffle that spreads hot and missing keys.
    """
    if fits_broadcast(right, rows_at_most, limit):
        return left.join(F.broadcast(right), list(keys), "left")
    return spread_left_lookup(left, right, keys, counted=counted)


def spread_left_lookup(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    share: float = HOT_SHARE,
    counted: DataFrame | None = None,
) -> DataFrame:
    """The shuffled form of :func:`left_lookup`, safe against hot and NULL keys.

    Rows with a hot key, or none, are spread over ``SALTS`` parts by a hash of
    the row; the right rows of hot keys, and only those, are copied to each
    part. The left side is read twice: to count keys, and to join; ``counted``
    holds the same keys, row by row, where they are cheaper to read.
    """
    keys = list(keys)
    has_key = " AND ".join(f"{quoted(key)} IS NOT NULL" for key in keys)
    # Fewer than 1/share rows.
    held = (left if counted is None else counted).where(has_key)
    hot = F.broadcast(hot_keys(held, keys, share).withColumn("_hot", F.lit(True)))
    plain = [quoted(f.name) for f in left.schema.fields if isinstance(f.dataType, T.AtomicType)]
    spread = f"pmod(xxhash64({', '.join(plain)}), {SALTS})"
    salted = left.join(hot, keys, "left").selectExpr(
        *map(quoted, left.columns), f"if(_hot OR NOT ({has_key}), {spread}, 0L) AS _salt"
    )
    copies = f"explode(if(_hot, sequence(0L, {SALTS - 1}L), array(0L))) AS _salt"
    replicated = right.join(hot, keys, "left").selectExpr(*map(quoted, right.columns), copies)
    return salted.join(replicated, [*keys, "_salt"], "left").drop("_salt")


def left_enrich(
    left: DataFrame,
    right: DataFrame,
    left_key: str,
    right_key: str,
    suffixes: tuple[str, str],
    *,
    rows_at_most: int | None = None,
    limit: int = BROADCAST_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Left outer join where only colliding column names take a suffix.

    The right key does not survive the join; the left key does, as first column.
    ``counted`` may hold the left keys once more, for :func:`spread_left_lookup`.
    """
    shared = set(left.schema.names) & set(right.schema.names)
    left = left.withColumnsRenamed({c: c + suffixes[0] for c in shared})
    lookup = left_key + suffixes[0] if left_key in shared else left_key
    renamed = {c: c + suffixes[1] for c in shared if c != right_key} | {right_key: lookup}
    right = right.withColumnsRenamed(renamed)
    if counted is not None:
        counted = counted.select(F.col(left_key).alias(lookup))
    return left_lookup(
        left, right, [lookup], rows_at_most=rows_at_most, limit=limit, counted=counted
    )


def used_ids(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null ids."""
    return df.select(column).where(f"{quoted(column)} IS NOT NULL").distinct()


def used_dimension(
    dimension: DataFrame, facts: DataFrame, dimension_key: str, fact_key: str
) -> DataFrame:
    """Dimension rows some fact refers to."""
    ids = used_ids(facts, fact_key).withColumnRenamed(fact_key, dimension_key)
    return dimension.join(ids, [dimension_key], "left_semi")
