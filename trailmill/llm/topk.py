"""Exact top-k search by inner product, with vector-approximation files.

Vectors are dealt into blocks by a hash of their id, queries likewise; every
block of vectors meets every block of queries in a task of its own, so each
vector is copied once per block of queries and no pair is ever a row. Inside a
task the approximation file of the block is scanned: each component stands in
one of ``cells`` cells between the block's smallest and largest value of that
dimension. The cells bound every inner product from above (two matrix
products). Then, for each query, exact vectors are read in the order of their
bounds until the kth best exact score is no less than the next bound. The k
best of each block, exact, are merged per query: at most k rows per query and
block.

Components are ``floor(256 * x)``, scores integer inner products, ties go to
the smaller id, a vector is no candidate of itself. Vectors that are null or
hold null or non-finite components, and rows without id, take no part. Only
vectors of equal length meet. An id that repeats counts once, with its smallest
vector. No rows, no result. Exact for products below 2^63; bounds are widened
by the rounding of doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import read

K = 5
CELLS = 64
#: Vectors and queries of a block, about.
BLOCK, QUERY_BLOCK = 16384, 2048
#: Exact vectors read between two looks at the bounds.
STEP = 32


def usable(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """``vec_id, v``: integer components of the vectors that take part."""
    finite = "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity'))"
    whole = f"transform(embedding, x -> cast(floor({scale}D * cast(x as double)) as bigint)) AS v"
    return vectors.where(f"vec_id IS NOT NULL AND embedding IS NOT NULL AND {finite}").selectExpr(
        "cast(vec_id as bigint) AS vec_id", whole
    )


def _matrix(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending and distinct, and their vectors."""
    ordered = sorted(zip(rows["vec_id"], map(tuple, rows["v"]), strict=True))
    first = [x for k, x in enumerate(ordered) if k == 0 or ordered[k - 1][0] != x[0]]
    ids = np.array([i for i, _ in first], np.int64)
    return ids, np.array([v for _, v in first], np.int64).reshape(len(ids), -1)


def approximate(exact: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell numbers of all components, and each cell's bounds per dimension."""
    low, high = exact.min(axis=0), exact.max(axis=0)
    width = np.maximum(1, -(-(high - low + 1) // cells))
    number = ((exact - low) // width).astype(np.uint16)
    floor = low + np.arange(cells)[:, None] * width
    return number, floor.astype(float), (floor + width - 1).astype(float)


def search(
    ids: np.ndarray, exact: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int = K
) -> Iterator[tuple[int, int, int]]:
    """``query, id, score`` of the k best of these vectors for each query."""
    number, floor, ceiling = approximate(exact)
    dims = np.arange(exact.shape[1])
    # Queries go in groups, so the bounds of a group fit a fixed amount of memory.
    for at in range(0, len(query_ids), 128):
        some = queries[at : at + 128].astype(float)
        upper = np.maximum(some, 0) @ ceiling[number, dims].T + np.minimum(some, 0) @ floor[number, dims].T
        upper += np.abs(upper) * 1e-12 * max(1, exact.shape[1])
        for row, query in enumerate(query_ids[at : at + 128]):
            bounds = upper[row]
            bounds[ids == query] = -np.inf
            best: list[tuple[int, int]] = []
            left, size = bounds.copy(), min(STEP, len(ids))
            while True:
                top = np.argpartition(-left, size - 1)[:size]
                top = top[np.isfinite(left[top])]
                scores = exact[top] @ queries[at + row]
                best = sorted([*best, *zip(-scores, ids[top], strict=True)])[:k]
                left[top] = -np.inf
                rest = left.max() if len(left) else -np.inf
                # A bound equal to the kth score may still win on its id.
                if rest == -np.inf or (len(best) == k and rest < -best[-1][0]):
                    break
            yield from ((int(query), int(i), int(-s)) for s, i in best)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for ``vec_id, v`` rows on both sides."""
    shared = f"size(v) AS dim"
    n, m = (-(-x.count() // per) or 1 for x, per in ((vectors, BLOCK), (queries, QUERY_BLOCK)))
    dealt = vectors.selectExpr(
        "*", shared, f"pmod(xxhash64(vec_id), {n}) AS a", f"explode(sequence(0L, {m - 1}L)) AS b"
    )
    asked = queries.selectExpr(
        "*", shared, f"explode(sequence(0L, {n - 1}L)) AS a", f"pmod(xxhash64(vec_id, 1), {m}) AS b"
    )

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = list(search(*_matrix(left), *_matrix(right), k)) if len(left) and len(right) else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"], dtype="int64")

    keys = ("dim", "a", "b")
    found = (
        dealt.groupBy(*keys)
        .cogroup(asked.groupBy(*keys))
        .applyInPandas(run, "query_id bigint, vec_id bigint, score bigint")
    )
    order = "row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)"
    return (
        found.selectExpr("query_id", f"{order} AS rank", "vec_id", "score")
        .where(f"rank <= {k}")
        .select("query_id", "rank", "vec_id", "score")
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = usable(read(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op7_sql() -> str:
    """The same rows by scoring every vector."""
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
  scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(
      range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM v q JOIN v c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (
  PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= {K}"""
