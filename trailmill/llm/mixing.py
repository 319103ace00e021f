"""Mixing sources to target weights: which documents, how often.

Every source gets a budget in words. Budgets share ``total`` (by default all
words there are) by the sources' weights; a source can give at most
``max_epochs`` times its own words, and what it cannot give is shared among the
others, again by weight, until every budget can be met.

A source is then read in complete epochs as long as they fit. What is left of
the budget is a weighted sample without replacement by exponential keys: each
document draws ``-ln(u) / quality`` with u fixed by its id and ``seed``, and
documents are taken in the order of their keys until their words, summed, reach
the rest. The one document on the edge is taken by its first words only, so a
source gives exactly its budget, rounded down to words.

Scale. A source may hold a third of all rows, so no task ever sorts one
source: keys are first cut into ranges, many per large source, whose word
counts are summed map-side; only documents of the same range are ordered
against each other. Ranges and sources are aggregates; the windows over them
see one row for each.

A null text counts 0 words; documents without words draw a key and take 0. A
null source is a source of its own, last in order. Documents may repeat: equal
keys are ordered by id, then by text. Without rows the result has none. Other
columns stay on :func:`mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm.common import SPACED_WORD, landed, read

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 17
#: Documents of a source that are ordered together, about.
RANGE_ROWS = 1024

SIZE = f"cast(coalesce(regexp_count(text, r'{SPACED_WORD}'), 0) as bigint)"
#: Documents with words of usual length weigh 1, others less, never under 0.05.
QUALITY = (
    "greatest(0.05D, if(size = 0, 0.05D, "
    "least(length(text) / size, 6D) / greatest(length(text) / size, 6D)))"
)


def draws(docs: DataFrame, quality: str = QUALITY, seed: int = SEED) -> DataFrame:
    """``row, doc_id, source, size, digest, key`` of every document, landed.

    ``quality`` is SQL text over the columns and ``size``; it must be over 0.
    """
    digest = "md5(coalesce(text, ''))"
    # 52 bits of a digest, shifted off 0.
    bits = f"conv(substr(md5(concat_ws('|', '{seed}', doc_id, {digest})), 1, 13), 16, 10)"
    u = f"(cast({bits} as double) + 0.5D) / 4503599627370496D"
    return landed(
        docs.selectExpr("*", f"{SIZE} AS size").selectExpr(
            "doc_id", "source", "size", f"{digest} AS digest", f"-ln({u}) / {quality} AS key"
        ),
        "mix-draws",
    )


def budgets(
    drawn: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
) -> DataFrame:
    """``source, docs, source_size, target`` by sharing out what capped
    sources leave.

    With a level L, every source gets ``min(cap, L * weight)``. Sources are
    capped in the order of cap per weight, so L follows from running sums.
    """
    by_source = drawn.groupBy("source").agg(
        F.count(F.lit(1)).alias("docs"), F.sum("size").alias("source_size")
    )
    listed = ", ".join(f"{w}D" for w in weights)
    rank = "row_number() OVER (ORDER BY source IS NULL, source) - 1"
    ahead = "OVER (ORDER BY reach, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    levelled = (
        by_source.selectExpr("*", f"get(array({listed}), cast(({rank}) % {len(weights)} as int)) AS weight")
        .selectExpr("*", f"{max_epochs}D * source_size AS cap")
        .selectExpr("*", "cap / weight AS reach", "sum(source_size) OVER () AS total")
        .selectExpr(
            "*",
            f"total - coalesce(sum(cap) {ahead}, 0D) AS left_over",
            f"sum(weight) OVER () - coalesce(sum(weight) {ahead}, 0D) AS left_weight",
        )
        # The first source in this order that is not capped fixes the level.
        .selectExpr("*", "min(if(left_over / left_weight <= reach, struct(reach, source, "
                         "left_over / left_weight AS level), NULL)) OVER () AS fixed")
    )
    target = "if(fixed IS NULL, cap, least(cap, fixed.level * weight)) AS target"
    return levelled.selectExpr("source", "docs", "source_size", target)


def take(
    drawn: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    max_epochs: int = MAX_EPOCHS,
    range_rows: int = RANGE_ROWS,
) -> DataFrame:
    """The drawn rows with ``source_size, target, taken``."""
    shares = landed(budgets(drawn, weights, max_epochs), "mix-budgets").selectExpr(
        "source AS s", "source_size", "target", f"1 + docs div {range_rows} AS ranges",
        # Whole words to take, split into whole epochs and a rest.
        "if(source_size = 0, 0, cast(floor(target) as bigint) div source_size) AS epochs",
        "if(source_size = 0, 0, cast(floor(target) as bigint) % source_size) AS rest",
    )
    cut = drawn.join(shares, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    # exp(-key) falls as the key grows: early keys lie in low ranges.
    cut = cut.withColumn("part", F.expr("cast(floor((1D - exp(-key)) * ranges) as bigint)"))
    before = "OVER (PARTITION BY s ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    parts = (
        cut.groupBy(F.col("source").alias("s"), F.col("part").alias("p"))
        .agg(F.sum("size").alias("words"))
        .selectExpr("s", "p", f"coalesce(sum(words) {before}, 0) AS part_start")
    )
    both = F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))
    ahead = (
        "OVER (PARTITION BY source, part ORDER BY key, doc_id, digest "
        "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    )
    placed = cut.join(parts, both).drop("s", "p")
    placed = placed.selectExpr("*", f"part_start + coalesce(sum(size) {ahead}, 0) AS start")
    taken = "cast(epochs * size + greatest(0, least(size, rest - start)) as bigint) AS taken"
    return placed.selectExpr("doc_id", "source", "digest", "size", "source_size", "target", taken)


def mix(docs: DataFrame, **options: object) -> DataFrame:
    """``docs`` as the mix holds them: a row for each time a document is taken.

    The last time may be partial; its text is then cut to the words taken.
    """
    amount = take(draws(docs), **options).where("taken > 0")
    times = (
        amount.groupBy("doc_id", "source", "digest")
        .agg(F.collect_list(F.struct("size", "taken")).alias("amounts"))
        .selectExpr("doc_id AS d", "source AS s", "digest AS g", "amounts")
    )
    numbered = docs.withColumn("digest", F.expr("md5(coalesce(text, ''))"))
    row = "row_number() OVER (PARTITION BY doc_id, source, digest ORDER BY doc_id) AS copy"
    same = (
        F.col("doc_id").eqNullSafe(F.col("d"))
        & F.col("source").eqNullSafe(F.col("s"))
        & (F.col("digest") == F.col("g"))
    )
    joined = numbered.selectExpr("*", row).join(times, same).where("copy <= size(amounts)")
    words = "element_at(amounts, copy).taken - n * element_at(amounts, copy).size"
    each = joined.selectExpr(
        "*",
        "explode(sequence(0, cast((element_at(amounts, copy).taken - 1) "
        "div element_at(amounts, copy).size as int))) AS n",
    )
    # Cut texts hold their words between single blanks; one document a source has one.
    cut = f"array_join(slice(regexp_extract_all(text, r'{SPACED_WORD}', 0), 1, cast({words} as int)), ' ')"
    text = f"if({words} >= element_at(amounts, copy).size, text, {cut})"
    return each.withColumn("text", F.expr(text)).select(*docs.columns)


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return take(draws(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op3_sql() -> str:
    """The same mix by one sort per source."""
    bits = f"('0x' || substr(md5(concat_ws('|', '{SEED}', doc_id, md5(coalesce(text, '')))), 1, 13))"
    listed = ", ".join(f"{w}.0" for w in WEIGHTS)
    ahead = "OVER (ORDER BY reach, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""
WITH sized AS (SELECT doc_id, text, source,
    coalesce(len(regexp_extract_all(text, '{SPACED_WORD}')), 0) AS size FROM documents),
  quality AS (SELECT *, CASE WHEN size = 0 THEN 0.05 ELSE greatest(0.05::DOUBLE,
      least(length(text) / size, 6.0::DOUBLE) / greatest(length(text) / size, 6.0::DOUBLE)) END::DOUBLE AS q
    FROM sized),
  drawn AS (SELECT doc_id, source, size, md5(coalesce(text, '')) AS digest,
    -ln((({bits})::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE) / q AS key FROM quality),
  sums AS (SELECT source, sum(size)::BIGINT AS source_size FROM drawn GROUP BY source),
  ranked AS (SELECT *, ([{listed}])[1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1)
      % {len(WEIGHTS)}]::DOUBLE AS weight, {MAX_EPOCHS}.0::DOUBLE * source_size AS cap,
    sum(source_size) OVER () AS total FROM sums),
  reached AS (SELECT *, cap / weight AS reach FROM ranked),
  levels AS (SELECT *, (total - coalesce(sum(cap) {ahead}, 0)) / (sum(weight) OVER ()
      - coalesce(sum(weight) {ahead}, 0)) AS level FROM reached),
  fixed AS (SELECT arg_min(level, (reach, source)) AS level FROM levels WHERE level <= reach),
  shares AS (SELECT source, source_size, CASE WHEN fixed.level IS NULL THEN cap
    ELSE least(cap, fixed.level * weight) END AS target FROM levels, fixed),
  placed AS (SELECT drawn.*, source_size, target, coalesce(sum(size) OVER (PARTITION BY drawn.source
      ORDER BY key, doc_id, digest ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
    FROM drawn JOIN shares ON drawn.source IS NOT DISTINCT FROM shares.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, CASE WHEN source_size = 0 THEN 0
  ELSE floor(target)::BIGINT // source_size * size
    + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END::BIGINT AS taken
FROM placed"""
