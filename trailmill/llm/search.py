"""Ranked lexical search: every benchmark item against every document.

Terms are the maximal runs of ``TERM`` in a text whose A-Z only are lower-cased.
``N`` counts the documents with a term and ``L`` all their terms; a document has
``n`` terms, a term is in ``df`` documents and ``tf`` times in one. With
``w = floor(1000 ln((2N + 2) / (2 df + 1)))`` (in doubles) and, in 64-bit
integers, ``m = 25 + (75 n N) div L``, a document scores, for an item,
``sum of w * ((10^9 tf) div (1000 tf + 8 m))`` over the item's terms, repeats
included. Each item returns its ``TOP`` highest-scoring documents with a score
above 0, equal scores by ascending doc_id (null last), ranks 1, 2, ...

Method: pipelined term partitioning. Postings of the items' terms are owned by
``STAGES`` term owners (a hash of the term). An item's bundle is a sparse
accumulator over documents; it is cut by document block (``BLOCK_DOCS`` documents
with query terms a block on average), so one bundle never holds more than a
block, however large the corpus. In stage ``s`` every bundle of a block is
cogrouped with the postings that owner ``s`` holds for that block, and the
integer contributions of the item's owner-``s`` terms are added in. After the last
stage each bundle keeps its block's ``TOP``; a rank window over those picks the
item's. The items' (term, count) rows of a stage reach its tasks as a broadcast
when there are at most ``BROADCAST_ASKED`` of them, else as rows copied to every
block. Postings and statistics are counted over all documents; nothing is cut.
Documents are tokenised once, in Arrow batches (a regular expression and a
counter per text); up to ``BROADCAST_TERMS`` query terms filter the postings
there, more are applied by a join.

Defined cases: null texts have no terms; null or repeated doc_ids are documents
of their own (ties between equal doc_ids by the order of the rows); null
item_ids are items; an item without terms, or whose terms no document holds,
returns nothing; empty tables give an empty result. Only ``doc_id``/``text`` and
``item_id``/``text`` are read, so other columns may have any names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmill.llm.common import LOWER, UPPER, landed, read

#: Letters and digits of ASCII, and every code point beyond it.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TOP = 10
STAGES = 3
BLOCK_DOCS = 4096
#: Distinct query terms broadcast to the scan of all documents at most.
BROADCAST_TERMS = 200_000
#: (item, term) rows sent to every task of a stage at most; beyond, they are copied to each block.
BROADCAST_ASKED = 200_000
LAST = 9_223_372_036_854_775_807

_TERMS = f"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), r'{TERM}', 0)"
ACC = "_item long, _row long, _d long, _dn boolean, acc long"


def _term_counts(frame: DataFrame, *keys: str) -> DataFrame:
    """``keys``, n (terms of the text) and ``tc``: its distinct terms with their counts,
    by sorting inside the row."""
    starts = "if(size(t) = 0, array(), filter(sequence(1, size(t)), i -> i = 1 OR t[i - 1] <> t[i - 2]))"
    runs = (
        "transform(st, (i, k) -> named_struct('term', t[i - 1], 'tf', "
        "CAST(if(k + 1 < size(st), st[k + 1], size(t) + 1) - i AS BIGINT)))"
    )
    bound = f"transform(array(sort_array({_TERMS})), t -> struct(size(t) AS n, element_at(transform(array({starts}), st -> {runs}), 1) AS tc))[0]"
    return frame.selectExpr(*keys, f"{bound} AS x").selectExpr(*keys, "CAST(x.n AS BIGINT) AS n", "x.tc AS tc")


TERM_RE = re.compile(TERM)
FOLD = str.maketrans(UPPER, LOWER)
SCANNED = "_row long, _d long, _dn boolean, n long, term string, tf long"


def _scanner(asked):
    """Terms of each text in a batch: a summary row (term None, tf = n) for a
    document with terms, and (term, tf) rows, of the asked terms only if given."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = None if asked is None else asked.value
        for batch in batches:
            rows = []
            for row, d, dn, text in zip(batch["_row"], batch["_d"], batch["_dn"], batch["text"], strict=True):
                terms = TERM_RE.findall((text or "").translate(FOLD))
                if not terms:
                    continue
                n = len(terms)
                rows.append((row, d, dn, n, None, n))
                rows.extend(
                    (row, d, dn, n, term, tf)
                    for term, tf in Counter(terms).items()
                    if wanted is None or term in wanted
                )
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCANNED.split(", ")])

    return scan


def _stage(last: bool, top: int, sent=None):
    def add(_key, acc: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        posts = right[right["kind"] == 0] if sent is None else right
        items = right[right["kind"] == 1] if sent is None else sent.value
        parts = [acc[["_item", "_row", "_d", "_dn", "acc"]]]
        if len(posts) and len(items):
            hit = items[["_item", "tk", "qtf"]].merge(posts[["tk", "_row", "_d", "_dn", "v"]], on="tk")
            hit["acc"] = hit["qtf"] * hit["v"]
            parts.append(hit[["_item", "_row", "_d", "_dn", "acc"]])
        both = pd.concat(parts, ignore_index=True)
        if both.empty:
            return both
        out = both.groupby(["_item", "_row", "_d", "_dn"], sort=False, as_index=False)["acc"].sum()
        if last:
            out = out[out["acc"] > 0].sort_values(["_item", "acc", "_dn", "_d", "_row"], ascending=[True, False, True, True, True])
            return out.groupby("_item", sort=False).head(top)
        # Rows of a document behind each other differ in item and sum only, so
        # the next stage's shuffle compresses better.
        return out.sort_values(["_row", "_item"])

    return add


def rank(docs: DataFrame, items: DataFrame, top: int = TOP, stages: int = STAGES, block_docs: int = BLOCK_DOCS) -> DataFrame:
    """item_id, rank, doc_id, score of every item of ``items`` (item_id, text)
    against all ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    keyed_items = items.select("item_id", "text").withColumn("_item", F.monotonically_increasing_id())
    item_terms = landed(
        _term_counts(keyed_items, "_item", "item_id").selectExpr("_item", "item_id", "inline(tc)")
        .withColumnRenamed("tf", "qtf"),
        "search-items",
    )
    wanted = item_terms.select("term").distinct()
    keyed = docs.selectExpr(
        "monotonically_increasing_id() AS _row", "coalesce(doc_id, 0L) AS _d", "doc_id IS NULL AS _dn", "text"
    )
    # One pass over the texts, in Arrow batches: a summary row per document
    # (term NULL, tf = n) and its postings of query terms, landed together.
    if wanted.count() <= BROADCAST_TERMS:
        # A checked number of terms of the stated query set, not of the corpus.
        asked = docs.sparkSession.sparkContext.broadcast(frozenset(r.term for r in wanted.collect()))
        scanned = keyed.mapInPandas(_scanner(asked), SCANNED)
    else:
        # Summary rows join by a key of their own (no term holds a NUL), so the
        # shuffled join does not gather them in one task.
        marked = wanted.selectExpr("term AS _k", "true AS _asked")
        scanned = (
            keyed.mapInPandas(_scanner(None), SCANNED)
            .withColumn("_k", F.expr("coalesce(term, concat(char(0), CAST(_row AS STRING)))"))
            .join(marked, "_k", "left")
            .where("term IS NULL OR _asked")
            .drop("_asked", "_k")
        )
    scanned = landed(scanned.selectExpr("_row", "if(_dn, NULL, _d) AS doc_id", "n", "term", "tf"), "search-scanned")
    stats = scanned.where("term IS NULL").agg(F.count("*").alias("n_docs"), F.sum("n").alias("n_terms"))
    postings = scanned.where("term IS NOT NULL").crossJoin(stats)
    weights = postings.groupBy("term").agg(F.count("*").alias("df"), F.first("n_docs").alias("n_docs")).selectExpr(
        "term", "CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w"
    )
    holders = postings.select("_row").distinct().count()
    blocks = max(1, math.ceil(holders / block_docs))
    owner = f"CAST(pmod(xxhash64(term), {stages}) AS INT)"
    # Not landed: each stage reads its owner's share from the landed postings.
    contributions = (
        postings.join(weights, "term").selectExpr(
            "term",
            "_row",
            f"coalesce(doc_id, {LAST}) AS _d",
            "doc_id IS NULL AS _dn",
            f"CAST(pmod(xxhash64(_row), {blocks}) AS INT) AS block",
            f"{owner} AS owner",
            "w * ((1000000000 * tf) div (1000 * tf + 8 * (25 + (75 * n * n_docs) div n_terms))) AS v",
        )
    )
    small = item_terms.count() <= BROADCAST_ASKED
    # Terms travel as their 64-bit hash when no two query terms share one
    # (checked on the query set, so the result stays exact), else as text.
    hashes = item_terms.agg(F.countDistinct("term").alias("t"), F.countDistinct(F.xxhash64("term")).alias("h")).first()
    tk = "xxhash64(term) AS tk" if hashes.t == hashes.h else "term AS tk"
    block_ids = spark.range(blocks).selectExpr("CAST(id AS INT) AS block")
    acc = spark.createDataFrame([], f"block int, {ACC}")
    right_cols = ["block", "kind", "tk", "_row", "_d", "_dn", "v", "_item", "qtf"]
    for s in range(stages):
        posts = contributions.where(f"owner = {s}").selectExpr("block", "0 AS kind", tk, "_row", "_d", "_dn", "v")
        asked = item_terms.where(f"{owner} = {s}").selectExpr("_item", tk, "qtf")
        sent = None
        if small:
            # A checked number of rows: the stated query set, not the corpus.
            sent = spark.sparkContext.broadcast(asked.toPandas())
            right = posts.drop("kind")
        else:
            copied = asked.crossJoin(block_ids).selectExpr(
                "block", "1 AS kind", "tk", "-1L AS _row", "0L AS _d", "false AS _dn", "0L AS v", "_item", "qtf"
            )
            filled = posts.selectExpr("*", "-1L AS _item", "0L AS qtf")
            right = filled.unionByName(copied).select(*right_cols)
        last = s == stages - 1
        out = acc.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(_stage(last, top, sent), ACC)
        acc = out.withColumn("block", F.pmod(F.xxhash64("_row"), F.lit(blocks)).cast("int")).select("block", *ACC_COLS)
    order = Window.partitionBy("_item").orderBy(F.desc("acc"), "_dn", "_d", "_row")
    return (
        acc.withColumn("rank", F.row_number().over(order))
        .where(f"rank <= {top}")
        .join(item_terms.select("_item", "item_id").distinct(), "_item")
        .selectExpr("item_id", "CAST(rank AS INT) AS rank", "if(_dn, NULL, _d) AS doc_id", "acc AS score")
    )


ACC_COLS = [c.split()[0] for c in ACC.split(", ")]


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op12_sql() -> str:
    terms = (
        "regexp_extract_all(translate(coalesce(text, ''), "
        f"'{UPPER}', '{LOWER}'), '{TERM}')"
    )
    return f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {terms} AS t FROM documents),
dn AS (SELECT r, doc_id, CAST(len(t) AS BIGINT) AS n FROM d),
stats AS (SELECT CAST(count(*) AS BIGINT) AS nd, CAST(sum(n) AS BIGINT) AS tl FROM dn WHERE n > 0),
dt AS (SELECT r, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, unnest(t) AS term FROM d) GROUP BY r, term),
qi AS (SELECT item_id, row_number() OVER () AS qr, {terms} AS t FROM benchmark),
qt AS (SELECT qr, item_id, term, CAST(count(*) AS BIGINT) AS qtf
       FROM (SELECT qr, item_id, unnest(t) AS term FROM qi) GROUP BY qr, item_id, term),
df AS (SELECT term, count(*) AS df FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY term),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * nd + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w
      FROM df, stats),
sc AS (SELECT qt.qr, qt.item_id, dn.r, dn.doc_id,
              CAST(sum(qt.qtf * w.w * ((1000000000 * dt.tf) // (1000 * dt.tf + 8 * (25 + (75 * dn.n * stats.nd) // stats.tl))))
                   AS BIGINT) AS score
       FROM qt JOIN w USING (term) JOIN dt USING (term) JOIN dn USING (r), stats
       GROUP BY qt.qr, qt.item_id, dn.r, dn.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY qr ORDER BY score DESC, doc_id ASC NULLS LAST, r) AS rank
       FROM sc WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM rk WHERE rank <= {TOP}
"""
