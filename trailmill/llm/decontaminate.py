"""Benchmark decontamination: which documents contain which test items.

Containment is the share of an item's distinct 5-word shingles that a document
holds; words are runs of ASCII letters, digits and anything beyond ASCII, in
lower case, so punctuation and layout do not hide a leak. A document is
contaminated by an item at 0.8 or more.

The search is containment MinHash: an item's sketch is its shingles with the
smallest hashes, and a document is a candidate when it holds one of them. Items
are partitioned by their number of shingles n, and the sketch length follows
from it: a document may miss at most ``n - ceil(0.8 n)`` shingles, so with one
more than that in the sketch no contaminated document is overlooked, however
long it is. (Banded signatures of whole documents cannot do that here: next to a
20,000-word document, a 40-word item changes one signature value in 500.)
Candidates are verified by counting all shingles of the item.

Items go to the tasks in blocks of at most ``ITEM_BLOCK`` items and ``ITEM_BYTES``
of text (a longer item goes alone), each block one pass over the documents, so
any number of items works.
Documents are read whole, and no document or pair is shuffled.

An item of one to four words is one shingle of that many words and is looked
for as such; null and empty items, and null and empty documents, match nothing.
Rows without ``doc_id`` are reported with it null; items without ``item_id``
likewise. Repeated rows repeat. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import kernels
from trailmill.llm.common import landed, read

WORDS = 5
THRESHOLD = 0.8
#: Items sent to the tasks at a time; their texts are cut at nothing.
ITEM_BLOCK = 20_000
ITEM_BYTES = 16 << 20
U = np.uint64


def needed(n: int, threshold: float) -> int:
    return max(1, int(np.ceil(threshold * n - 1e-9)))


def _words(texts: list[str | None]) -> Iterator[kernels.Words]:
    return kernels.words([t and t.lower() for t in texts], kernels.PLAIN)


class ItemIndex:
    """Sketches and full sets of a block of items, by words in a shingle."""

    def __init__(self, ids: list, texts: list[str | None], threshold: float):
        found = [
            (words, s)
            for part in _words(texts)
            for words, s in zip(part.counts, _per_text(part, WORDS, True), strict=True)
        ]
        kept = [(i, min(WORDS, w), s) for i, (w, s) in zip(ids, found, strict=True) if w]
        self.ids = [i for i, _, _ in kept]
        self.widths = np.array([w for _, w, _ in kept], np.int64)
        self.sets = [s for _, _, s in kept]
        self.need = np.array([needed(len(s), threshold) for s in self.sets], np.int64)
        sketches = [s[: len(s) - k + 1] for s, k in zip(self.sets, self.need, strict=True)]
        owner = np.repeat(np.arange(len(kept)), [len(s) for s in sketches])
        flat = np.concatenate(sketches) if sketches else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.hashes, self.owners = flat[order], owner[order]
        # A table by leading bits, so nearly all shingles of documents end after one look.
        self.table = np.zeros(1 << 20, bool)
        self.table[self.hashes >> U(44)] = True

    def candidates(self, hashes: np.ndarray, owner: np.ndarray) -> set[tuple[int, int]]:
        """Texts and items that meet at a sketch shingle."""
        may = np.flatnonzero(self.table[hashes >> U(44)])
        begin = np.searchsorted(self.hashes, hashes[may], "left")
        end = np.searchsorted(self.hashes, hashes[may], "right")
        pairs: set[tuple[int, int]] = set()
        for k in np.flatnonzero(end > begin):
            text = int(owner[may[k]])
            pairs.update((text, int(i)) for i in self.owners[begin[k] : end[k]])
        return pairs

    def leaks(self, texts: list[str | None]) -> Iterator[tuple[int, int, int]]:
        """``text, item, shared`` of all contaminated texts."""
        for part in _words(texts):
            for width in np.unique(self.widths):
                # Short items are whole texts of their width, hashed as such.
                hashes, owner = (
                    kernels.shingles(part, WORDS, whole=False) if width == WORDS else _windows(part, int(width))
                )
                bounds = np.searchsorted(owner, np.arange(len(part.counts) + 1))
                by_text: dict[int, list[int]] = {}
                for text, item in self.candidates(hashes, owner):
                    if self.widths[item] == width:
                        by_text.setdefault(text, []).append(item)
                for text, items in by_text.items():
                    held = np.unique(hashes[bounds[text] : bounds[text + 1]])
                    for item in items:
                        s = self.sets[item]
                        at = np.minimum(np.searchsorted(held, s), len(held) - 1)
                        shared = int((held[at] == s).sum())
                        if shared >= self.need[item]:
                            yield part.first + text, item, shared


def _per_text(part: kernels.Words, k: int, whole: bool) -> Iterator[np.ndarray]:
    hashes, owner = kernels.shingles(part, k, whole)
    bounds = np.searchsorted(owner, np.arange(len(part.counts) + 1))
    return (np.unique(hashes[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True))


def _windows(part: kernels.Words, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Runs of fewer than ``WORDS`` words, hashed like whole short texts."""
    text = np.repeat(np.arange(len(part.counts)), part.counts)
    n = len(part.hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    value = np.zeros(n, np.uint64)
    for j in range(width):
        value += part.hashes[j : j + n] * kernels.PLACE[j]
    inside = text[:n] == text[width - 1 :]
    return kernels.mix(value + U(width) * kernels.PLACE[8])[inside], text[:n][inside]


def blocks(rows: Iterable, most: int, most_bytes: int) -> Iterator[list]:
    """The rows in order, cut by number and by bytes of ``text``."""
    block, held = [], 0
    for row in rows:
        size = len((row["text"] or "").encode())
        if block and (len(block) == most or held + size > most_bytes):
            yield block
            block, held = [], 0
        block.append(row)
        held += size
    if block:
        yield block


def _leaking(
    docs: DataFrame,
    items: DataFrame,
    threshold: float = THRESHOLD,
    item_block: int = ITEM_BLOCK,
    item_bytes: int = ITEM_BYTES,
) -> DataFrame:
    """The rows of :func:`leaks` and ``content``, a hash of the document's text."""
    spark = docs.sparkSession
    schema = "doc_id bigint, content bigint, item_id bigint, n_shingles bigint, n_shared bigint"
    names = [c.split()[0] for c in schema.split(", ")]
    found = spark.createDataFrame([], schema)

    def one_pass(rows: list) -> DataFrame:
        # Built by each task from the sent texts.
        ids, texts = [r["item_id"] for r in rows], [r["text"] for r in rows]

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            index = ItemIndex(ids, texts, threshold)
            for batch in batches:
                doc_ids = batch["doc_id"].astype("Int64").to_numpy(object, na_value=None)
                contents = batch["content"].tolist()
                rows = [
                    (doc_ids[t], contents[t], index.ids[i], len(index.sets[i]), shared)
                    for t, i, shared in index.leaks(batch["text"].tolist())
                ]
                frame = pd.DataFrame(rows, columns=names)
                yield frame.astype({"doc_id": object, "item_id": object})

        return docs.selectExpr("doc_id", "text", "xxhash64(text) AS content").mapInPandas(run, schema)

    parts: list[DataFrame] = []
    asked = items.select(F.col("item_id").cast("bigint"), "text").toLocalIterator()
    for block in blocks(asked, item_block, item_bytes):
        if parts:  # all but the last are landed
            found = found.union(landed(parts.pop(), "leaks"))
        parts.append(one_pass(block))
    for part in parts:
        found = found.union(part)
    return found.withColumn("containment", F.expr("n_shared / cast(n_shingles as double)"))


def leaks(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """``doc_id, item_id, n_shingles, n_shared, containment`` of ``docs``
    (``doc_id, text``) and ``items`` (``item_id, text``). Options: ``threshold``,
    ``item_block``, ``item_bytes``."""
    return _leaking(docs, items, **options).drop("content")


def clean(docs: DataFrame, items: DataFrame, **options: object) -> DataFrame:
    """``docs`` without the contaminated ones.

    Rows are told apart by id and text, so others without id or with the same
    id stay.
    """
    dirty = _leaking(docs, items, **options).selectExpr("doc_id AS d", "content AS c").distinct()
    return docs.join(dirty, F.expr("doc_id <=> d AND xxhash64(text) = c"), "left_anti")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op4_sql() -> str:
    """The same pairs by joining all shingles."""

    def sets(table: str, key: str, widths: str) -> str:
        w = "regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
        return f"""SELECT DISTINCT r, {key}, k, array_to_string(w[i:i + k - 1], ' ') AS s FROM (
      SELECT *, unnest(range(1, len(w) - k + 2)) AS i FROM (
        SELECT r, {key}, w, unnest({widths}) AS k FROM (SELECT row_number() OVER () AS r, {key},
          {w} AS w FROM {table})) WHERE len(w) >= k)"""

    return f"""
WITH items AS ({sets("benchmark", "item_id", f"[least({WORDS}, len(w))]")}),
  kinds AS (SELECT DISTINCT k FROM items),
  sizes AS (SELECT r AS ir, item_id, k, count(*) AS n FROM items GROUP BY ALL),
  docs AS ({sets("documents", "doc_id", f"range(1, {WORDS + 1})")}),
  met AS (SELECT docs.r, doc_id, items.r AS ir, count(*) AS shared
    FROM docs JOIN items USING (k, s) GROUP BY ALL)
SELECT doc_id, item_id, n AS n_shingles, shared AS n_shared, shared / n::DOUBLE AS containment
FROM met JOIN sizes USING (ir) WHERE shared >= {THRESHOLD} * n - 1e-9"""
