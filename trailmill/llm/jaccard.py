"""Near-duplicate documents: an n-gram Jaccard join with vertical partitioning.

Documents are sets of 5-word shingles. All shingles stand in one global order,
that of their hashes, which is cut into fragments. A fragment knows everything
about its own shingles: who holds them, how many hold them, and how many of
them two documents share. What a decision about a document or a pair needs is
counted in each fragment separately and summed.

1. Documents with equal sets are one class; only classes go on.
2. The leading half of the order goes to fragments, as 32-bit numbers. Each
   counts per class the shingles that another class holds too. A class with
   over a fifth of its shingles to itself cannot reach 80 % with any other, so
   most classes end here. (A clash of numbers can only keep a class.)
3. The remaining classes go to fragments whole, which count how many classes
   hold each shingle. Per class, rarest shingles first, the prefix that any
   partner must touch is taken.
4. Candidate pairs meet at prefix shingles; length, position and the count of
   unshared shingles bound the overlap from above. First every class meets only
   the best member of each prefix shingle (a star). Then the fragments count
   the partial overlaps of those pairs, which are summed and decided exactly.
5. Linked classes form components. The second and last round meets the pairs of
   *different* components at prefix shingles, leaving out pairs within the
   largest component of a shingle. So a group of thousands of near copies costs
   a star, not all its pairs, and no link that could join two components is
   missed.

Two documents link when ``100 * |x & y| >= 80 * |x | y|``. A null or empty text
has an empty set and links with nothing. A text of one to four words is one
shingle. Rows without doc_id link with nothing and have no component. Repeated
rows are equal sets. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.llm import kernels
from trailmill.llm.common import landed, read
from trailmill.llm.graph import components
from trailmill.operators.joins import spread_left_lookup

#: Shingles in a fragment, about, and bytes of text for each.
FRAGMENT, BYTES = 1 << 21, 6
#: Documents that a worker packs together.
SLICE = 1000
U = np.uint64
OVERLAP = "9 * overlap >= 4 * (n_a + n_b)"  # 100 * o >= 80 * (n_a + n_b - o)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for the whole set."""
    return (
        int(s.sum(dtype=np.uint64).astype(np.int64)),
        int(kernels.mix(s ^ U(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64).astype(np.int64)),
    )


def _bits(shingles: float, at_most: int = 20) -> int:
    """log2 of the number of fragments."""
    return min(at_most, max(4, int(np.ceil(np.log2(max(1.0, shingles / FRAGMENT))))))


READ = (
    "doc_id bigint, n int, k1 bigint, k2 bigint, observed int, "
    "frag int, data binary, counts binary, keys binary"
)


def shingle_sets(docs: DataFrame, bits: int) -> DataFrame:
    """One row per document, and rows that pack the leading half of the order
    of many documents by fragment. Landed; documents have no ``frag``."""

    def pack(leading: list[np.ndarray], keys: list[tuple[int, int]]) -> pd.DataFrame:
        h = np.concatenate(leading)
        owner = np.repeat(np.arange(len(leading), dtype=np.int32), [len(x) for x in leading])
        frag = (h >> U(63 - bits)).astype(np.int32)
        order = np.argsort(frag, kind="stable")
        h, owner, frag = h[order], owner[order], frag[order]
        small = ((h >> U(31 - bits)) & U(0xFFFFFFFF)).astype(np.uint32)
        named = np.array(keys, np.int64).reshape(-1, 2)
        rows = []
        for f, a, b in zip(*_runs(frag), strict=True):
            who, counts = np.unique(owner[a:b], return_counts=True)
            rows.append((f, small[a:b].tobytes(), counts.astype(np.int32).tobytes(), named[who].tobytes()))
        return _wide(pd.DataFrame(rows, columns=["frag", "data", "counts", "keys"]))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            # Some documents at a time, so a worker holds little beside its batch.
            for at in range(0, len(batch), SLICE):
                part = batch.iloc[at : at + SLICE]
                rows, leading, keys = [], [], []
                for s in kernels.sets(part["text"].tolist()):
                    half = s[: np.searchsorted(s, U(1 << 63))]
                    key = _set_key(s)
                    rows.append((len(s), *key, len(half)))
                    if len(half) and key not in seen:  # copies in one task are sent once
                        if len(seen) < 100_000:
                            seen.add(key)
                        leading.append(half.copy())
                        keys.append(key)
                frame = pd.DataFrame(rows, columns=["n", "k1", "k2", "observed"])
                frame["doc_id"] = part["doc_id"].astype("Int64").to_numpy(object, na_value=None)
                yield _wide(frame)
                if leading:
                    yield pack(leading, keys)

    return landed(docs.select("doc_id", "text").mapInPandas(run, READ), "shingle-sets")


def _wide(frame: pd.DataFrame) -> pd.DataFrame:
    names = [c.split()[0] for c in READ.split(", ")]
    return frame.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each distinct value of a sorted array, where it begins and ends."""
    begin = np.flatnonzero(np.r_[True, sorted_values[1:] != sorted_values[:-1]]) if len(sorted_values) else np.zeros(0, int)
    return sorted_values[begin], begin, np.r_[begin[1:], len(sorted_values)] if len(begin) else begin


def shared_counts(packed: DataFrame) -> DataFrame:
    """``k1, k2, shared``: leading shingles that another class holds as well."""

    def count(part: pd.DataFrame) -> pd.DataFrame:
        keys = np.frombuffer(b"".join(part["keys"]), np.int64).reshape(-1, 2)
        counts = np.frombuffer(b"".join(part["counts"]), np.int32)
        h = np.frombuffer(b"".join(part["data"]), np.uint32)
        # A class that several tasks have sent counts once.
        named = np.ascontiguousarray(keys).view("V16").ravel()
        _, first = np.unique(named, return_index=True)
        once = np.zeros(len(named), bool)
        once[first] = True
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        kept = np.repeat(once, counts)
        h, owner = h[kept], owner[kept]
        order = np.argsort(h)
        h, owner = h[order], owner[order]
        same = h[1:] == h[:-1]
        shared = np.r_[same, False] | np.r_[False, same]
        total = np.bincount(owner[shared], minlength=len(keys))
        who = np.flatnonzero(total)
        return pd.DataFrame({"k1": keys[who, 0], "k2": keys[who, 1], "shared": total[who]})

    found = packed.groupBy("frag").applyInPandas(count, "k1 bigint, k2 bigint, shared bigint")
    return found.groupBy("k1", "k2").agg(F.sum("shared").alias("shared"))


def counted_sets(texts: DataFrame, bits: int) -> DataFrame:
    """``frag, sid, hashes, holders`` of classes ``sid, k1, k2, text``: the
    shingles of a class in each fragment and how many classes hold each."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part, rows = batch.iloc[at : at + SLICE], []
                sets = kernels.sets(part["text"].tolist())
                for sid, k1, k2, s in zip(part["sid"], part["k1"], part["k2"], sets, strict=True):
                    if _set_key(s) == (k1, k2):  # else another text of the same id
                        for f, a, b in zip(*_runs((s >> U(64 - bits)).astype(np.int32)), strict=True):
                            rows.append((f, sid, s[a:b].tobytes()))
                yield pd.DataFrame(rows, columns=["frag", "sid", "hashes"])

    def count(part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("sid")  # an id may stand in several equal rows
        h = np.frombuffer(b"".join(part["hashes"]), np.uint64)
        _, place, holders = np.unique(h, return_inverse=True, return_counts=True)
        ends = np.cumsum([len(x) // 8 for x in part["hashes"]])[:-1]
        each = np.split(holders[place].astype(np.int32), ends)
        return part.assign(holders=[x.tobytes() for x in each])

    cut_up = texts.select("sid", "k1", "k2", "text").mapInPandas(
        cut, "frag int, sid bigint, hashes binary"
    )
    return landed(
        cut_up.groupBy("frag").applyInPandas(
            count, "frag int, sid bigint, hashes binary, holders binary"
        ),
        "counted-sets",
    )


def _by_key(batches: Iterator[pd.DataFrame], key: str) -> Iterator[pd.DataFrame]:
    """Sorted rows, one frame per key, also where a key spans batches."""
    held: list[pd.DataFrame] = []
    for batch in batches:
        for _, group in batch.groupby(key, sort=False):
            if held and held[0][key].iloc[0] != group[key].iloc[0]:
                yield pd.concat(held)
                held = []
            held.append(group)
    if held:
        yield pd.concat(held)


def prefixes(counted: DataFrame) -> DataFrame:
    """``h, sid, n, u, pos``: shared shingles in the prefix of each class.

    ``u`` counts the shingles no other class holds; classes with too many of
    them are gone.
    """

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _by_key(batches, "sid"):
            h = np.frombuffer(b"".join(group["hashes"]), np.uint64)
            holders = np.frombuffer(b"".join(group["holders"]), np.int32)
            n, u = len(h), int((holders == 1).sum())
            if 5 * u > n:
                continue
            order = np.lexsort((h, holders))[: n - -(-4 * n // 5) + 1]
            pos = np.flatnonzero(holders[order] > 1)
            yield pd.DataFrame(
                {"h": h[order][pos].astype(np.int64), "sid": group["sid"].iloc[0], "n": n, "u": u, "pos": pos}
            )

    return landed(
        counted.repartition("sid")
        .sortWithinPartitions("sid")
        .mapInPandas(take, "h bigint, sid bigint, n int, u int, pos int"),
        "prefixes",
    )


#: How much two classes a and b that meet at a prefix shingle can share, against what they must.
POSSIBLE = (
    "9 * least(a.n - a.u, b.n - b.u, a.n - a.pos, b.n - b.pos) >= 4 * (a.n + b.n)"
)


def star_pairs(prefix: DataFrame) -> DataFrame:
    """Each class with the best member of each of its prefix shingles: the one
    with the smallest share of shingles to itself."""
    best = (
        prefix.groupBy("h")
        .agg(
            F.expr("min(struct(u / n AS share, sid, n, u, pos)) AS best"),
            F.count(F.lit(1)).alias("members"),
        )
        .where("members > 1")
        .selectExpr("h", "best.sid", "best.n", "best.u", "best.pos")
    )
    met = prefix.alias("a").join(best.alias("b"), F.expr(f"a.h = b.h AND a.sid <> b.sid AND {POSSIBLE}"))
    return met.selectExpr("greatest(a.sid, b.sid) AS a", "least(a.sid, b.sid) AS b").distinct()


def cross_pairs(prefix: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs of different components that meet at a prefix shingle, without
    looking at pairs inside the shingle's largest component."""
    placed = landed(
        prefix.join(labels.withColumnRenamed("node", "sid"), "sid", "left").selectExpr(
            "h", "sid", "n", "u", "pos", "coalesce(label, sid) AS label"
        ),
        "placed",
    )
    largest = (
        placed.groupBy("h", "label")
        .agg(F.count(F.lit(1)).alias("members"))
        .groupBy("h")
        .agg(F.expr("max(struct(members, label)).label AS most"), F.count(F.lit(1)).alias("labels"))
        .where("labels > 1")
        .drop("labels")
    )
    mixed = placed.join(largest, "h")
    met = mixed.where("label <> most").alias("a").join(
        mixed.alias("b"),
        F.expr(
            "a.h = b.h AND a.label <> b.label AND (b.label = b.most OR a.sid < b.sid) AND " + POSSIBLE
        ),
    )
    return met.selectExpr("greatest(a.sid, b.sid) AS a", "least(a.sid, b.sid) AS b").distinct()


def verified(counted: DataFrame, pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """The pairs that link: partial overlaps of each fragment, summed."""
    # Each class takes its smaller partners along to its fragments.
    partners = pairs.groupBy("a").agg(F.collect_list("b").alias("partners"))
    asked = partners.selectExpr("a AS sid").union(pairs.select("b")).distinct()
    sent = (
        counted.select("frag", "sid", "hashes")
        .join(asked, "sid")
        .join(partners.withColumnRenamed("a", "sid"), "sid", "left")
    )

    def count(part: pd.DataFrame) -> pd.DataFrame:
        part = part.reset_index(drop=True)
        place = pd.Series(part.index, part["sid"])
        arrays = [np.frombuffer(x, np.uint64) for x in part["hashes"]]
        a, b, shared = [], [], []
        for k, others in enumerate(part["partners"]):
            if others is None:
                continue
            mine, sid = arrays[k], part["sid"][k]
            here = place.reindex(others)
            here = here[here.notna()].astype(int)
            if here.empty:
                continue
            theirs = [arrays[j] for j in here]
            owner = np.repeat(np.arange(len(theirs)), [len(x) for x in theirs])
            flat = np.concatenate(theirs)
            hit = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            total = np.bincount(owner[hit], minlength=len(theirs))
            for other, t in zip(here.index, total, strict=True):
                if t:
                    a.append(sid)
                    b.append(other)
                    shared.append(t)
        return pd.DataFrame({"a": a, "b": b, "overlap": shared}, dtype="int64")

    partial = sent.groupBy("frag").applyInPandas(count, "a bigint, b bigint, overlap bigint")
    summed = partial.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"))
    return (
        summed.join(sizes.selectExpr("sid AS a", "n AS n_a"), "a")
        .join(sizes.selectExpr("sid AS b", "n AS n_b"), "b")
        .where(OVERLAP)
        .select("a", "b", "overlap")
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` and the class key ``k1, k2``."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    sets = shingle_sets(docs, _bits(size / BYTES / 2))
    rows = sets.where("frag IS NULL").select("doc_id", "n", "k1", "k2", "observed")
    classes = landed(
        rows.where("doc_id IS NOT NULL AND n > 0")
        .groupBy("k1", "k2")
        .agg(F.min("doc_id").alias("rep"), F.min("n").alias("n"), F.min("observed").alias("observed")),
        "classes",
    )
    shared = shared_counts(sets.where("frag IS NOT NULL").select("frag", "data", "counts", "keys"))
    # Sets of fewer than four shingles link with equal ones only.
    left = landed(
        classes.where("n >= 4")
        .join(shared, ["k1", "k2"], "left")
        .where("5 * (observed - coalesce(shared, 0)) <= n")
        .select(F.monotonically_increasing_id().alias("sid"), "rep", "k1", "k2", "n"),
        "left-classes",
    )
    shingles = left.agg(F.sum("n")).first()[0] or 0
    # The remaining classes grow with the corpus: sorted and merged, never broadcast.
    texts = docs.select("doc_id", "text").join(
        left.withColumnRenamed("rep", "doc_id").hint("merge"), "doc_id"
    )
    counted = counted_sets(texts, _bits(2 * shingles))
    prefix = prefixes(counted)
    sizes = left.select("sid", "n")
    links = landed(verified(counted, landed(star_pairs(prefix), "star-pairs"), sizes), "star-links")
    more = cross_pairs(prefix, components(links.select("a", "b")))
    crossing = landed(verified(counted, landed(more, "cross-pairs"), sizes), "cross-links")
    labels = components(links.union(crossing).select("a", "b")).withColumnRenamed("node", "sid")
    named = labels.join(left.select("sid", "k1", "k2", "rep"), "sid")
    smallest = named.groupBy("label").agg(F.min("rep").alias("component"))
    linked = named.join(smallest, "label").select("k1", "k2", "component")
    whole = classes.join(linked, ["k1", "k2"], "left").selectExpr(
        "k1", "k2", "coalesce(component, rep) AS component"
    )
    # A set may be that of a third of all documents.
    return spread_left_lookup(rows, whole, ["k1", "k2"]).selectExpr(
        "doc_id",
        "cast(n as bigint) AS n_shingles",
        "if(n = 0 OR doc_id IS NULL, doc_id, component) AS component_id",
        "k1",
        "k2",
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that with
    the smallest id. Of repeated rows one stays."""
    kept = near_duplicates(docs).where("doc_id = component_id").select("doc_id").distinct()
    alone = docs.where("doc_id IS NULL")
    return docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).union(alone)


def op2_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents")).select(
        "doc_id", "n_shingles", "component_id"
    )
