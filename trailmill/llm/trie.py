"""Conversation prefix trie by splitter skeleton.

Conversations are first rebuilt: turns ordered by ``turn`` (null first; equal
turns by role, then text), null role or text read as empty. Conversation ``c``
takes the first ``h = crc32(decimal c) % 4`` turns of conversation
``c - c % 20`` (all if fewer, none if there is no such conversation), then its
own turns after its first ``h``.

Every distinct sequence of the first ``d`` rebuilt turns (role, text) is a node
of depth ``d``; the root (``d = 0``) has no turn. Its members are the rebuilt
conversations that begin with it, turnless ones included in the root. A node
reports its smallest member (``conv_id``), its parent's (``parent_conv_id``,
null for the root), members, children, childless nodes of its subtree
(``n_leaves``, itself included), ``saved_tokens``: over its subtree, each node's
``(n_convs - 1)`` times the words of its last text, and ``ends_sha256``: the
SHA-256 of the comma-joined ascending ids of members with exactly ``d`` turns.

Method: every rebuilt conversation becomes one row whose sort key is the list
of its turns' 128-bit hashes. The rows are range-partitioned by that key and
sorted within each shard, so every node's members are one run of rows. Each
shard walks its rows with a stack and finishes every node that begins and ends
inside it. Only nodes on the path of a shard's first or last row can reach
into a neighbour: these form the skeleton, at most two paths per shard. Their
partial aggregates (members, smallest member, finished children, leaves,
saved tokens) are summed by a reduction, and the skeleton's own tree is closed
bottom-up in one small task (its size is bounded by twice the shards times the
longest shared path, not by the data). Ends are hashed in a separate sorted
stream per node, so no task holds a node's member list.

Nodes are identified by a 128-bit hash of their path; two different paths
would merge with a chance of about n^2 / 2^129. The root's key is (0, 0) and it
stands as its own parent key in the rows; depth tells it apart. Rows with a null conv_id are not
conversations and are left out; repeated rows are repeated turns. An empty
table gives no node (the root has no member). Only conv_id, turn, role and text
are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trailmill.llm.common import SPACED_WORD, landed, read

HEADS = 4
FAMILY = 20

PARTS = (
    "kind string, k1 long, k2 long, p1 long, p2 long, depth long, min_conv long, n_convs long, "
    "n_children long, n_leaves long, saved long, w long"
)
ENDS = "k1 long, k2 long, ends_sha256 string"
NODE = (
    "k1 long, k2 long, p1 long, p2 long, depth long, min_conv long, n_convs long, "
    "n_children long, n_leaves long, saved long"
)
ROOT = (0, 0)


def _child_key(parent: tuple[int, int], a: int, b: int) -> tuple[int, int]:
    digest = hashlib.blake2b(
        b"".join(x.to_bytes(8, "little", signed=True) for x in (*parent, a, b)), digest_size=16
    ).digest()
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def rebuilt(conversations: DataFrame) -> DataFrame:
    """conv_id, path (array of turn hashes, two longs a turn), words (array: words
    of each turn's text): one row per conversation, turnless ones included."""
    turns = (
        conversations.where("conv_id IS NOT NULL")
        .selectExpr("conv_id", "turn", "coalesce(role, '') AS role", "coalesce(text, '') AS text")
        .withColumn(
            "pos",
            F.row_number().over(Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")) - 1,
        )
        .selectExpr(
            "conv_id",
            "pos",
            "xxhash64(role, text) AS a",
            "xxhash64(text, role, 'turn') AS b",
            f"CAST(regexp_count(text, r'{SPACED_WORD}') AS BIGINT) AS w",
        )
    )
    ids = (
        turns.groupBy("conv_id")
        .agg(F.count("*").alias("n"))
        .selectExpr(
            "conv_id",
            "n",
            f"conv_id - conv_id % {FAMILY} AS base",
            f"CAST(crc32(CAST(CAST(conv_id AS STRING) AS BINARY)) % {HEADS} AS INT) AS h",
        )
    )
    bases = ids.selectExpr("conv_id AS base", "n AS base_n")
    ids = ids.join(bases, "base", "left").fillna(0, ["base_n"])
    heads = (
        turns.withColumnRenamed("conv_id", "base")
        .where(f"pos < {HEADS - 1}")
        .join(ids.select("conv_id", "base", "h"), "base")
        .where("pos < h")
        .selectExpr("conv_id", "pos AS at", "a", "b", "w")
    )
    own = (
        turns.join(ids.select("conv_id", "h", "base_n"), "conv_id")
        .where("pos >= h")
        .selectExpr("conv_id", "least(h, base_n) + pos - h AS at", "a", "b", "w")
    )
    lists = (
        heads.unionByName(own)
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "a", "b", "w"))).alias("t"))
        .selectExpr(
            "conv_id",
            "flatten(transform(t, x -> array(x.a, x.b))) AS path",
            "transform(t, x -> x.w) AS words",
        )
    )
    return (
        ids.select("conv_id")
        .join(lists, "conv_id", "left")
        .selectExpr("conv_id", "coalesce(path, array()) AS path", "coalesce(words, array()) AS words")
    )


class _Node:
    __slots__ = ("key", "parent", "depth", "w", "partial", "n", "min_conv", "children", "leaves", "saved")

    def __init__(self, key, parent, depth, w, partial):
        self.key, self.parent, self.depth, self.w, self.partial = key, parent, depth, w, partial
        self.n, self.min_conv, self.children, self.leaves, self.saved = 0, None, 0, 0, 0


def _shard(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk one sorted shard: finished nodes as ``node`` rows, skeleton nodes as
    ``part`` rows, and one ``end`` row per conversation (its deepest node)."""
    stack: list[_Node] = []
    pairs: list[tuple[int, int]] = []
    first = True
    out: list[tuple] = []

    def close(node: _Node, partial: bool) -> None:
        parent = node.parent if node.parent is not None else ROOT
        if partial or node.partial:
            out.append(("part", *node.key, *parent, node.depth, node.min_conv, node.n, node.children, node.leaves, node.saved, node.w))
            return
        leaves = node.leaves if node.children else 1
        saved = node.saved + (node.n - 1) * node.w
        out.append(("node", *node.key, *parent, node.depth, node.min_conv, node.n, node.children, leaves, saved, node.w))
        above = stack[-1]
        above.children += 1
        above.leaves += leaves
        above.saved += saved

    def flush() -> Iterator[pd.DataFrame]:
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PARTS.split(", ")])
            out.clear()

    for batch in batches:
        for conv, path, words in zip(batch["conv_id"], batch["path"], batch["words"], strict=True):
            turns = [(int(path[2 * i]), int(path[2 * i + 1])) for i in range(len(words))]
            if not stack:
                stack.append(_Node(ROOT, None, 0, 0, True))
            same = 0
            while same < len(pairs) and same < len(turns) and pairs[same] == turns[same]:
                same += 1
            while len(stack) - 1 > same:
                node = stack.pop()
                pairs.pop()
                close(node, False)
            for d in range(same, len(turns)):
                top = stack[-1]
                stack.append(_Node(_child_key(top.key, *turns[d]), top.key, d + 1, int(words[d]), first))
                pairs.append(turns[d])
            for node in stack:
                node.n += 1
                node.min_conv = conv if node.min_conv is None else min(node.min_conv, conv)
            out.append(("end", *stack[-1].key, 0, 0, stack[-1].depth, int(conv), 0, 0, 0, 0, 0))
            first = False
        yield from flush()
    while stack:
        node = stack.pop()
        if pairs:
            pairs.pop()
        close(node, True)
    yield from flush()


def _skeleton(parts: pd.DataFrame) -> pd.DataFrame:
    """Close the skeleton's tree bottom-up from its summed partial rows."""
    nodes = parts.sort_values("depth", ascending=False).to_dict("records")
    by_key = {(r["k1"], r["k2"]): r for r in nodes}
    for r in nodes:
        r["n_children"] = int(r["n_children"]) + int(r.pop("skel_children", 0))
        r["n_leaves"] = int(r["n_leaves"]) + int(r.pop("skel_leaves", 0)) if r["n_children"] else 1
        r["saved"] = int(r["saved"]) + int(r.pop("skel_saved", 0)) + (int(r["n_convs"]) - 1) * int(r["w"])
        up = by_key.get((r["p1"], r["p2"])) if r["depth"] > 0 else None
        if up is not None:
            up["skel_children"] = up.get("skel_children", 0) + 1
            up["skel_leaves"] = up.get("skel_leaves", 0) + r["n_leaves"]
            up["skel_saved"] = up.get("skel_saved", 0) + r["saved"]
    cols = [c.split()[0] for c in NODE.split(", ")]
    return pd.DataFrame([{c: r[c] for c in cols} for r in nodes], columns=cols)


def _hash_ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One sorted stream of (node, conv_id): SHA-256 of each node's ids, kept as a
    running state, so a node of many ends costs no memory."""
    key, digest, sep, out = None, None, b"", []
    for batch in batches:
        for k1, k2, conv in zip(batch["k1"], batch["k2"], batch["min_conv"], strict=True):
            if (k1, k2) != key:
                if key is not None:
                    out.append((*key, digest.hexdigest()))
                key, digest, sep = (k1, k2), hashlib.sha256(), b""
            digest.update(sep + str(int(conv)).encode())
            sep = b","
        if out:
            yield pd.DataFrame(out, columns=["k1", "k2", "ends_sha256"])
            out = []
    if key is not None:
        yield pd.DataFrame([(*key, digest.hexdigest())], columns=["k1", "k2", "ends_sha256"])


def trie(conversations: DataFrame, shards: int | None = None) -> DataFrame:
    """One row per node of the trie of rebuilt ``conversations``; see the module."""
    spark = conversations.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    walked = (
        rebuilt(conversations)
        .repartitionByRange(shards, "path", "conv_id")
        .sortWithinPartitions("path", "conv_id")
        .mapInPandas(_shard, PARTS)
    )
    walked = landed(walked, "trie-walk")
    local = walked.where("kind = 'node'").select(*[c.split()[0] for c in NODE.split(", ")])
    skeleton = (
        walked.where("kind = 'part'")
        .groupBy("k1", "k2", "p1", "p2", "depth", "w")
        .agg(
            F.min("min_conv").alias("min_conv"),
            F.sum("n_convs").alias("n_convs"),
            F.sum("n_children").alias("n_children"),
            F.sum("n_leaves").alias("n_leaves"),
            F.sum("saved").alias("saved"),
        )
        .withColumn("_one", F.lit(0))
        .groupBy("_one")
        .applyInPandas(lambda p: _skeleton(p.drop(columns="_one")), NODE)
    )
    nodes = local.unionByName(skeleton)
    ends = (
        walked.where("kind = 'end'")
        .select("k1", "k2", "min_conv")
        .repartition("k1", "k2")
        .sortWithinPartitions("k1", "k2", "min_conv")
        .mapInPandas(_hash_ends, ENDS)
    )
    empty = hashlib.sha256(b"").hexdigest()
    parents = nodes.selectExpr("k1 AS p1", "k2 AS p2", "min_conv AS parent_conv_id", "depth + 1 AS depth")
    return (
        nodes.join(parents, ["p1", "p2", "depth"], "left")
        .join(ends, ["k1", "k2"], "left")
        .selectExpr(
            "min_conv AS conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            "n_children",
            "n_leaves",
            "saved AS saved_tokens",
            f"coalesce(ends_sha256, '{empty}') AS ends_sha256",
        )
    )


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(read(spark, sf_dir, "conversations"))
