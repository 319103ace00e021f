"""Conversation trie against a plain Python trie, with awkward rows and shard counts."""

from __future__ import annotations

import duckdb
from conftest import SMALL
from trie_brute import brute

from trailmill.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, k1 string, depth string"


def spark_rows(frame, **kw):
    return sorted((tuple(r) for r in trie.trie(frame, **kw).collect()), key=lambda r: (r[1], r[0]))


ROWS = [
    (0, 0, "user", "hello there", "x", "y"),
    (0, 1, "assistant", "hi", "x", "y"),
    (0, 2, "user", "bye now", "x", "y"),
    (1, 0, "user", "hello there", "x", "y"),
    (1, 1, "assistant", "hi", "x", "y"),
    (3, None, None, None, "x", "y"),
    (3, 1, "user", "x y z", "x", "y"),
    (3, 1, "user", "x y z", "x", "y"),
    (5, 2, "user", "a", "x", "y"),
    (5, 0, "user", "b", "x", "y"),
    (21, 0, "user", "only base absent", "x", "y"),
    (40, 0, "user", "hello there", "x", "y"),
    (47, 0, "user", "q", "x", "y"),
    (47, 1, "assistant", "   ", "x", "y"),
    (None, 0, "user", "no id", "x", "y"),
    *[(60 + i, 0, "user", "hello there", "x", "y") for i in range(15)],
    *[(60 + i, 1, "assistant", "hi", "x", "y") for i in range(15)],
]


def test_matches_plain_trie_at_every_shard_count(spark):
    frame = spark.createDataFrame(ROWS, SCHEMA)
    exp = brute([r[:4] for r in ROWS])
    for shards in (1, 2, 3, 7, 40):
        assert spark_rows(frame.repartition(3), shards=shards) == exp


def test_registered_table(spark):
    frame = spark.read.parquet(f"{SMALL}/conversations.parquet")
    exp = brute(duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{SMALL}/conversations.parquet'").fetchall())
    assert spark_rows(frame, shards=5) == exp


def test_empty_table(spark):
    assert spark_rows(spark.createDataFrame([], SCHEMA)) == []
