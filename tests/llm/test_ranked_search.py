"""Ranked lexical search against its SQL, on small tables with the awkward cases."""

from __future__ import annotations

import duckdb
import pandas as pd

from trailmill.llm import search


def key(row):
    return tuple((x is None, x) if not isinstance(x, str) else (False, x) for x in row)


def both(spark, docs, items, **kw):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, n bigint, _row string")
    b = spark.createDataFrame(items, "item_id bigint, text string, qtf string")
    got = sorted((tuple(r) for r in search.rank(d.repartition(3), b, **kw).collect()), key=key)
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(docs, columns=["doc_id", "text", "n", "_row"]))
    con.register("benchmark", pd.DataFrame(items, columns=["item_id", "text", "qtf"]))
    exp = sorted((tuple(r) for r in con.sql(search.op12_sql()).fetchall()), key=key)
    return got, exp


DOCS = [
    (1, "The cat sat on the mat.", 0, "x"),
    (2, "A CAT and a dog; the dog barks", 0, "x"),
    (3, None, 0, "x"),
    (4, "", 0, "x"),
    (5, "über straße Über 42 cat42 cat", 0, "x"),
    (6, "The cat sat on the mat.", 0, "x"),
    (6, "The cat sat on the mat.", 0, "x"),
    (None, "cat cat cat", 0, "x"),
    (7, "dog " * 5000, 0, "x"),
]
ITEMS = [
    (10, "the cat", "a"),
    (11, "dog dog über", "a"),
    (12, None, "a"),
    (None, "mat 42", "a"),
    (13, "nothing matches zzz", "a"),
    (10, "the cat", "a"),
]


def test_matches_sql_with_nulls_ties_and_repeats(spark):
    got, exp = both(spark, DOCS, ITEMS)
    assert got == exp
    assert {r[0] for r in got} == {10, 11, None}


def test_every_stage_and_block_count_agrees(spark):
    base, _ = both(spark, DOCS, ITEMS)
    for stages, block_docs in ((1, 1), (5, 2), (2, 1000)):
        got, _ = both(spark, DOCS, ITEMS, stages=stages, block_docs=block_docs)
        assert got == base


def test_top_cut_with_many_equal_scores(spark):
    docs = [(i, "alpha beta", 0, "x") for i in range(30, 0, -1)]
    got, exp = both(spark, docs, [(1, "alpha", "a")], block_docs=4)
    assert got == exp and [r[2] for r in got] == list(range(1, 11))


def test_empty_tables(spark):
    assert both(spark, [], ITEMS) == ([], [])
    assert both(spark, DOCS, []) == ([], [])


def test_unbroadcast_paths_agree(spark, monkeypatch):
    monkeypatch.setattr(search, "BROADCAST_ASKED", 0)
    monkeypatch.setattr(search, "BROADCAST_TERMS", 0)
    got, exp = both(spark, DOCS, ITEMS, block_docs=2)
    assert got == exp
