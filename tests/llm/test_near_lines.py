"""Near duplicates, line dedup, decontamination and the pipeline, against brute force."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
import pytest
from conftest import SMALL
from llm_fixtures import LOWER, docs_of, tables  # noqa: F401
from oracle_compare import difference

import corpus_pipeline
from trailmill.llm import decontaminate, jaccard, kernels, lines
from trailmill.llm.graph import components

SPACED = re.compile(r"[^\x20\x09-\x0D]+")


def shingle_set(text):
    w = SPACED.findall((text or "").translate(LOWER))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def brute_components(pairs):
    """doc_id -> smallest doc_id of its group."""
    sets = defaultdict(list)
    for i, text in pairs:
        sets[i].append(shingle_set(text))
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(
                x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]
            ):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {i: find(i) for i in ids}


def edited(words, rng, edits):
    w = list(words)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def groups(seed):
    """Texts in groups of near copies, chains of drifting copies and shared passages."""
    rng = random.Random(seed)
    passage = [f"p{k}" for k in range(30)]
    texts = [None, "", "  \t", "One", "one", "a b c d", "A B  c D", "a b c d e", "a b c d e f"]
    for _ in range(6):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(6, 200))]
        drift = base
        for _ in range(12):
            texts.append(" ".join(edited(base, rng, rng.randrange(4))))
            drift = edited(drift, rng, 1)
            texts.append(" ".join(drift + (passage if rng.random() < 0.5 else [])))
            texts.append(" ".join(base[: len(base) - rng.randrange(len(base) // 3)]))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_brute_force(spark, docs_of, seed):
    pairs = groups(seed)
    got = jaccard.near_duplicates(docs_of(*pairs, (None, "a b c d e"), partitions=3)).collect()
    expected = brute_components(pairs)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["n_shingles"] == 1
        else:
            text = dict(pairs)[r["doc_id"]]
            assert (r["n_shingles"], r["component_id"]) == (len(shingle_set(text)), expected[r["doc_id"]])
    assert len(got) == len(pairs) + 1


def test_registered_join_against_brute_force(spark, tables):
    pairs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    got = {r["doc_id"]: r["component_id"] for r in jaccard.op2_ngram_jaccard(spark, SMALL).collect()}
    assert got == brute_components(pairs)


def test_hot_group_makes_a_star(spark, docs_of):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(120)]
    docs = docs_of(*[(k, " ".join(edited(base, rng, 1))) for k in range(300)], partitions=4)
    assert jaccard.near_duplicates(docs).select("component_id").distinct().count() == 1
    assert jaccard.keep_one(docs).count() == 1


def test_keep_one(spark, docs_of):
    rows = [(5, "x y z u v w"), (3, "x y z u v w"), (3, "x y z u v w"), (9, None), (8, ""), (None, "x y")]
    kept = jaccard.keep_one(docs_of(*rows)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["3", "8", "9", "None"]
    assert jaccard.keep_one(docs_of(*rows).limit(0)).count() == 0


def test_components(spark):
    links = [(k, k + 1) for k in range(100, 160)] + [(7, k) for k in range(8, 40)] + [(1, 1), (2, 1), (1, 2)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    assert {got[k] for k in range(100, 161)} == {100} and {got[k] for k in range(7, 40)} == {7}
    assert got[2] == 1
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_kernels_match_sets():
    rng = random.Random(8)
    letters = "ab CÄé\t\n\r🙂 A"
    texts = ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(400)] + [None, "x " * 300_000]
    for text, got in zip(texts, kernels.sets(texts), strict=True):
        assert len(got) == len(shingle_set(text))
    first, second = list(kernels.sets(["A b c d e f", "q a B c d e"]))
    assert len(np.intersect1d(first, second)) == 1


# Lines


def test_recurring_lines_go(spark, docs_of):
    shared = "this very same passage stands in many of the texts"
    rows = [(k, f"own {k} begin word{'abcdefgh'[k]}\n{shared}\n\nend text{'abcdefgh'[k]}") for k in range(6)]
    rows += [(10, "only here"), (11, None), (12, ""), (13, "only here\nand there")]
    got = {r["doc_id"]: r for r in lines.dedup(docs_of(*rows)).collect()}
    assert shared in got[0]["text"] and got[0]["n_dropped"] == 0
    for k in range(1, 6):
        assert shared not in got[k]["text"] and "\n\nend" in got[k]["text"]
    assert got[11]["text"] is None and got[12]["text"] == "" and got[11]["n_lines"] == 0
    assert got[10]["text"] == "only here" and got[13]["text"] == "only here\nand there"  # in two texts only
    assert lines.dedup(docs_of(*rows).limit(0)).count() == 0


def test_fields_are_generalised(spark, docs_of):
    rows = [(k, f"page {k} of 12\nunique{'abcdef'[k]} words") for k in range(6)]
    names = ["anna", "bert", "cleo", "dora", "emil"]
    rows += [(20 + k, f"this text was posted on our site by {n} for all to read\nmore{n} text") for k, n in enumerate(names)]
    rows += [(40, "this text was posted under another name and has nothing else alike")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs_of(*rows)).collect()}
    assert got[0].startswith("page 0") and all("page" not in got[k] for k in range(1, 6))
    assert "anna" in got[20] and all("posted" not in got[20 + k] for k in range(1, 5))
    assert got[40] == rows[-1][1]


def test_copies_and_repeats_are_left(spark, docs_of):
    rows = [(k, "the whole text is copied as it is\nline two of it") for k in range(5)] + [(0, "the whole text is copied as it is\nline two of it")]
    assert {r["text"] for r in lines.dedup(docs_of(*rows)).collect()} == {rows[0][1]}


def brute_exact(pairs):
    """Texts without lines that stand in three different texts, but for their first place."""
    where = defaultdict(dict)
    masked = lambda line: " ".join("<*>" if re.search(r"\d", t) else t for t in line.split())
    for i, text in sorted(pairs, key=lambda p: p[0]):
        for n, line in enumerate((text or "").split("\n")):
            if masked(line):
                where[masked(line)].setdefault(text, (i, n))
    out = {}
    for i, text in pairs:
        kept = [
            line
            for n, line in enumerate((text or "").split("\n"))
            if len(where.get(masked(line), {})) < 3 or min(where[masked(line)].values()) == (i, n)
        ]
        out[i] = "\n".join(kept) if text is not None else None
    return out


def test_registered_lines_against_brute_force(spark, tables):
    pairs = tables.execute("SELECT doc_id, text FROM documents").fetchall()
    exact = brute_exact(pairs)
    got = {r["doc_id"]: r["text"] for r in lines.op10_line_dedup(spark, SMALL).collect()}
    assert got.keys() == exact.keys()
    # Generalised templates drop more lines, never others of the exact ones.
    for i, text in got.items():
        left = exact[i].split("\n")
        assert len(text.split("\n")) <= len(left) or text == exact[i]
    assert sum(got[i] == exact[i] for i in got) >= 0.9 * len(got)


# Decontamination


def test_decontamination_matches_sql(spark, tables):
    frame = decontaminate.op4_decontamination(spark, SMALL)
    assert difference(frame.toPandas(), tables.execute(decontaminate.op4_sql()).df()) is None


def test_leaks(spark, docs_of):
    item = " ".join(f"q{k}" for k in range(40))
    part = item.replace("q3 ", "Q3, ").replace("q39", "zz")
    items = spark.createDataFrame(
        [(1, item, "n"), (2, None, "n"), (3, "", "n"), (4, "Two words", "n"), (4, "Two words", "n")],
        "item_id bigint, text string, doc_id string",
    )
    long = " ".join(f"f{k}" for k in range(40_000))
    rows = [(1, f"{long} {item.upper()}! {long}"), (2, part), (3, long), (4, "say two-words now"), (5, None), (6, ""), (None, item)]
    for block in (1, 1000):
        got = decontaminate.leaks(docs_of(*rows), items, item_block=block).collect()
        assert sorted((str(r["doc_id"]), r["item_id"], r["n_shared"]) for r in got) == [
            ("1", 1, 36), ("2", 1, 35), ("4", 4, 1), ("4", 4, 1), ("None", 1, 36),
        ]
    assert sorted(r["doc_id"] for r in decontaminate.clean(docs_of(*rows), items).collect()) == [3, 5, 6]
    assert decontaminate.leaks(docs_of(*rows), items.limit(0)).count() == 0
    assert decontaminate.clean(docs_of(*rows).limit(0), items).count() == 0


# The pipeline


def test_pipeline_stages(spark, tables):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.columns
        docs = corpus_pipeline.landed(stage(spark, docs, SMALL), name)
        assert docs.columns == before
        kept[name] = docs
    assert list(kept) == ["language_id", "line_dedup", "near_duplicates", "decontamination", "source_mix"]
    deduped = [tuple(r) for r in kept["line_dedup"].select("doc_id", "text").collect()]
    expected = brute_components(deduped)
    left = {r["doc_id"] for r in kept["near_duplicates"].collect()}
    assert left == set(expected.values())
    dirty = {r["doc_id"] for r in decontaminate.leaks(kept["near_duplicates"], spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    assert {r["doc_id"] for r in kept["decontamination"].collect()} == left - dirty
    counts = kept["line_dedup"].selectExpr("count_if(n_chars <> char_length(text)) AS n").first()
    assert counts["n"] == 0


def test_pipeline_of_an_empty_table(spark, docs_of):
    docs = docs_of((1, "x")).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.landed(stage(spark, docs, SMALL), name)
    assert docs.count() == 0
