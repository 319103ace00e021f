"""License scan and source mix."""

from __future__ import annotations

from collections import defaultdict

import pytest
from conftest import SMALL
from llm_fixtures import docs_of, tables  # noqa: F401
from oracle_compare import difference

from trailmill.llm import licenses, mixing


def rows(frame, *columns):
    return sorted(frame.select(*columns).collect(), key=str)


@pytest.mark.parametrize(
    "query, sql",
    [
        (licenses.op1_license_scan, licenses.op1_sql),
        (mixing.op3_source_mix, mixing.op3_sql),
    ],
)
def test_matches_sql(spark, tables, query, sql):
    frame = query(spark, SMALL)
    assert difference(frame.toPandas(), tables.execute(sql()).df()) is None
    assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()


def test_license_edges(spark, docs_of):
    docs = docs_of(
        (1, "All Rights\nRESERVED, all rights reserved"),
        (2, None),
        (3, ""),
        (4, "under the apache license version 2, licensed; nothing else"),
        (5, "General   public-license cc/by"),
        (5, "General   public-license cc/by"),
        (6, "word " * 30_000 + "cc by"),
    )
    found = {
        (r["doc_id"], r["n_words"]): r
        for r in licenses.scan(docs.select("doc_id", "text")).collect()
    }
    assert [p["word"] for p in found[1, 6]["places"]] == [0, 3]
    assert found[2, 0]["places"] == [] == found[3, 0]["places"]
    assert [t["template"] for t in found[4, 9]["templates"]] == ["apache-2.0"]
    assert {p["label"] for p in found[5, 5]["places"]} == {"gpl", "cc-by"}
    assert [p["word"] for p in found[6, 30_002]["places"]] == [30_000]
    assert licenses.scan(docs).count() == 7
    assert licenses.scan(docs.limit(0)).count() == 0


def brute_containment(text, threshold):
    found = set()
    for block, line in enumerate((text or "").lower().split("\n")):
        words = set("".join(c if c.isalnum() else " " for c in line).split())
        for name, template in licenses.TEMPLATES.items():
            t = set(template.split())
            if len(words & t) >= threshold * len(t) - 1e-9:
                found.add((block, name))
    return found


def test_templates_against_brute_force(spark, docs_of):
    texts = [
        "licensed under cc by nc 4 0 today\nreleased under the mit license",
        "redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the conditions are met",
        "the of and in to is for with\nthis work is licensed under the gnu general public license",
        "rights all reserved reserved",
    ]
    for threshold in (0.6, 0.85, 1.0):
        got = defaultdict(set)
        docs = docs_of(*enumerate(texts))
        for r in licenses.template_matches(docs, threshold=threshold).collect():
            got[r["doc_id"]].add((r["block"], r["template"]))
        for k, text in enumerate(texts):
            assert got[k] == brute_containment(text, threshold)


def test_mix_targets(spark, docs_of):
    made = [(k, "w " * (k % 7 + 1), None, s) for k, s in enumerate("aaaaabbc" * 40)]
    docs = docs_of(*made, (1000, None, None, None), (1001, "one two", None, None))
    taken = mixing.take(mixing.draws(docs), range_rows=16).collect()
    total = sum(r["size"] for r in taken)
    by = defaultdict(list)
    for r in taken:
        by[r["source"]].append(r)
        assert 0 <= r["taken"] <= 3 * r["size"]
    targets = {s: v[0]["target"] for s, v in by.items()}
    assert sum(targets.values()) == pytest.approx(total)
    for s, v in by.items():
        assert sum(r["taken"] for r in v) == int(targets[s] + 1e-9)
        assert targets[s] <= 3 * v[0]["source_size"] + 1e-9
    assert targets[None] == 6.0  # capped at three times its two words
    assert targets["a"] / targets["b"] == pytest.approx(5 / 2)


def test_mix_is_steady_and_whole(spark, docs_of):
    made = [(k, f"t{k} " * (k % 5 + 1), None, "ab"[k % 2]) for k in range(60)]
    made += [(7, "t7 t7 t7 ", None, "b"), (8, "", None, "a"), (None, "no id", None, "a")]
    first = mixing.mix(docs_of(*made)).collect()
    again = mixing.mix(docs_of(*made, partitions=5)).collect()
    assert sorted(map(str, first)) == sorted(map(str, again))
    amounts = mixing.take(mixing.draws(docs_of(*made))).collect()
    assert sum(len(r["text"].split()) for r in first) == sum(r["taken"] for r in amounts)
    assert mixing.mix(docs_of(*made).limit(0)).count() == 0


def test_better_documents_are_drawn_first(spark, docs_of):
    docs = docs_of(*[(k, "w w w w", None, "a") for k in range(400)], *[(k + 400, "w w w w", None, "b") for k in range(4)])
    drawn = mixing.draws(docs, quality="if(doc_id < 200, 10D, 0.1D)")
    keys = sorted((r["key"], r["doc_id"]) for r in drawn.where("source = 'a'").collect())
    assert sum(d < 200 for _, d in keys[:200]) > 180
