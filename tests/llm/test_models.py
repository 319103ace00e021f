"""Language ID, secret scan and toxicity."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
from conftest import SMALL
from llm_fixtures import docs_of, tables  # noqa: F401

from trailmill.llm import langid, secrets, toxicity

MEDIUM = SMALL.replace("0.001", "0.1")


def test_language_accuracy_on_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang")
    judged = langid.op6_language_id(spark, MEDIUM).join(docs, "doc_id")
    held = judged.where("held_out").selectExpr(
        "avg(if(lang_pred = lang, 1D, 0D)) AS accuracy", "avg(if(rejected, 1D, 0D)) AS rejected"
    ).first()
    assert held["accuracy"] > 0.98 and held["rejected"] < 0.01
    some = judged.limit(50).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in some)


def test_language_edges(spark, docs_of):
    english = ["the cat and the dog of the house is here", "this is the house of the cat and that"] * 3
    german = ["der hund und die katze in das haus ist hier", "das ist die katze und der hund in der"] * 3
    labelled = docs_of(
        *[(k, f"{t} {k}", "en") for k, t in enumerate(english)],
        *[(k, f"{t} {k}", "de") for k, t in enumerate(german)],
        (99, None, "fr"), (98, "rien", None),
    )
    learned = langid.train(labelled)
    assert set(learned) == {"en", "de"}
    texts = [(1, "the dog and the cat"), (2, None), (3, ""), (4, "12 34 !"), (5, "die katze und der hund"),
             (6, "the house of the cat and the dog " * 3000)]
    got = {r["doc_id"]: r for r in langid.identify(docs_of(*texts), learned).collect()}
    assert [got[k]["lang_pred"] for k in range(1, 7)] == ["en", "und", "und", "und", "de", "en"]
    assert got[2]["rejected"] and got[4]["score"] == 0 and not got[6]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = langid.identify(docs_of(*texts), {})
    assert {r["lang_pred"] for r in none.collect()} == {"und"}
    assert langid.train(labelled.limit(0)) == {}
    assert langid.identify(docs_of(*texts).limit(0), learned).count() == 0


def test_ambiguous_texts_are_rejected():
    same = langid.dictionary(["a b c d", "a b c d"])
    assert langid.Classifier({"x": same, "y": same}).judge("a b c d a b c")[2]


def digest(text):
    spans = sorted(secrets.base_spans(text), key=lambda s: (s[1], secrets.KINDS.index(s[0])))
    return hashlib.sha256(",".join(":".join(map(str, s)) for s in spans).encode()).hexdigest()


def test_secret_query_against_plain_scan(spark, tables):
    found = secrets.op5_secret_scan(spark, MEDIUM.replace("0.1", "0.01")).collect()
    texts = dict(spark.read.parquet(f"{MEDIUM.replace('0.1', '0.01')}/documents.parquet").select("doc_id", "text").collect())
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["doc_id"]] or ""
        assert r["base_sha256"] == digest(text)
        spans = [s.split(":") for s in r["spans"].split(",") if s]
        base = [(k, int(a), int(b)) for k, a, b in spans if k != "random"]
        assert sorted(base) == sorted(secrets.base_spans(text))
        assert [int(a) for _, a, _ in spans] == sorted(int(a) for _, a, _ in spans)


def test_secret_edges(spark, docs_of):
    key = "AKIA" + "Z9" * 8
    rows = [
        (1, f'é🙂 Api_Key" : "{key}" x'), (2, None), (3, ""), (4, "password=12345 token=123456"),
        (5, "AKIA123 " + "a" * 23 + " " + "b" * 24), (6, "x " * 100_000 + "secret = abcdefgh"),
    ]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secrets.scan(docs_of(*rows).select("doc_id", "text")).collect()}
    assert got[2] == got[3] == []
    text = rows[0][1]
    assert ("access", text.index("AKIA"), text.index("AKIA") + 20) in got[1]
    assert got[1][0] == ("assign", 3, text.index("AKIA") + 20)
    assert got[4] == [("assign", 15, 27)]
    assert got[5] == [("hex", 32, 56)]
    assert got[6] == [("assign", 200_000, 200_017)]
    assert secrets.scan(docs_of(*rows).select("doc_id", "text").limit(0)).count() == 0


def test_battery_tells_random_from_made_up(spark, docs_of):
    rng = random.Random(5)
    letters = secrets.ALPHABETS["base62"][0]
    random_runs = ["".join(rng.choices(letters, k=40)) + "7q" for _ in range(60)]
    made_up = [f"customer_record_number_{k:04d}_of_the_table" for k in range(60)] + ["Aa1" * 14] * 20
    rows = [(k, f"see {r} here") for k, r in enumerate(random_runs + made_up)]
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs_of(*rows).select("doc_id", "text")).collect()}
    assert sum(bool(got[k]) for k in range(60)) >= 54
    assert sum(bool(got[k]) for k in range(60, len(rows))) <= 3


def test_p_values_of_random_runs_are_even():
    rng = np.random.default_rng(2)
    letters = secrets.ALPHABETS["hex"][0]
    p = [secrets.p_random("".join(rng.choice(list(letters), 64)), "hex") for _ in range(400)]
    assert np.mean(np.array(p) < 0.05) < 0.12


def test_set_aside_is_benjamini_hochberg():
    rng = random.Random(9)
    cells = [secrets.cell(rng.random() ** rng.choice((1, 6))) for _ in range(500)]
    counts = {c: cells.count(c) for c in set(cells)}
    limit = secrets.set_aside({"x": counts}).get("x")
    p = sorted(10 ** (-c / 20) for c in cells)
    passing = [x for k, x in enumerate(p, 1) if x <= secrets.RATE * k / len(p)]
    assert (limit is None) == (not passing)
    if passing:
        assert abs(10 ** (-limit / 20) - max(passing)) < 1e-12


def test_toxicity_on_held_out(spark):
    docs = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{MEDIUM}/labels.parquet")
    held = "crc32(cast(doc_id as string)) % 3 = 1"
    chain = toxicity.train(docs, labels.where(f"NOT {held}"))
    judged = toxicity.score(docs, chain).join(labels.where(held).withColumnRenamed("toxic", "label"), "doc_id")
    seen = {(r["label"], r["hit"]): r["n"] for r in judged.selectExpr("label", "toxic >= 0.5 AS hit").groupBy("label", "hit").count().withColumnRenamed("count", "n").collect()}
    caught, missed = seen.get((1, True), 0), seen.get((1, False), 0)
    assert caught / (caught + missed) > 0.8
    assert seen.get((0, True), 0) / seen[0, False] < 0.01


def test_toxicity_edges(spark, docs_of):
    rows = [(k, f"you idiot number {k} are stupid") for k in range(20)]
    rows += [(100 + k, f"a friendly text with number {k}") for k in range(20)] + [(200, None), (201, ""), (None, "x")]
    labels = spark.createDataFrame(
        [(k, 1) for k in range(20)] + [(100 + k, 0) for k in range(20)] + [(3, 0), (None, 1), (200, None)],
        "doc_id bigint, toxic int",
    )
    docs = docs_of(*rows, (500, "such an idiot " + "word " * 50_000))
    chain = toxicity.train(docs, labels)
    got = {r["doc_id"]: r for r in toxicity.score(docs, chain).collect()}
    assert all(got[k]["toxic"] > 0.5 for k in range(20)) and all(got[100 + k]["toxic"] < 0.5 for k in range(20))
    assert got[500]["insult"] > 0.5 and got[200]["toxic"] == got[201]["toxic"]
    for few in (labels.limit(0), labels.where("toxic = 0")):
        flat = toxicity.score(docs, toxicity.train(docs, few)).collect()
        assert max(r["toxic"] for r in flat) <= 0.5
    assert toxicity.score(docs.limit(0), chain).count() == 0


def test_registered_toxicity_returns_the_flagged(spark):
    flagged = toxicity.op8_toxicity(spark, MEDIUM)
    assert flagged.columns == ["doc_id", *toxicity.CATEGORIES]
    assert 0 < flagged.count() < 2000 and flagged.where("toxic < 0.5").count() == 0
