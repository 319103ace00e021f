"""Quality rules: base statistics against a plain Python version, and the verdict."""

from __future__ import annotations

import re

from llm_fixtures import docs_of  # noqa: F401

from trailmill.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    ws = WORD.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    starts: dict = {}
    for i in range(len(ws) - 7):
        starts.setdefault(tuple(ws[i : i + 8]), []).append(i)
    covered = {p for v in starts.values() if len(v) > 1 for i in v for p in range(i, i + 8)}
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))


def labels(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id bigint, quality int, toxic int")


TEXTS = [
    None,
    "",
    "   \n\t ",
    "one two three",
    "a b c d e f g h a b c d e f g h",
    "x x x x x x x x x",
    "line one here\nline one here\n\nline one here \nother # $ & | < >",
    " ".join(f"w{i % 37}" for i in range(20_000)),
    "Ünïcödé wörds ñ 字字 " * 30,
]


def test_base_statistics_match_a_plain_count(spark, docs_of):  # noqa: F811
    docs = docs_of(*[(i, t) for i, t in enumerate(TEXTS)], (3, TEXTS[3]), (None, "a a"))
    out = quality.rules(docs, labels(spark, (3, 1, 0), (3, 1, 0), (None, 1, 0))).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        text = "a a" if r.doc_id is None else TEXTS[r.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_verdict_keeps_text_like_the_trusted_one(spark, docs_of):  # noqa: F811
    clean = [" ".join(f"word{(i * 7 + k) % 50} is here and there" for k in range(12)) for i in range(30)]
    junk = [" ".join(f"J{(i + k) % 9}&&&!! ZZ##" for k in range(30)) for i in range(10)]
    docs = docs_of(*[(i, t) for i, t in enumerate(clean + junk)], partitions=3)
    out = {r.doc_id: r for r in quality.rules(docs, labels(spark, *[(i, 1, 0) for i in range(0, 30, 2)])).collect()}
    assert all(out[i].kept for i in range(1, 30, 2))
    assert not any(out[i].kept for i in range(30, 40))
    again = {r.doc_id: r.score for r in quality.rules(docs.repartition(5), labels(spark, *[(i, 1, 0) for i in range(0, 30, 2)])).collect()}
    assert again == {k: r.score for k, r in out.items()}


def test_empty_tables(spark, docs_of):  # noqa: F811
    docs = docs_of((1, "x")).where("false")
    assert quality.rules(docs, labels(spark)).count() == 0
    one = quality.rules(docs_of((1, "some words " * 20)), labels(spark)).first()
    assert one.kept is True or one.kept is False
