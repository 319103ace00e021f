"""Line templates with fields anywhere, against a brute-force template tree."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

from llm_fixtures import docs_of  # noqa: F401

from trailmill.llm import lines


def brute_tree(pairs):
    """Texts without the lines that lie in a recurring template, but for its first place."""
    leaves = defaultdict(lambda: defaultdict(list))
    for i, text in sorted(pairs):
        for no, line in enumerate(text.split("\n")):
            t = tuple(line.split())
            leaves[len(t), t[:3]][t].append((i, no))
    gone = set()
    for leaf in leaves.values():
        templates = set()
        near = lambda a, b: sum(x == y for x, y in zip(a, b)) >= 0.8 * len(a) - 1e-9
        # Every line with all that are as alike as two lines of one template can be.
        for t in leaf:
            group = [x for x in leaf if near(x, t)]
            templates.add(tuple(Counter(c).most_common(1)[0][0] for c in zip(*group)))
        for template in templates:
            places = sorted(p for t in leaf if near(t, template) for p in leaf[t])
            if len({i for i, _ in places}) >= 3:
                gone.update(places[1:])
    return {
        i: "\n".join(x for no, x in enumerate(text.split("\n")) if (i, no) not in gone) for i, text in pairs
    }


def varied(words, at, tag, k):
    w = list(words)
    for n, p in enumerate(at):
        w[p] = f"{tag}{'abcdefghijklmnop'[n]}{'qrstuvwxyzabcdefgh'[k]}"
    return " ".join(w)


def test_fields_in_every_third(spark, docs_of):
    rng = random.Random(4)
    words = lambda n, tag: [tag + "".join(rng.choices("abcdefgh", k=8)) for _ in range(n)]
    start = ["this", "is", "how"]
    first, second = start + words(57, "x"), start + words(57, "y")
    second[30:36] = first[30:36]  # two templates of one leaf that share a stretch
    short = start + words(17, "z")
    rows = []
    for k in range(8):
        parts = [varied(first, (10, 29, 50), "u", k), f"own line of {'abcdefgh'[k]}"]
        if k < 5:
            parts += [varied(second, (12, 28, 52, 57), "v", k)]
        parts += [varied(short, (5, 11, 14, 18), "w", k)]
        rows.append((k, "\n".join(parts)))
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs_of(*rows)).collect()}
    assert got == brute_tree(rows)
    assert got[0] == rows[0][1] and got[7] == "own line of h"


def test_threshold_is_passed_on(spark, docs_of):
    base = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    rows = [(k, varied(base, (6, 12, 18), "n", k)) for k in range(3)]
    left = lambda n: [r["text"] for r in lines.dedup(docs_of(*rows), n).orderBy("doc_id").collect()]
    assert left(4) == [t for _, t in rows]
    assert left(3) == [rows[0][1], "", ""]
    assert [r["text"] for r in lines.dedup(docs_of(*rows[:2]), 2).orderBy("doc_id").collect()] == [rows[0][1], ""]


def test_alike_lines_of_one_document_stay(spark, docs_of):
    base = [f"w{c}" for c in "abcdefghijklmnopqrst"]
    text = "\n".join(varied(base, (6, 18), "n", k) for k in range(5))
    assert lines.dedup(docs_of((1, text), (2, "other"))).orderBy("doc_id").first()["text"] == text


def test_long_lines_recur_from_two_texts(spark, docs_of):
    line = lambda n: " ".join(f"w{'abcdefghij'[k // 10]}{'abcdefghij'[k % 10]}" for k in range(n))
    rows = [(1, f"one\n{line(51)}\n{line(50)}"), (2, f"two\n{line(51)}\n{line(50)}"), (3, f"two\n{line(51)}\n{line(50)}")]
    got = {r["doc_id"]: r["text"] for r in lines.dedup(docs_of(*rows)).collect()}
    assert got == {1: rows[0][1], 2: f"two\n{line(50)}", 3: f"two\n{line(50)}"}
