"""Lines that are all alike: rows compared grow with the lines, results are those of all templates."""

from __future__ import annotations

import random
from collections import defaultdict

from llm_fixtures import docs_of  # noqa: F401

from trailmill.llm import lines


def alike(count):
    """One line in ``count`` texts, up to a fifth of its words other ones."""
    rng = random.Random(7)
    base = [f"w{a}{b}" for a in "abcdef" for b in "abcdefghij"]
    out = []
    for k in range(count):
        w = list(base)
        for p in rng.sample(range(3, 60), rng.randrange(4, 12)):
            w[p] = f"e{rng.choice('abc')}"
        name = "".join("abcdefghij"[int(c)] for c in str(k))
        out.append((k, f"{' '.join(w)}\nown{name}"))
    return out


def landed_rows(monkeypatch, docs):
    """Rows of every landed step of a dedup, and its texts."""
    land, rows = lines.landed, defaultdict(int)

    def counted(df, name):
        out = land(df, name)
        rows[name] += out.count()
        return out

    monkeypatch.setattr(lines, "landed", counted)
    texts = [r["text"] for r in lines.dedup(docs).orderBy("doc_id").collect()]
    monkeypatch.setattr(lines, "landed", land)
    return rows, texts


def test_alike_lines_are_not_met_pairwise(spark, docs_of, monkeypatch):
    few, _ = landed_rows(monkeypatch, docs_of(*alike(60), partitions=2))
    many, texts = landed_rows(monkeypatch, docs_of(*alike(240), partitions=2))
    assert texts[0] == alike(1)[0][1]
    assert sum("\n" in t for t in texts) < 24  # the others lost the line
    for name, rows in many.items():
        assert rows <= 8 * few[name] + 240, (name, few[name], rows)
