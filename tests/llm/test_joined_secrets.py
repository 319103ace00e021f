"""Random values that stand joined to names and words."""

from __future__ import annotations

import random

from llm_fixtures import docs_of  # noqa: F401

from trailmill.llm import secrets


def test_values_behind_names_and_in_paths(spark, docs_of):
    rng = random.Random(11)
    draw = lambda name, n: "".join(rng.choices(secrets.ALPHABETS[name][0], k=n - 2)) + "7q"
    forms = [
        ("aws_secret_access_key=", "base64", 40, ""),
        ("AccountKey=", "base64", 86, "=="),
        ("?sig=", "base64url", 43, "="),
        ("auth=", "base62", 40, ";x=1"),
        ("https://my-site.example/some-path/", "base64url", 43, "/the-end"),
        ("path_of/", "base62", 40, "-end_of_it"),
        ("x-words_and-", "base64", 64, "_more"),
    ]
    rows, places = [], []
    for k in range(20 * len(forms)):
        before, alphabet, n, after = forms[k % len(forms)]
        value = draw(alphabet, n)
        rows.append((k, f"see {before}{value}{after} here"))
        places.append((4 + len(before), 4 + len(before) + n))
    got = {r["doc_id"]: r["spans"] for r in secrets.scan(docs_of(*rows).select("doc_id", "text")).collect()}
    for f in range(len(forms)):
        hit = [
            any(s["kind"] == "random" and s["start"] <= places[k][0] and s["end"] >= places[k][1] for s in got[k])
            for k in range(f, len(rows), len(forms))
        ]
        assert sum(hit) >= 15, (forms[f], sum(hit))
    for spans in got.values():
        inner = [(s["start"], s["end"]) for s in spans if s["kind"] == "random"]
        assert not any(a != b and b[0] <= a[0] and a[1] <= b[1] for a in inner for b in inner)


def test_padding_ends_a_run():
    spans = lambda text: [text[a:b] for a, b, _, _ in secrets.candidates(text)]
    assert spans("k=0123456789abcdefXY==") == ["0123456789abcdefXY=="]
    assert spans("a0123456789abcdefXY=b0123456789abcdefXY") == ["a0123456789abcdefXY", "b0123456789abcdefXY"]
    assert spans("w-w/0123456789abcdefXY") == ["w/0123456789abcdefXY", "0123456789abcdefXY"]
