"""Decontamination by row, where ids are missing or repeat."""

from __future__ import annotations

from llm_fixtures import docs_of  # noqa: F401

from trailmill.llm import decontaminate


def test_clean_rows_of_the_same_id_stay(spark, docs_of):
    item = " ".join(f"q{k}" for k in range(40))
    items = spark.createDataFrame([(1, item)], "item_id bigint, text string")
    rows = [(None, f"x {item}"), (None, "clean text without an id"), (None, None), (7, item), (7, "clean text of seven"), (7, item), (8, "other")]
    kept = decontaminate.clean(docs_of(*rows), items)
    assert kept.columns == docs_of(*rows).columns
    assert sorted(str((r["doc_id"], r["text"])) for r in kept.collect()) == sorted(
        map(str, [rows[1], rows[2], rows[4], rows[6]])
    )


def test_blocks_are_bounded_by_bytes():
    rows = [{"text": t} for t in ("a" * 6, "b" * 5, None, "é" * 40, "c", "d", "e", "f")]
    sizes = [[len((r["text"] or "").encode()) for r in b] for b in decontaminate.blocks(rows, 3, 10)]
    assert sizes == [[6], [5, 0], [80], [1, 1, 1], [1]]
