"""Landed pages are read up to the page that ends the data."""

from __future__ import annotations

import json
import os
import tempfile

from trailmill.sources import landing


def land(pages: dict[str, str]) -> str:
    root = tempfile.mkdtemp(prefix="pages-")
    for page, text in pages.items():
        os.makedirs(f"{root}/page={page}")
        with open(f"{root}/page={page}/part-0.txt", "w") as f:
            f.write(text)
    return root


def record(i: int) -> dict:
    return {"id": i, "upload_id": i, "type": "Run", "distance": 1.5 * i}


def page(*ids: int) -> str:
    return json.dumps([record(i) for i in ids], indent=1)


def ids(spark, pages):
    return sorted(r.id for r in landing.read_pages_until_end(spark, land(pages)).collect())


def test_every_kind_of_end(spark):
    error = '{"message": "Rate limit", "errors": ["exceeded"]}'
    assert ids(spark, {"01": page(1, 2), "02": page(3), "03": "[]", "04": page(9)}) == [1, 2, 3]
    assert ids(spark, {"01": page(1), "02": error, "03": page(9)}) == [1]
    assert ids(spark, {"01": page(1), "02": '[{"id": 4', "03": page(9)}) == [1]
    assert ids(spark, {"01": page(1), "02": '"text"', "03": page(9)}) == [1]
    assert ids(spark, {"01": "[]", "02": page(9)}) == []
    assert ids(spark, {"01": page(1, 2), "02": page(3), "10": page(4)}) == [1, 2, 3, 4]


def test_cut_is_a_partition_filter(spark):
    pages = {f"{i:02d}": page(i) for i in range(1, 6)} | {"03": "[]"}
    frame = landing.read_pages_until_end(spark, land(pages))
    plan = frame._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [coalesce((page" in plan and "Subquery" in plan
    assert sorted(r.id for r in frame.collect()) == [1, 2]
