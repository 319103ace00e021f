"""Line dedup plans each step once: the driver holds plans, so what is used twice is landed."""

from __future__ import annotations

from llm_fixtures import docs_of  # noqa: F401

from trailmill.llm import lines


def test_recurring_lines_are_found_in_one_plan(spark, docs_of):
    docs = docs_of(*[(k, f"same words in every one text\nown {k}") for k in range(9)])
    plan = lines.dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 5  # lines; keys and recurring ones twice
