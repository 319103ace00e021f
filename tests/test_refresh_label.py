"""The label of a refresh is made once, not per row."""

from __future__ import annotations

import re

from conftest import SMALL

from trailmill.plans.catalogue import Samples
from trailmill.plans.enrich import stamp


def test_label_is_made_once(spark):
    s = Samples(spark, SMALL)
    want = stamp(spark.range(1), str_of(s)).first().refresh_date
    out = stamp(spark.range(5), s.refreshed())
    assert {r.refresh_date for r in out.collect()} == {want} and out.columns == ["id", "refresh_date"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"scalar-subquery#\d+ \[[^\]]*\] AS refresh_date", plan)


def str_of(s):
    time = s.spark.range(1).select(s.refreshed().alias("at")).first().at
    return f"timestamp_ntz'{time}'"
