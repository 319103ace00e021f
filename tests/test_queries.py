"""Every registered query against its SQL, and the shape of the plans."""

from __future__ import annotations

import re

import pytest
from conftest import SMALL
from oracle_compare import connect, difference, type_difference

from __spark_entry__ import entry
from trailmill.checks.oracle import oracle_queries
from trailmill.plans.catalogue import all_queries

QUERIES, SQL = all_queries(), oracle_queries()
# Python evaluation, or a join that pairs every row with every other.
UNWANTED = re.compile(
    r"PythonUDF|EvalPython|MapInPandas|InPandas|CartesianProduct|BroadcastNestedLoopJoin"
)


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    frame = entry(spark)
    assert frame.columns == ["Month", "Activity Type", "Distance"] and frame.count() == 52


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_matches_sql(spark, con, key):
    frame = QUERIES[key](spark, SMALL)
    assert type_difference(frame, con, SQL[key]) is None
    assert difference(frame.toPandas(), con.execute(SQL[key]).df()) is None
    assert not UNWANTED.search(frame._jdf.queryExecution().executedPlan().toString())


def test_scans_read_only_what_they_need(spark):
    plan = QUERIES["gear_distance"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    reads = re.findall(r"ReadSchema: struct<([^>]*)>", plan)
    wide = max((r for r in reads if "l_orderkey" in r), key=len)
    assert "l_discount" not in wide and "l_tax" not in wide and "l_suppkey" not in wide
    assert "PushedFilters: [" in plan


def test_month_totals_add_up(spark):
    fused = QUERIES["overview_fused"](spark, SMALL).toPandas()
    total = fused[fused.level == "total"].set_index("Month").Activities
    split = fused[fused.level == "split"].groupby("Month").Activities.sum()
    assert total.to_dict() == split.to_dict()


def test_summary_counts_all_geared_rows(spark):
    summary = QUERIES["gear_summary"](spark, SMALL).toPandas()
    joined = QUERIES["gear_join"](spark, SMALL)
    assert summary["Total Activities"].sum() == joined.where("name_gear IS NOT NULL").count()
    assert joined.count() == 6000


def test_summary_order(spark):
    summary = QUERIES["gear_summary"](spark, SMALL).collect()
    order = [(r["Retired"], r["Last Activity Date"]) for r in summary]
    for retired in (False, True):
        dates = [d for flag, d in order if flag is retired]
        assert dates == sorted(dates, reverse=True)
    assert [flag for flag, _ in order] == sorted(flag for flag, _ in order)
