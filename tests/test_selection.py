"""Filters, domains and what reaches the scan."""

from __future__ import annotations

import datetime as dt

import pytest

from trailmill.operators.rollup import fused_rollup, mean, rollup, rows, total
from trailmill.operators.selection import (
    ALL_YEARS,
    Selection,
    frequency_domain,
    latest_label,
    latest_minute,
    year_domain,
)
from trailmill.plans import reports

ACTS = [
    # id, type, start, brand, year
    (1, "Run", "2024-02-29 09:00:30", "A", 2024),
    (2, "Run", "2024-02-29 14:00:00", "B", 2024),
    (3, "Ride", "2023-02-28 09:00:00", "A", 2023),
    (4, "Walk", "2023-02-28 08:59:59", None, 2023),
    (5, "Swim", "2024-01-01 00:00:00", "B", 2024),
    (6, None, "2024-01-31 23:59:59", "A", 2024),
    (7, "Hike", "2022-12-31 23:59:59", "C", 2022),
]


@pytest.fixture(scope="module")
def acts(spark):
    df = spark.createDataFrame(
        ACTS, "id bigint, type string, start_date_local string, brand_name string, year int"
    )
    return df.selectExpr(
        "id", "type", "cast(start_date_local as timestamp_ntz) AS start_date_local", "brand_name", "year"
    )


def ids(df):
    return sorted(r.id for r in df.collect())


def test_anchor_is_the_largest_label_text(acts):
    # "09:00 AM" > "02:00 PM" as text; seconds are not part of the label.
    assert latest_minute(acts).first().anchor == dt.datetime(2024, 2, 29, 9, 0)
    assert latest_minute(acts, year_partitioned=True).first().anchor == dt.datetime(2024, 2, 29, 9, 0)
    assert latest_minute(acts, strict=True).first().anchor == dt.datetime(2024, 2, 29, 14, 0)
    assert latest_label(acts).first().label == "2024-02-29 09:00 AM"


def test_rolling_year_clamps_month_end_and_includes_its_bound(acts):
    assert ids(Selection().apply(acts)) == [1, 2, 3]
    assert ids(Selection(year_partitioned=True).apply(acts)) == [1, 2, 3]
    assert ids(Selection(strict_anchor=True).apply(acts)) == [1, 2]


def test_years_types_brands(acts):
    assert ids(Selection(2024, ("Run", "Swim")).apply(acts)) == [1, 2, 5]
    assert ids(Selection(ALL_YEARS).apply(acts)) == [1, 2, 3, 7]
    assert ids(Selection(ALL_YEARS, brands=("A",)).apply(acts)) == [1, 3]
    assert ids(Selection(ALL_YEARS, types=()).apply(acts)) == []
    assert ids(Selection(ALL_YEARS, brands=()).apply(acts)) == []


def test_conjunction_is_the_intersection(acts):
    whole = Selection(2024, ("Run",), ("B",))
    parts = [
        Selection(2024, ("Run",)), Selection(ALL_YEARS, ("Run",), ("B",)),
    ]
    common = set(ids(parts[0].apply(acts))) & set(ids(parts[1].apply(acts)))
    assert ids(whole.apply(acts)) == sorted(common)


def test_domains(acts):
    assert [r.type for r in frequency_domain(acts, "type").collect()] == ["Run", "Hike", "Ride", "Swim", "Walk"]
    assert [r.brand_name for r in frequency_domain(acts, "brand_name").collect()] == ["A", "B", "C"]
    assert [r.label for r in year_domain(acts).collect()] == [
        "All", "Rolling 12 Months", "2024", "2023", "2022",
    ]


def test_stored_table_prunes_and_pushes(spark, acts, tmp_path):
    path = str(tmp_path / "t")
    acts.write.partitionBy("year").parquet(path)
    stored = spark.read.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")

    def plan(selection):
        chosen = selection.apply(stored).select("id")
        assert chosen.count() >= 0
        return chosen._jdf.queryExecution().executedPlan().toString()

    year = plan(Selection(2024, year_partitioned=True))
    assert "(year#" in year.split("PartitionFilters: [")[1].split("]")[0]
    assert "GreaterThanOrEqual(start_date_local,2024-01-01T00:00)" in year
    assert "In(type, [" in year
    rolling = plan(Selection(year_partitioned=True))
    assert "subquery" in rolling.split("PartitionFilters: [")[1].split("]")[0].lower()
    assert ids(Selection(year_partitioned=True).apply(stored)) == [1, 2, 3]


def test_rollup_null_rules(spark):
    df = spark.sql(
        "SELECT k, cast(v as double) AS v, TIMESTAMP_NTZ'2024-01-01' + make_dt_interval(d) AS start_date_local "
        "FROM VALUES ('a', 1.00, 5), ('a', 1.01, 6), ('b', NULL, 1), (NULL, 3, 0) t(k, v, d)"
    )
    out = rollup(df, {"K": "k"}, [rows("n"), total("v", "s"), mean("v", "m")])
    assert [tuple(r) for r in out.collect()] == [("a", 2, 2.01, 1.0), ("b", 1, 0.0, None)]
    seen = rollup(df, {"K": "k"}, [rows("n")], first_seen=True)
    assert [r.K for r in seen.collect()] == ["b", "a"]


def test_mean_does_not_round_its_inputs(spark):
    df = spark.sql("SELECT 'a' AS k, v FROM VALUES (1.004D), (1.008D), (double('NaN')), (NULL) t(v)")
    assert rollup(df, {"K": "k"}, [mean("v", "m")]).first().m == 1.01


def test_fused_total_keeps_rows_without_inner_key(spark):
    df = spark.sql("SELECT * FROM VALUES ('m', 'x'), ('m', NULL), (NULL, 'x') t(mo, ty)")
    out = fused_rollup(df, ("Month", "mo"), ("Type", "ty"), [rows("n")])
    assert sorted(map(tuple, out.collect()), key=repr) == [("split", "m", "x", 1), ("total", "m", None, 2)]


@pytest.mark.parametrize(
    "days, status", [(0, "ok"), (6, "ok"), (7, "warn"), (14, "warn"), (15, "error")]
)
def test_freshness(spark, days, status):
    df = spark.sql("SELECT '2024-03-01 08:00 AM' AS refresh_date")
    now = spark.sql(f"SELECT TIMESTAMP_NTZ'2024-03-01 13:00:00' + INTERVAL '{days}' DAY AS n").scalar()
    row = reports.status_freshness(df, now).first()
    assert (row.age_days, row.status) == (days, status)


def test_kpis_of_nothing(spark):
    df = spark.sql(
        "SELECT 1L AS upload_id, 1D AS distance_activity, 1D AS total_elevation_gain, 1L AS moving_time "
        "WHERE false"
    )
    assert tuple(reports.overview_kpis(df).first()) == (0, "0.0 mi", "0 ft", "0 hrs 0 min")


def test_approximate_activity_count_is_close(spark):
    df = spark.range(20_000).selectExpr("id % 5000 AS upload_id")
    assert reports.overview_kpis_approx(df).first().Activities == pytest.approx(5000, rel=0.05)
