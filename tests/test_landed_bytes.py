"""What a landing and a refresh move and write per record."""

from __future__ import annotations

import json
import os
import re

import pytest
from conftest import SMALL

from trailmill.plans import catalogue, enrich
from trailmill.plans import refresh as refresh_plan
from trailmill.plans.refresh import refresh
from trailmill.sources import samples, table


def size(root: str, part: str = "part-") -> int:
    return sum(
        os.path.getsize(os.path.join(folder, name))
        for folder, _, names in os.walk(root)
        for name in names
        if name.startswith(part)
    )


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pages_are_cut_without_a_shuffle(spark):
    s = catalogue.Samples(spark, SMALL)
    records = s.raw().selectExpr("to_json(struct(*)) AS record")
    pages = catalogue._page_texts(records)
    assert "Exchange" not in plan(pages)
    sizes = [len(json.loads(r.value)) for r in pages.collect()]
    assert sum(sizes) == records.count() and max(sizes) <= catalogue.PAGE_RECORDS
    again = pages.selectExpr("explode(from_json(value, 'array<string>')) AS record")
    assert again.exceptAll(records).isEmpty() and records.exceptAll(again).isEmpty()
    assert catalogue._page_texts(records.limit(0)).isEmpty()


def test_page_files_are_compressed_and_bounded(spark, monkeypatch):
    monkeypatch.setattr(catalogue, "FILE_PAGES", 4)
    s = catalogue.Samples(spark, SMALL)
    records = s.raw().count()
    path = catalogue._page_files(s)
    assert size(path) < 250 * records  # 560 bytes a record as plain text
    assert max(r.pages for r in spark.read.text(path).selectExpr("input_file_name() AS f").groupBy("f").agg({"*": "count"}).toDF("f", "pages").collect()) <= 4


def test_paged_files_shuffle_source_rows_only(spark):
    s = catalogue.Samples(spark, SMALL)
    path = catalogue._paged_files(s)
    assert size(path) < 250 * s.raw().count()
    pages = sorted(name for name in os.listdir(path) if name.startswith("page="))
    middle = (int(pages[0][5:]) + int(pages[-1][5:])) // 2
    texts = {r.page: r.value for r in spark.read.schema("value string, page string").text(path, wholetext=True).collect()}
    assert "Rate limit" in texts[f"{middle:012d}"] and texts[f"{middle + 1:012d}"].strip() == "[]"


def test_refresh_moves_no_calendar_text(spark, tmp_path):
    s = catalogue.Samples(spark, SMALL)
    early = enrich.enrich(s.raw(), s.gear(), rebalance=True)
    shuffles = re.findall(r"REBALANCE_PARTITIONS_BY_COL.*", plan(early))
    below = early._jdf.queryExecution().optimizedPlan().toString().split("RebalancePartitions")[1]
    assert shuffles and "weekday" not in below and "month_year_name" not in below
    late = enrich.enrich(s.raw(), s.gear())
    shown = [f"`{c}`" for c in late.columns if c != "refresh_date"]
    assert early.selectExpr(*shown).exceptAll(late.selectExpr(*shown)).isEmpty()
    path = f"{tmp_path}/t"
    table.full_refresh(early, path, rebalance=False)
    assert table.read_table(spark, path).count() == samples.activities(spark, SMALL).count()


def test_refresh_copies_no_accepted_record(spark, tmp_path):
    pages, gear, path = (str(tmp_path / n) for n in ("pages.json", "gear.json", "table"))
    records = [{"id": i, "gear_id": f"g{i % 2}", "name": "n", "start_date_local": "2024-03-01T10:30:00Z"} for i in range(5)]
    with open(pages, "w") as out:
        json.dump([*records, {"message": "Rate limit", "errors": ["exceeded"]}], out)
    with open(gear, "w") as out:
        json.dump([{"id": "g0", "name": "shoe"}], out)
    table_rows = refresh(spark, pages, gear, path)
    assert sorted(r.name_gear or "" for r in table_rows.collect()) == ["", "", "shoe", "shoe", "shoe"]
    (copied,) = os.listdir(f"{path}/{table.LANDED}")
    seen = [r.asDict() for r in spark.read.parquet(f"{path}/{table.LANDED}/{copied}").collect()]
    held = [{k for k, v in r.items() if v is not None} for r in seen if r["status"] == "accepted"]
    assert held == [{"gear_id", "status"}] * 5
    (reject,) = (r for r in seen if r["status"] != "accepted")
    assert "exceeded" in reject["errors"]


def test_page_lost_between_the_two_reads_keeps_the_table(spark, tmp_path, monkeypatch):
    pages, gear, path = (str(tmp_path / n) for n in ("pages.json", "gear.json", "table"))

    def land(*ids):
        with open(pages, "w") as out:
            json.dump([{"id": i, "start_date_local": "2024-03-01T10:30:00Z"} for i in ids], out)

    def spoil(df):
        with open(pages, "w") as out:
            out.write('"not a list"')
        return True

    with open(gear, "w") as out:
        out.write("[]")
    land(1, 2)
    assert refresh(spark, pages, gear, path).count() == 2
    land(3)
    with monkeypatch.context() as patched:
        patched.setattr(refresh_plan, "fits_broadcast", spoil)
        with pytest.raises(Exception, match="became unreadable"):
            refresh(spark, pages, gear, path)
    kept = table.read_table(spark, path)
    assert sorted(r.id_activity for r in kept.collect()) == [1, 2]


def test_large_gear_moves_activities_once(spark):
    s = catalogue.Samples(spark, SMALL)
    keys = s.raw().select("gear_id")
    spread = enrich.enrich(s.raw(), s.gear(), gear_rows_at_most=10**9, gear_keys=keys, rebalance=True)
    logical = spread._jdf.queryExecution().optimizedPlan().toString()
    assert "RebalancePartitions" not in logical
    # The activities are read whole once; their keys come from ``gear_keys``.
    assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", plan(spread))) == 1
    plain = enrich.enrich(s.raw(), s.gear())
    shown = [f"`{c}`" for c in plain.columns if c != "refresh_date"]
    assert spread.selectExpr(*shown).exceptAll(plain.selectExpr(*shown)).isEmpty()
    assert spread.count() == plain.count()


def test_fallback_lands_its_activities_once(spark, monkeypatch):
    calls, made = [], catalogue._page_files

    def counted(*args, **options):
        calls.append(made(*args, **options))
        return calls[-1]

    monkeypatch.setattr(catalogue, "_page_files", counted)
    s = catalogue.Samples(spark, SMALL)
    kept = catalogue._fallback_table(s)
    assert kept.count() == s.raw().count() and len(calls) == 1
    # Closer packed than at the fastest level.
    assert size(calls[0]) < 0.9 * size(made(s))
