"""Landing, refresh, reload and fallback."""

from __future__ import annotations

import datetime as dt
import json
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from trailmill.operators.selection import Selection
from trailmill.operators.shape import quoted
from trailmill.plans.enrich import enrich
from trailmill.plans import refresh as refresh_plan
from trailmill.plans.refresh import refresh
from trailmill.session import shared_path
from trailmill.sources import landing, table
from trailmill.sources.schemas import TABLE

REFRESHED = "TIMESTAMP_NTZ'2024-03-10 12:00:00'"


def activity(i, **changes):
    base = {
        "id": i, "upload_id": i * 10, "athlete": {"id": 77, "resource_state": 1}, "name": f"n{i}",
        "type": "Run", "gear_id": "g1", "distance": 5000.0, "average_speed": 3.0, "max_speed": 5.0,
        "total_elevation_gain": 100.0, "elev_high": 30.0, "elev_low": 10.0, "moving_time": 3600,
        "elapsed_time": 90061, "start_date": "2024-03-01T17:30:00Z",
        "start_date_local": "2024-03-01T10:30:00Z", "start_latlng": [45.0, 9.0],
        "end_latlng": [45.1, 9.1], "average_heartrate": 140.5, "max_heartrate": 170.0,
        "suffer_score": 33.0, "upload_id_str": str(i * 10), "id_str": str(i),
    }
    return base | changes


@pytest.fixture()
def landed(tmp_path):
    folder = tmp_path / "pages"
    folder.mkdir()
    pages = [
        [activity(1), activity(2, gear_id=None, start_latlng=[])],
        [activity(3, type="Ride", start_date_local="2023-12-31T23:45:00Z", average_heartrate=None)],
        [],
        {"message": "Rate limit", "errors": [{"code": "exceeded"}]},
    ]
    for n, page in enumerate(pages):
        (folder / f"page-{n}.json").write_text(json.dumps(page))
    (folder / "page-9.json").write_text('"not a list"')
    gear = tmp_path / "gear.json"
    gear.write_text(
        json.dumps(
            [
                {"id": "g1", "name": "shoe", "brand_name": "A", "retired": False,
                 "distance": 160934.0, "converted_distance": 100.0},
                {"id": "g2", "name": "unused", "brand_name": "B", "retired": True, "distance": 1.0},
            ]
        )
    )
    return str(folder), str(gear)


def test_pages_and_rejects(spark, landed):
    pages = landing.read_activity_pages(spark, landed[0]).cache()
    assert sorted(r.id for r in landing.accepted(pages).collect()) == [1, 2, 3]
    bad = landing.rejected(pages).collect()
    assert sorted((r.errors is not None, r._corrupt_record is not None) for r in bad) == [
        (False, True), (True, False),
    ]


def test_enriched_record(spark, landed):
    acts = landing.accepted(landing.read_activity_pages(spark, landed[0]))
    out = enrich(acts, landing.read_gear(spark, landed[1]), refreshed=REFRESHED)
    found = {r.id_activity: r.asDict() for r in out.collect()}
    one = found[1]
    assert len(found) == 3 and "upload_id_str" not in one and "start_latlng" not in one
    assert (one["athlete.id"], one["name_activity"], one["name_gear"]) == (77, "n1", "shoe")
    assert (one["distance_activity"], one["distance_gear"]) == (3.11, 100.0)
    assert (one["average_speed"], one["total_elevation_gain"]) == (6.71, 328.08)
    assert (one["moving_time"], one["elapsed_time"]) == (3600, 3661)
    assert one["start_date_local"] == dt.datetime(2024, 3, 1, 10, 30)
    assert (one["start_time_local_24h_hour"], one["start_time_local_12h"]) == (10, "10:30 AM")
    assert (one["weekday"], one["weekday_num"], one["month_num"], one["year"]) == ("Friday", 4, 3, 2024)
    assert one["refresh_date"] == "2024-03-10 08:00 AM"
    assert found[2]["brand_name"] is None and found[3]["start_time_local_24h_hour"] == 0


def spoil(landed):
    """A page that is no JSON list."""
    with open(f"{landed[0]}/page-9.json", "w") as page:
        page.write('"not a list"')


def test_refresh_reload_and_fallback(spark, landed, tmp_path):
    path, empty = str(tmp_path / "table"), tmp_path / "empty"
    empty.mkdir()
    (empty / "p.json").write_text("[]")
    observations = str(tmp_path / "obs")
    spark.sql(
        "SELECT 1L AS station_id, 45D AS lat, 9D AS lon, TIMESTAMP_NTZ'2024-03-01 10:00:00' AS obs_hour, "
        "50D AS temp, 60D AS rhum"
    ).write.parquet(observations)

    nothing = refresh(spark, str(empty), landed[1], path)
    assert nothing.count() == 0 and set(nothing.columns) >= {"id_activity", "temp"}
    corrupt = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED)
    assert corrupt.count() == 0  # no good table yet

    first = refresh(
        spark, landed[0], landed[1], path, observations, refreshed=REFRESHED, accept_partial=True
    )
    rows = {r.id_activity: r for r in first.collect()}
    assert sorted(rows) == [1, 2, 3]
    assert set(first.columns) == set(TABLE.names)
    assert (rows[1].temp, rows[1].rhum, rows[2].temp, rows[3].temp) == (50.0, 60.0, None, None)
    assert rows[1].moving_time == 3600 and rows[1].month_year == dt.date(2024, 3, 1)

    (tmp_path / "pages" / "page-9.json").unlink()
    again = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED)  # replaces, not appends
    assert again.count() == 3  # the error page only ends the data
    stored = sorted((tmp_path / "table" / "rejects").iterdir(), key=lambda p: p.stat().st_mtime)
    (rejected,) = spark.read.parquet(str(stored[-1])).collect()
    assert "exceeded" in rejected.errors
    kept = refresh(spark, str(empty), landed[1], path)
    assert sorted(r.id_activity for r in kept.collect()) == [1, 2, 3]
    assert sorted(p.name for p in tmp_path.iterdir()) == ["empty", "gear.json", "obs", "pages", "table"]

    loaded = table.load(spark, path, Selection(2024, brands=("A",)), ["id_activity", "refresh_date"])
    assert loaded.is_cached and [tuple(r) for r in loaded.collect()] == [(1, "2024-03-10 08:00 AM")]
    loaded.unpersist()


def test_corrupt_page_keeps_the_last_good_table(spark, landed, tmp_path):
    path, page = str(tmp_path / "table"), tmp_path / "pages" / "page-9.json"
    page.unlink()
    refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED)
    (tmp_path / "pages" / "page-1.json").unlink()
    spoil(landed)
    kept = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED)
    assert kept.count() == 3
    partial = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED, accept_partial=True)
    assert partial.count() == 2


def test_crash_before_the_pointer_moves(spark, landed, tmp_path, monkeypatch):
    path = str(tmp_path / "table")
    good = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED, accept_partial=True)

    def crash(*_):
        raise OSError("gone")

    with monkeypatch.context() as patched:
        patched.setattr(table, "_point", crash)
        with pytest.raises(OSError, match="gone"):
            table.full_refresh(good.where("id_activity = 1"), path)
    assert table.read_table(spark, path).count() == 3
    reader = table.read_table(spark, path)
    table.full_refresh(good.where("id_activity = 1"), path)
    assert table.read_table(spark, path).count() == 1
    assert reader.count() == 3  # the version before is still there
    assert len(list((tmp_path / "table" / "snapshots").iterdir())) == 2


def test_missing_snapshot_is_an_error(spark, tmp_path):
    folder = tmp_path / "table"
    folder.mkdir()
    (folder / "CURRENT").write_text("nowhere\n")
    with pytest.raises(table.MissingSnapshot):
        table.read_table(spark, str(folder))


def test_filters_reach_the_stored_files(spark, landed, tmp_path):
    path = str(tmp_path / "table")
    refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED, accept_partial=True)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    for selection in (Selection(2024), Selection(2024, year_partitioned=True), Selection(), Selection(year_partitioned=True)):
        chosen = selection.apply(table.read_table(spark, path)).select("id_activity")
        assert chosen.count() > 0
        plan = chosen._jdf.queryExecution().executedPlan().toString()
        # One scan is the report's, others look up the rolling year's anchor.
        assert any("year#" in part.split("]")[0] for part in plan.split("PartitionFilters: [")[1:])
        if selection.years == 2024:
            assert "GreaterThanOrEqual(start_date_local,2024-01-01T00:00)" in plan
        else:
            scans = [part.split("], Format")[0] for part in plan.split("DataFilters: [")[1:]]
            assert any("start_date_local" in scan for scan in scans)


def test_failed_write_keeps_the_old_table(spark, landed, tmp_path):
    path = str(tmp_path / "table")
    good = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED, accept_partial=True)
    broken = good.withColumn("distance_activity", F.expr("double(raise_error('lost'))"))
    with pytest.raises(Exception, match="lost"):
        table.full_refresh(broken, path)
    assert table.read_table(spark, path).count() == 3


def test_records_round_trip(spark, landed):
    acts = landing.accepted(landing.read_activity_pages(spark, landed[0]))
    stored = table.storable(enrich(acts, landing.read_gear(spark, landed[1]), refreshed=REFRESHED))
    records = table.to_records(stored)
    one = records.where("id_activity = 1").first()
    assert (one.moving_time, one.elapsed_time) == ("0 days 01:00:00", "0 days 01:01:01")
    assert (one.start_date_local, one.month_year) == ("2024-03-01T10:30:00", "2024-03-01T00:00:00")
    assert one.start_time_local_24h == "10:30:00"
    again = table.retype(records).selectExpr(*map(quoted, stored.columns))
    assert sorted(map(str, again.collect())) == sorted(map(str, stored.collect()))


def test_usable_and_columns(spark):
    full, none = spark.range(2), spark.range(0)
    assert table.usable(full, none).count() == 2 and table.usable(none, full).count() == 2
    odd = spark.sql("SELECT 1L AS id_activity, '5' AS `athlete.id_str`, 'x' AS other, 'y' AS a_str")
    assert table.storable(odd).columns == ["id_activity", "athlete.id"]


def test_gear_activity_over_24_hours_unwrapped(spark, landed):
    acts = landing.accepted(landing.read_activity_pages(spark, landed[0]))
    out = enrich(acts, landing.read_gear(spark, landed[1]), wrap_24h=False, month_mode="seasonal")
    row = out.where("id_activity = 3").first()
    assert row.elapsed_time == 90061 and row.monthly_date == dt.date(2025, 12, 1)


def test_shared_path_prefers_the_clusters_folder():
    def session(folder, master):
        conf = SimpleNamespace(get=lambda key, default=None: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))

    assert shared_path(session("hdfs://x/shared/", "yarn"), "t").startswith("hdfs://x/shared/t-")
    assert "trailmill-" in shared_path(session(None, "local[2]"), "t")
    with pytest.raises(RuntimeError):
        shared_path(session(None, "yarn"), "t")


def test_large_gear_takes_the_spread_path(spark, landed, tmp_path, monkeypatch):
    monkeypatch.setattr(refresh_plan, "fits_broadcast", lambda df: False)
    out = refresh(
        spark, landed[0], landed[1], str(tmp_path / "t"), refreshed=REFRESHED, accept_partial=True
    )
    assert sorted((r.id_activity, r.name_gear) for r in out.collect()) == [
        (1, "shoe"), (2, None), (3, "shoe"),
    ]


def test_interleaved_refreshes_both_stay_readable(spark, landed, tmp_path):
    path = str(tmp_path / "table")
    good = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED, accept_partial=True)
    first, second = table.new_snapshot(), table.new_snapshot()
    # The first refresh writes, the second writes and commits, then the first commits.
    started = spark.createDataFrame([], "x int")  # the first one's folder before its files
    (tmp_path / "table" / "snapshots" / first).mkdir()
    table.write_snapshot(good.where("id_activity = 2"), path, second)
    table.commit(spark, path, second)
    assert (tmp_path / "table" / "snapshots" / first).exists()  # still being written: kept
    (tmp_path / "table" / "snapshots" / first).rmdir()  # the stand-in makes room for the real write
    table.write_snapshot(good.where("id_activity = 1"), path, first)
    reader = table.read_table(spark, path)
    table.commit(spark, path, first)
    assert [r.id_activity for r in table.read_table(spark, path).collect()] == [1]
    assert [r.id_activity for r in reader.collect()] == [2]  # the second's snapshot is still there
    assert started.count() == 0


def test_snapshot_statistics_answer_without_a_scan(spark, landed, tmp_path):
    from trailmill.operators.selection import latest_minute

    path = str(tmp_path / "table")
    stored = refresh(spark, landed[0], landed[1], path, refreshed=REFRESHED, accept_partial=True)
    stats = table.snapshot_stats(spark, path)
    assert stats["rows"] == stored.count()
    assert stats["years"] == sorted({r.year for r in stored.select("year").collect()})
    anchor = table.stored_anchor(spark, path)
    assert anchor.first().anchor == latest_minute(stored).first().anchor
    assert "FileScan" not in anchor._jdf.queryExecution().executedPlan().toString()
    assert table.snapshot_stats(spark, str(tmp_path / "none")) is None
