"""Every registered query over the test tables, by key."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions import numeric, temporal, text
from trailmill.operators import athletes, joins, shape
from trailmill.operators.nearest import attach_nearest
from trailmill.operators.selection import (
    ALL_YEARS,
    ROLLING,
    Selection,
    frequency_domain,
    latest_minute,
    year_domain,
)
from trailmill.plans import enrich as e
from trailmill.plans import reports
from trailmill.plans.refresh import refresh
from trailmill.session import shared_path
from trailmill.sources import landing, samples, table

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Samples:
    """The test tables as the engine's inputs."""

    spark: SparkSession
    sf_dir: str

    def raw(self) -> DataFrame:
        return samples.activities(self.spark, self.sf_dir)

    def gear(self) -> DataFrame:
        return samples.gear(self.spark, self.sf_dir)

    def observations(self) -> DataFrame:
        return samples.observations(self.spark, self.sf_dir)

    def network(self) -> dict[str, int]:
        """Proven and measured bounds on the observations."""
        hours = samples.observed_hours(self.spark, self.sf_dir)
        return {"stations_at_most": samples.STATIONS, "hours_at_most": hours}

    def enriched(self, weather: bool = False, **options: object) -> DataFrame:
        if weather:
            options |= self.network() | {"observations": self.observations()}
        return e.enrich(self.raw(), self.gear(), **options)  # measures the gear

    def refreshed(self) -> Column:
        """A snapshot time the data fixes: a day after the last activity."""
        latest = latest_minute(self.raw(), strict=True)
        return latest.selectExpr("anchor + INTERVAL 1 DAY AS refreshed").scalar()


def _selected(frame: reports.Frame, selection: Selection = Selection(), **options: object) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return frame(selection.apply(Samples(spark, sf_dir).enriched(**options)))

    return query


def _whole(frame: Callable[[DataFrame], DataFrame], **options: object) -> Query:
    return lambda spark, sf_dir: frame(Samples(spark, sf_dir).enriched(**options))


def _stage(build: Callable[[Samples], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(Samples(spark, sf_dir))


def report_queries() -> dict[str, Query]:
    found: dict[str, Query] = {"overview_kpis": _selected(reports.overview_kpis)}
    for m in ("activities", "distance", "elevation", "time"):
        found[f"overview_{m}_by_month"] = _selected(reports.overview_series(m, False))
        found[f"overview_{m}_by_month_type"] = _selected(reports.overview_series(m, True))
        found[f"gear_{m}"] = _selected(reports.gear_totals(m))
        found[f"timing_month_{m}"] = _selected(reports.timing_month(m))
        found[f"timing_weekday_{m}"] = _selected(reports.timing_weekday(m))
        found[f"timing_hour_{m}"] = _selected(reports.timing_hour(m))
    found["overview_fused"] = _selected(reports.overview_fused)
    for m in (
        "activities", "distance", "elevation", "time", "avg_speed", "avg_heartrate", "avg_effort",
    ):
        found[f"gear_{m}_by_month"] = _selected(reports.gear_monthly(m))
    for m in reports.BOXES:
        found[f"gear_box_{m}"] = _selected(reports.gear_box(m))
        found[f"gear_points_{m}"] = _selected(reports.gear_points(m))
    found["gear_summary"] = _whole(reports.gear_summary)

    found["weather_temp_rhum"] = _selected(
        reports.scatter(reports.TEMPERATURE, reports.HUMIDITY), weather=True
    )
    for m, measure in reports.SCATTER.items():
        for x, axis in (("temp", reports.TEMPERATURE), ("rhum", reports.HUMIDITY)):
            found[f"weather_{x}_{m}"] = _selected(reports.scatter(axis, measure), weather=True)

    for m in reports.MEANS:
        found[f"perf_{m}_by_month_type"] = _selected(reports.performance(m))
    for m in ("avg_speed", "max_speed", "avg_heartrate", "max_heartrate", "effort"):
        found[f"perf_box_{m}"] = _selected(reports.month_box(m))
        found[f"perf_points_{m}"] = _selected(reports.month_points(m))
    for m in ("activities", "distance", "elevation", "time"):
        key = "timing_month_seasonal" + ("" if m == "activities" else f"_{m}")
        found[key] = _selected(
            reports.timing_month(m), Selection(ALL_YEARS), month_mode="seasonal"
        )
    found["activity_detail"] = _whole(reports.activity_detail, weather=True)
    found["domain_types"] = _whole(lambda df: frequency_domain(df, "type"))
    found["domain_brands"] = _whole(lambda df: frequency_domain(df, "brand_name"))
    found["domain_years"] = _whole(year_domain)
    found["status_latest"] = _stage(
        lambda s: reports.status_latest(s.enriched(refreshed=s.refreshed()))
    )
    found["status_freshness"] = _stage(
        lambda s: reports.status_freshness(
            s.enriched(refreshed=s.refreshed()), s.refreshed() + F.expr("INTERVAL 10 DAY")
        )
    )
    return found


CONVERTED = (
    "id", "distance", "average_speed", "max_speed", "total_elevation_gain",
    "elev_high", "elev_low",
)
CALENDAR = (
    "id_activity", "moving_time", "elapsed_time", "start_date_local", "start_time_local_24h",
    "start_time_local_24h_hour", "start_time_local_12h", "weekday", "weekday_num", "month",
    "month_num", "monthly_date", "month_year", "month_year_name", "year",
)
SELECTED = ("id_activity", "type", "start_date_local", "brand_name")


def _pages(s: Samples) -> DataFrame:
    """Activities re-encoded as landed page payloads, one page per line."""
    iso = {n: f"concat({temporal.iso_text(n)}, 'Z')" for n in e.TIMES}
    raw = shape.derive(s.raw(), iso | {"gear_id": "cast(gear_id as string)"})
    failed = "to_json(named_struct('errors', array('Rate limit')))"
    return raw.selectExpr(
        f"if(upload_id % 10 = 7, {failed}, to_json(array(struct(*)))) AS payload"
    )


#: Records a page holds at most, and pages a landed file holds at most.
PAGE_RECORDS, FILE_PAGES = 200, 500
#: The refreshes need disk for more than the pages, so theirs are packed closer:
#: a fifth smaller than at the fastest level.
REFRESH_LEVEL = "FIVE"


def _page_texts(records: DataFrame) -> DataFrame:
    """``value``: JSON arrays of up to ``PAGE_RECORDS`` consecutive records of a
    partition. Pages are cut inside Arrow batches, so no record moves."""
    size = PAGE_RECORDS

    def cut(batches):  # noqa: ANN001, ANN202 - Arrow batches
        import pyarrow as pa
        import pyarrow.compute as pc

        for batch in batches:
            texts = batch.column(0).cast(pa.string())
            ends = [*range(0, len(texts), size), len(texts)]
            pages = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), texts)
            value = pc.binary_join_element_wise("[", pc.binary_join(pages, ","), "]", "")
            yield pa.RecordBatch.from_arrays([value], ["value"])

    return records.mapInArrow(cut, "value string")


def _page_files(s: Samples, corrupt: bool = False, level: str = "BEST_SPEED") -> str:
    """All activities as landed page files: pages of up to 200 records, one a
    line, besides an empty page and an error page. Compressed, in files of a
    bounded number of pages, as compressed text is not split. The fastest level
    is a third larger than the default one and takes a fifth less time."""
    iso = {n: f"concat({temporal.iso_text(n)}, 'Z')" for n in e.TIMES}
    raw = shape.derive(s.raw(), iso | {"gear_id": "cast(gear_id as string)"})
    pages = _page_texts(raw.selectExpr("to_json(struct(*)) AS record"))
    odd = ["[]", '{"message": "Rate limit", "errors": ["exceeded"]}'] + ['"cut off'] * corrupt
    path = shared_path(s.spark, "pages")
    (
        pages.union(s.spark.createDataFrame([(x,) for x in odd], "value string"))
        .write.option("maxRecordsPerFile", FILE_PAGES)
        .option("zlib.compress.level", level)
        .text(path, compression="gzip")
    )
    return path


LANDED = (
    "id", "upload_id", "athlete_id", "type", "gear_id", "distance", "moving_time",
    "start_date_local", "start_latitude", "start_longitude",
)


def _landed_files(s: Samples) -> DataFrame:
    """Page files read back: proper records, whatever else is landed."""
    pages = landing.read_activity_pages(s.spark, _page_files(s, corrupt=True), multi_line=False)
    flat = shape.flatten_structs(landing.accepted(pages), "_")
    return e.split_position(e.naive_times(flat)).select(*LANDED)


def _paged_files(s: Samples) -> str:
    """Activities landed one page a file, pages by upload_id div 1,000; the middle
    page is an error reply and an empty page follows it, so records stand behind
    the end of the data. The narrow source rows are dealt and sorted by page, and
    records are written out behind that shuffle; page files are compressed."""
    page = "(l_orderkey * 10 + l_linenumber) div 1000"
    items = samples.line_items(s.spark, s.sf_dir)
    middle = items.selectExpr(f"{page} AS page").agg(F.expr("(min(page) + max(page)) div 2 AS m"))
    error = """'{"message": "Rate limit", "errors": ["exceeded"]}'"""
    odd = middle.selectExpr(f"inline(array(named_struct('page', m, 'value', {error}), named_struct('page', m + 1, 'value', '[]')))")
    replaced = middle.scalar()
    iso = {n: f"concat({temporal.iso_text(n)}, 'Z')" for n in e.TIMES}
    dealt = (
        items.withColumn("page", F.expr(page))
        .where((F.col("page") != replaced) & (F.col("page") != replaced + 1))
        .repartition("page")
        .sortWithinPartitions("page")
    )
    raw = samples.as_activities(dealt, "page")
    pages = (
        shape.derive(raw, iso | {"gear_id": "cast(gear_id as string)"})
        .selectExpr("page", "to_json(struct(* EXCEPT (page))) AS record")
        .groupBy("page")
        .agg(F.expr("concat('[', concat_ws(',', collect_list(record)), ']') AS value"))
    )
    path = shared_path(s.spark, "paged")
    (
        pages.unionByName(odd)
        .selectExpr("lpad(CAST(page AS STRING), 12, '0') AS page", "value")
        .write.partitionBy("page")
        .option("zlib.compress.level", "BEST_SPEED")
        .text(path, compression="gzip")
    )
    return path


def _landed_until_end(s: Samples) -> DataFrame:
    """Records of the paged landing up to its error page."""
    records = landing.read_pages_until_end(s.spark, _paged_files(s)).drop("page")
    flat = shape.flatten_structs(records, "_")
    return e.split_position(e.naive_times(flat)).select(*LANDED)


def _refreshed_table(s: Samples, pages: str | None = None) -> str:
    """A table refreshed from landed files, weather in a metric feed."""
    gear, seen, path = (shared_path(s.spark, n) for n in ("gear", "observations", "activities"))
    s.gear().selectExpr("* EXCEPT (id)", "cast(id as string) AS id").write.json(gear)
    samples.observations(s.spark, s.sf_dir, metric=True).write.json(seen)
    refresh(
        s.spark,
        pages or _page_files(s, level=REFRESH_LEVEL),
        gear,
        path,
        seen,
        refreshed=s.refreshed(),
        multi_line=False,
        observation_form="json",
        metric=True,
        **s.network(),
    )
    return path


def _stored_table(s: Samples) -> DataFrame:
    """Every column of the refreshed table."""
    stored = table.read_table(s.spark, _refreshed_table(s))
    return stored.withColumnRenamed("athlete.id", "athlete_id")


def _fallback_table(s: Samples) -> DataFrame:
    """A good table, then the landing with a corrupt page besides: the good one stays."""
    pages = _page_files(s, level=REFRESH_LEVEL)
    cut, gear = shared_path(s.spark, "cut"), shared_path(s.spark, "gear")
    path = _refreshed_table(s, pages)
    s.spark.createDataFrame([('"cut off',)], "value string").write.text(cut)
    s.gear().selectExpr("* EXCEPT (id)", "cast(id as string) AS id").limit(0).write.json(gear)
    kept = refresh(s.spark, [pages, cut], gear, path, multi_line=False)
    return kept.select("id_activity", "upload_id", "type", "name_gear", "distance_activity", "temp")


def _stored_year_domain(s: Samples) -> DataFrame:
    """The year domain of a stored table from its statistics, without a scan."""
    years = table.stored_years(s.spark, _refreshed_table(s))
    frame = s.spark.createDataFrame([(y,) for y in years], "year int")
    return year_domain(frame)


def _stored_report(frame: reports.Frame, selection: Selection) -> Query:
    return lambda spark, sf_dir: frame(
        selection.apply(table.read_table(spark, _refreshed_table(Samples(spark, sf_dir))))
    )


def _landed(s: Samples) -> DataFrame:
    kept = landing.accepted(landing.parse_activity_pages(_pages(s), "payload"))
    flat = e.split_position(e.naive_times(shape.flatten_structs(kept, "_")))
    columns = ("id", "upload_id", "athlete_id", "type", "gear_id", "distance", "moving_time")
    return flat.select(*columns, "start_date_local", "start_latitude", "start_longitude")


def _record_round_trip(s: Samples) -> DataFrame:
    """Rows to record form and back: durations, times and dates survive."""
    stored = table.storable(
        s.enriched(refreshed=s.refreshed()).withColumnRenamed("athlete.id", "athlete.id_str")
    )
    again = table.retype(table.to_records(stored))
    shown = (*CALENDAR, "distance_activity", "name_gear", "refresh_date")
    return again.selectExpr("`athlete.id` AS athlete_id", *shown)


GEARED = ("id_activity", "gear_id", "name_activity", "name_gear", "brand_name", "retired")


def _duration_texts(df: DataFrame) -> DataFrame:
    return df.selectExpr(
        "id_activity",
        f"{text.duration_text('elapsed_time')} AS duration",
        f"{text.hours_minutes('elapsed_time')} AS label",
        f"{text.hours2('elapsed_time')} AS hours",
    ).selectExpr("*", f"{text.duration_seconds('duration')} AS seconds")


def _refresh_reload(s: Samples) -> DataFrame:
    """The whole table written by a full refresh and read back."""
    path = shared_path(s.spark, "activities")
    rows = s.enriched(weather=True, refreshed=s.refreshed(), rebalance=True)
    table.full_refresh(rows, path, rebalance=False)
    return table.read_table(s.spark, path).selectExpr(
        "`athlete.id` AS athlete_id", *CALENDAR, "distance_activity", "temp", "rhum", "refresh_date"
    )


def _athletes(frame: Callable[[DataFrame], DataFrame], selection: athletes.AthleteSelection | None) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = athletes.with_athlete(Samples(spark, sf_dir).enriched())
        return frame(df if selection is None else selection.apply(df))

    return query


def athlete_queries() -> dict[str, Query]:
    """Reports per athlete, each with its own rolling year."""
    rolling = athletes.AthleteSelection()
    value, widths = reports.BOXES["avg_speed"]
    return {
        "athlete_anchors": _athletes(athletes.athlete_anchors, None),
        "athlete_select_rolling": _athletes(
            lambda df: df.select(athletes.KEY, *SELECTED), rolling
        ),
        "athlete_select_rolling_strict": _athletes(
            lambda df: df.select(athletes.KEY, *SELECTED), athletes.AthleteSelection(strict_anchor=True)
        ),
        "athlete_distance_by_month": _athletes(
            athletes.athlete_series(reports.OVERVIEW["distance"], reports.MONTH), rolling
        ),
        "athlete_activities_by_month_type": _athletes(
            athletes.athlete_series(reports.OVERVIEW["activities"], reports.MONTH | reports.TYPE), rolling
        ),
        "athlete_box_avg_speed": _athletes(
            athletes.athlete_box(value, "month_year", "Month", widths), rolling
        ),
        "athlete_domain_types": _athletes(lambda df: athletes.athlete_domain(df, "type"), None),
    }


def stage_queries() -> dict[str, Query]:
    """Pipeline stages and single operators."""
    run_2000 = Selection(2000, ("Run",), ("Brand#1", "Brand#2", "Brand#3"))
    selections = {
        "select_rolling_default": Selection(),
        "select_rolling_strict": Selection(ROLLING, strict_anchor=True),
        "select_year_brands": run_2000,
        "select_all_years": Selection(ALL_YEARS),
        "select_nothing": Selection(ALL_YEARS, types=()),
    }
    found: dict[str, Query] = {
        key: _selected(lambda df: df.select(*SELECTED), selection)
        for key, selection in selections.items()
    }
    found |= {
        "landing_pages": _stage(_landed),
        "landing_files": _stage(_landed_files),
        "landing_until_end": _stage(_landed_until_end),
        "refresh_pipeline": _stage(_stored_table),
        "fallback_table": _stage(_fallback_table),
        "stored_overview_distance_by_month_type": _stored_report(
            reports.overview_series("distance", True), Selection(year_partitioned=True)
        ),
        "stored_load_year": _stage(
            lambda s: table.load(
                s.spark, _refreshed_table(s), Selection(2000, year_partitioned=True), SELECTED
            )
        ),
        "stored_rolling_anchor": _stage(
            lambda s: table.stored_anchor(s.spark, _refreshed_table(s)).selectExpr(
                "anchor", "anchor - INTERVAL 12 MONTH AS window_start"
            )
        ),
        "stored_domain_years": _stage(_stored_year_domain),
        "stored_select_year": _stored_report(
            lambda df: df.select(*SELECTED), Selection(2000, year_partitioned=True)
        ),
        "landing_rejects": _stage(
            lambda s: landing.rejected(landing.parse_activity_pages(_pages(s), "payload"))
            .groupBy("errors")
            .agg(F.count(F.lit(1)).alias("pages"))
        ),
        "events_flat": _stage(
            lambda s: shape.flatten_structs(samples.event_properties(s.spark, s.sf_dir), "_")
        ),
        "activities_flat": _stage(
            lambda s: shape.drop_suffixed(shape.flatten_structs(s.raw(), "_")).drop(
                "start_latlng", "end_latlng"
            )
        ),
        "activities_converted": _stage(lambda s: e.convert_activities(s.raw()).select(*CONVERTED)),
        "activities_positions": _stage(
            lambda s: e.split_position(s.raw()).select("id", "start_latitude", "start_longitude")
        ),
        "activities_enriched": _whole(lambda df: df.select(*CALENDAR)),
        "activities_unwrapped": _whole(
            lambda df: df.select("id_activity", "moving_time", "elapsed_time"), wrap_24h=False
        ),
        "activities_season": _whole(
            lambda df: df.select("id_activity", "monthly_date"), month_mode="seasonal"
        ),
        "durations_text": _whole(_duration_texts, wrap_24h=False),
        "records_round_trip": _stage(_record_round_trip),
        "table_refresh_reload": _stage(_refresh_reload),
        "gear_converted": _stage(
            lambda s: shape.derive(
                e.convert_gear(s.gear()), {"distance": numeric.half_even("distance", 6)}
            )
        ),
        "gear_ids": _stage(lambda s: joins.used_ids(s.raw(), "gear_id")),
        "gear_used": _stage(
            lambda s: joins.used_dimension(s.gear(), s.raw(), "id", "gear_id").select(
                "id", "name", "brand_name"
            )
        ),
        "gear_join": _whole(lambda df: df.select(*GEARED)),
        "gear_join_spread": _stage(
            lambda s: joins.spread_left_lookup(
                s.raw().select("id", "gear_id"),
                s.gear().selectExpr("id AS gear_id", "name", "brand_name"),
                ["gear_id"],
            )
        ),
        "weather_observations": _stage(lambda s: s.observations()),
        "weather_join": _stage(
            lambda s: attach_nearest(
                e.split_position(s.raw()), s.observations(), **s.network()
            ).select("id", "temp", "rhum")
        ),
        "weather_join_shuffled": _stage(
            lambda s: attach_nearest(
                e.split_position(s.raw()),
                s.observations(),
                stations_at_most=samples.STATIONS,
                split_hot=True,
            ).select("id", "temp", "rhum")
        ),
        "weather_join_grid": _stage(
            lambda s: attach_nearest(e.split_position(s.raw()), s.observations()).select(
                "id", "temp", "rhum"
            )
        ),
        "pages_appended": _stage(
            lambda s: shape.append(
                [
                    s.raw().where("gear_id IS NULL").select("id", "type", "distance"),
                    s.raw().where("gear_id IS NOT NULL").select("id", "type", "gear_id"),
                ]
            )
        ),
        "nan_cleaned": _stage(
            lambda s: shape.nan_to_null(
                s.raw().selectExpr("id", "if(distance < 20000, double('NaN'), distance) AS distance")
            )
        ),
        "rolling_anchor": _whole(
            lambda df: latest_minute(df).selectExpr(
                "anchor", "anchor - INTERVAL 12 MONTH AS window_start"
            )
        ),
        "table_columns": _stage(
            lambda s: table.storable(
                s.enriched(refreshed=s.refreshed()).selectExpr("*", "1 AS not_in_table")
            ).drop("athlete.id")
        ),
    }
    return found


def all_queries() -> dict[str, Query]:
    return report_queries() | stage_queries() | athlete_queries()
