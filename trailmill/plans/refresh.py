"""Full refresh: landed files in, stored table out."""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.temporal import UTC_NOW
from trailmill.operators.joins import BROADCAST_ROWS, fits_broadcast, used_dimension
from trailmill.plans.enrich import enrich
from trailmill.sources import landing, table


def refresh(
    spark: SparkSession,
    pages: str | list[str],
    gear: str,
    table_path: str,
    observations: str | None = None,
    *,
    refreshed: Column | str = UTC_NOW,
    accept_partial: bool = False,
    multi_line: bool = True,
    observation_form: str = "parquet",
    metric: bool = False,
    stations_at_most: int | None = None,
    hours_at_most: int | None = None,
    wrap_24h: bool = True,
    month_mode: str = "calendar",
) -> DataFrame:
    """Rebuild the table from landed activity pages, gear records and weather
    observations, and return it.

    A page that cannot be parsed means that activities are missing: the last
    good table stays, unless ``accept_partial``. An error payload is where the
    data ends; the other pages count. A landing without a single proper activity
    leaves the last good table in place; with none either, the result is a typed
    empty frame.

    The landing is parsed once for the gates: an observation counts the statuses
    (``accepted``, ``rejected``, ``malformed``) while the rejects are written
    beside the snapshots, and of accepted records only the gear they name, which
    the gear lookup counts. The enrichment then parses the pages again, as a copy
    of all records would take more disk than the table itself; should a page have
    become unreadable meanwhile, the refresh fails and the last good table stays.
    With ``accept_partial`` the records are copied whole and enriched from there:
    a second parse, of the columns in use only, may take a record of a malformed
    page that the first did not. Rejects are copied to the rejects folder.
    """
    landed = landing.read_activity_pages(spark, pages, multi_line)
    snapshot = table.new_snapshot()
    staged = table.landed_path(table_path, snapshot)
    counts = Observation("landing")
    (
        landing.verdicts(landed, *(landed.columns if accept_partial else ["gear_id"]))
        .observe(
            counts,
            F.expr("count_if(status = 'accepted') AS accepted"),
            F.expr("count_if(status = 'malformed') AS malformed"),
        )
        .write.parquet(staged, compression="zstd")
    )
    seen = counts.get
    typed = landed.schema.add("status", "string")
    landed_again = spark.read.schema(typed).parquet(staged)
    rejects = landed_again.where("status <> 'accepted'").drop("status")
    rejects.write.parquet(table.rejects_path(table_path, snapshot))
    if not accept_partial and seen.get("malformed", 0) > 0:
        return table.read_table(spark, table_path)
    if not seen.get("accepted", 0):
        return table.read_table(spark, table_path)
    known = landed_again.where("status = 'accepted'").drop("status")
    fresh = landing.accepted(known) if accept_partial else landing.accepted_again(landed)
    all_gear = landing.read_gear(spark, gear, multi_line)
    # The size is checked on the gear records alone: the subset in use is
    # smaller still, but finding it costs a pass over the activities.
    small = fits_broadcast(all_gear)
    needed = all_gear if small else used_dimension(all_gear, known, "id", "gear_id")
    weather = None
    if observations is not None:
        weather = landing.read_observations(spark, observations, observation_form, metric)
    enriched = enrich(
        fresh,
        needed,
        weather,
        refreshed=refreshed,
        gear_rows_at_most=BROADCAST_ROWS if small else sys.maxsize,
        gear_keys=known.select("gear_id"),
        stations_at_most=stations_at_most,
        hours_at_most=hours_at_most,
        wrap_24h=wrap_24h,
        month_mode=month_mode,
        rebalance=True,
    )
    table.full_refresh(enriched, table_path, snapshot, rebalance=False)
    return table.read_table(spark, table_path)
