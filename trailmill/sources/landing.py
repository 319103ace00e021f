"""Landed JSON: activity pages, gear records, weather observations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.functions.units import fahrenheit
from trailmill.operators.shape import derive
from trailmill.sources.schemas import ACTIVITY, CORRUPT, ERRORS, GEAR, OBSERVATION


def _page_schema(record: T.StructType) -> T.StructType:
    corrupt = T.StructField(CORRUPT, T.StringType())
    return T.StructType([*record.fields, ERRORS, corrupt])


def read_activity_pages(
    spark: SparkSession, path: str | list[str], multi_line: bool = True
) -> DataFrame:
    """Every record of every landed page, with ``errors`` and corrupt text.

    ``multi_line`` reads one JSON array per file, as pages arrive. Feeds
    re-landed as one record per line are splittable: pass False.
    """
    return (
        spark.read.schema(_page_schema(ACTIVITY))
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", CORRUPT)
        .json(path, multiLine=multi_line)
    )


def parse_activity_pages(pages: DataFrame, payload: str) -> DataFrame:
    """The same records from page payloads held as text in a column."""
    schema = T.ArrayType(_page_schema(ACTIVITY))
    records = F.from_json(
        F.col(payload), schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    )
    # The outer form: for the inner one Spark infers filters on the array and
    # would parse every payload again for each of them.
    return (
        pages.select(F.explode_outer(records).alias("record"))
        .where("record IS NOT NULL")
        .select("record.*")
    )


_REJECTED = f"errors IS NOT NULL OR {CORRUPT} IS NOT NULL OR id IS NULL"


def accepted(pages: DataFrame) -> DataFrame:
    """Proper records only, in the activity schema. Empty pages yield none."""
    return pages.where(f"NOT ({_REJECTED})").drop("errors", CORRUPT)


def accepted_again(pages: DataFrame) -> DataFrame:
    """Proper records of pages that could all be parsed before; one that no longer
    can fails the job."""
    lost = "raise_error('a landed page became unreadable')"
    kept = f"if({CORRUPT} IS NULL, NOT ({_REJECTED}), {lost})"
    return pages.where(kept).drop("errors", CORRUPT)


def rejected(pages: DataFrame) -> DataFrame:
    """Error payloads and malformed pages, for a reject table."""
    return pages.where(_REJECTED)


def with_status(pages: DataFrame) -> DataFrame:
    """Every record with ``status``: ``accepted``, ``rejected`` (an error payload
    or a record without id) or ``malformed`` (text that could not be parsed)."""
    status = (
        f"CASE WHEN {CORRUPT} IS NOT NULL THEN 'malformed' "
        f"WHEN {_REJECTED} THEN 'rejected' ELSE 'accepted' END"
    )
    return pages.withColumn("status", F.expr(status))


def verdicts(pages: DataFrame, *kept: str) -> DataFrame:
    """Every record with ``status``: rejects whole, of accepted records only the
    columns ``kept``; the others are NULL there."""
    columns = [
        c if c in kept else f"if(status = 'accepted', NULL, {c}) AS {c}" for c in pages.columns
    ]
    return with_status(pages).selectExpr(*columns, "status")


def malformed(rejects: DataFrame) -> DataFrame:
    """Of the rejects, pages that could not be parsed: data is missing. An
    error payload only marks where the data ends."""
    return rejects.where(f"{CORRUPT} IS NOT NULL")


#: The page that ends the data: not a JSON array (an error payload, malformed
#: text) or an empty one. It and every later page are left out.
ENDS = "coalesce(json_array_length(value), 0) = 0"


def read_pages_until_end(spark: SparkSession, path: str, order: str = "page") -> DataFrame:
    """Records of the pages before the first page that ends the data.

    Pages are landed one per file under ``path`` in folders ``{order}=...``
    whose values sort in page order (for instance zero-padded numbers). Each
    file is one page as the source sent it. Page order is the partition value,
    so the end is a minimum over the pages' statuses and the cut is a filter on
    the partition column: pages behind the end are pruned, not read. Statuses
    need no parse of the records; only kept pages are parsed, once.

    As a paging loop that stops at an error, a malformed reply or an empty page,
    every record behind that page is dropped, also when later pages hold data.
    Without such a page all pages are kept.
    """
    pages = spark.read.text(path, wholetext=True)
    end = pages.where(ENDS).agg(F.min(order).alias("end")).scalar()
    kept = pages.where(F.coalesce(F.col(order) < end, F.lit(True)))
    records = F.from_json(F.col("value"), T.ArrayType(ACTIVITY), {"mode": "PERMISSIVE"})
    return kept.select(order, F.explode(records).alias("record")).select(order, "record.*")


def read_gear(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    return spark.read.schema(GEAR).json(path, multiLine=multi_line)


def read_observations(
    spark: SparkSession, path: str, form: str = "parquet", metric: bool = False
) -> DataFrame:
    """Hourly station observations; metric feeds are converted to Fahrenheit."""
    read = spark.read.schema(OBSERVATION).format(form).load(path)
    return derive(read, {"temp": fahrenheit("temp")}) if metric else read
