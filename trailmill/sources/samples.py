"""Activity, gear and weather frames derived from the TPC-H-like test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.functions.units import fahrenheit

# A bound that follows from the mapping below, at every scale.
STATIONS = 10  # customer key modulo 10

# Read with a schema, no footer has to be opened to plan a query.
SCHEMAS = {
    "lineitem": (
        "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
        "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
        "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz"
    ),
    "part": (
        "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
        "p_retailprice double"
    ),
    "orders": (
        "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
        "o_orderdate timestamp_ntz, o_orderpriority string"
    ),
    "events": (
        "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, "
        "props string"
    ),
}


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[table]).parquet(f"{sf_dir}/{table}.parquet")


def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem")


def activities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One activity per line item."""
    return as_activities(line_items(spark, sf_dir))


def as_activities(items: DataFrame, *kept: str) -> DataFrame:
    """Line items as activities, besides the columns ``kept`` as they are."""
    upload = "l_orderkey * 10 + l_linenumber"
    moving = "cast(l_quantity * 1800 as bigint)"
    second = "cast((l_orderkey * 7919 + l_linenumber * 104729) % 86400 as int)"
    start = f"timestampadd(SECOND, {second}, l_shipdate)"
    speed = "l_extendedprice / (l_quantity * 1800D)"
    lat = "cast((l_orderkey * 37) % 18001 as double) / 100D - 90D"
    lon = "cast((l_orderkey * 101) % 36001 as double) / 100D - 180D"
    return items.selectExpr(
        *kept,
        f"({upload}) * 100000 + l_partkey AS id",
        f"{upload} AS upload_id",
        "named_struct('id', l_suppkey) AS athlete",
        f"concat('Activity ', {upload}) AS name",
        "CASE concat(l_returnflag, l_linestatus) WHEN 'RO' THEN 'Run' WHEN 'RF' THEN 'Ride' "
        "WHEN 'NO' THEN 'Walk' WHEN 'NF' THEN 'Hike' WHEN 'AF' THEN 'Swim' ELSE 'Yoga' END AS type",
        "if(l_partkey % 11 = 0, NULL, l_partkey) AS gear_id",
        "l_extendedprice AS distance",
        f"{speed} AS average_speed",
        f"{speed} * (1D + l_discount * 5D) AS max_speed",
        "l_quantity * l_linenumber AS total_elevation_gain",
        "l_quantity * 20D AS elev_high",
        "l_quantity * 10D AS elev_low",
        f"{moving} AS moving_time",
        f"{moving} + l_linenumber * 60 AS elapsed_time",
        f"{start} AS start_date",
        f"{start} AS start_date_local",
        f"array({lat}, {lon}) AS start_latlng",
        f"array({lat}, {lon}) AS end_latlng",
        "if(l_linenumber = 7, NULL, 100D + l_quantity + l_tax / 8D) AS average_heartrate",
        "if(l_linenumber = 7, NULL, 100D + l_quantity + l_tax * 500.125D) AS max_heartrate",
        "if(l_tax = 0D, NULL, l_quantity * (1D + l_tax) / 16D) AS suffer_score",
        f"cast({upload} as string) AS upload_id_str",
    )


def gear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "part").selectExpr(
        "p_partkey AS id",
        "concat(p_name, ' #', p_partkey) AS name",
        "p_brand AS brand_name",
        "p_size > 25 AS retired",
        "p_retailprice * 1000D AS distance",
        "p_retailprice * 1000D / 1609.34D AS converted_distance",
    )


def observations(spark: SparkSession, sf_dir: str, metric: bool = False) -> DataFrame:
    """One observation per station and hour: that of the lowest order key.

    ``metric`` leaves the temperature in degrees Celsius, as some feeds do.
    """
    celsius = "cast(cast(floor(o_totalprice) as bigint) % 45 - 5 as double)"
    return (
        _read(spark, sf_dir, "orders")
        .selectExpr(
            f"o_custkey % {STATIONS} AS station_id",
            "timestampadd(HOUR, cast(o_orderkey % 24 as int), o_orderdate) AS obs_hour",
            "o_orderkey",
            f"{celsius} AS celsius",
        )
        .groupBy("station_id", "obs_hour")
        .agg(
            F.expr("min_by(celsius, o_orderkey) AS celsius"),
            F.expr("min(o_orderkey) AS first_order"),
        )
        .selectExpr(
            "station_id",
            "cast(station_id * 15 - 67 as double) AS lat",
            "cast(station_id * 36 - 162 as double) AS lon",
            "obs_hour",
            f"{'celsius' if metric else fahrenheit('celsius')} AS temp",
            "cast(first_order % 101 as double) AS rhum",
        )
    )


def observed_hours(spark: SparkSession, sf_dir: str) -> int:
    """How many hours the observations can span, from the order dates."""
    days = "datediff(max(o_orderdate), min(o_orderdate)) + 1 AS days"
    span = _read(spark, sf_dir, "orders").agg(F.expr(days)).first()["days"]
    return (span or 0) * 24


def event_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their JSON property text parsed to a struct."""
    return _read(spark, sf_dir, "events").selectExpr(
        "event_id", "from_json(props, 'k bigint') AS props"
    )
