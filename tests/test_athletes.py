"""Reports per athlete: own rolling years, one athlete with a third of all rows."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from trailmill.operators import athletes

SCHEMA = "athlete_id bigint, id_activity bigint, type string, brand_name string, start_date_local timestamp_ntz, average_speed double"


def frame(spark, hot_share: float = 1 / 3, n: int = 3000):
    rows, start = [], dt.datetime(2020, 1, 1, 6, 30)
    for i in range(n):
        athlete = 0 if i < n * hot_share else 1 + i % 97
        day = start + dt.timedelta(days=(i * 37) % 900, minutes=(i * 13) % 1440)
        rows.append((athlete, i, ("Run", "Ride", "Swim")[i % 3], None if i % 11 == 0 else "B", day, 1.0 + i % 17))
    rows.append((None, n, "Run", "B", start, 1.0))
    return spark.createDataFrame(rows, SCHEMA).repartition(7)


def plain_rolling(rows, strict=False):
    latest = {}
    for r in rows:
        if r.athlete_id is None:
            continue
        key = r.start_date_local if strict else r.start_date_local.strftime("%Y-%m-%d %I:%M %p")
        latest[r.athlete_id] = max(latest.get(r.athlete_id, key), key)
    chosen = set()
    for r in rows:
        if r.athlete_id is None or r.type not in ("Run", "Hike", "Walk", "Ride") or r.brand_name is None:
            continue
        anchor = latest[r.athlete_id]
        anchor = anchor if strict else dt.datetime.strptime(anchor, "%Y-%m-%d %I:%M %p")
        year_before = anchor.replace(year=anchor.year - 1)
        if r.start_date_local >= year_before:
            chosen.add(r.id_activity)
    return chosen


def test_rolling_year_is_each_athletes_own(spark):
    df = frame(spark)
    rows = df.collect()
    for strict in (False, True):
        got = athletes.AthleteSelection(strict_anchor=strict).apply(df).select("id_activity").collect()
        assert {r.id_activity for r in got} == plain_rolling(rows, strict)


COALESCE = "spark.sql.adaptive.coalescePartitions.enabled"
BROADCAST = "spark.sql.autoBroadcastJoinThreshold"


def test_shuffled_lookup_spreads_the_hot_athlete_and_agrees(spark):
    df = frame(spark)
    broadcast = athletes.AthleteSelection().apply(df)
    shuffled = athletes.AthleteSelection(limit=0).apply(df)
    assert sorted(broadcast.select("id_activity").collect()) == sorted(shuffled.select("id_activity").collect())
    held = {k: spark.conf.get(k) for k in (COALESCE, BROADCAST)}
    spark.conf.set(COALESCE, "false")
    spark.conf.set(BROADCAST, "-1")
    try:
        parts = shuffled.where("athlete_id = 0").select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert parts > 4


def test_keyed_frames(spark):
    df = frame(spark).withColumn("month_year", F.expr("CAST(date_trunc('month', start_date_local) AS DATE)"))
    chosen = athletes.AthleteSelection().apply(df)
    boxes = athletes.athlete_box("average_speed", "month_year", "Month", (10.24,))(chosen)
    counts = chosen.groupBy("athlete_id", "month_year").count()
    assert sorted((r.athlete_id, r.Month, r.n) for r in boxes.collect()) == sorted(tuple(r) for r in counts.collect())
    domain = athletes.athlete_domain(df, "type").where("athlete_id = 0").orderBy("position").collect()
    assert [r.position for r in domain] == [1, 2, 3] and domain[0].n >= domain[-1].n
    assert athletes.athlete_anchors(df).count() == 98
