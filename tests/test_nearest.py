"""Nearest station of the hour against brute force over all stations."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from trailmill.operators.nearest import attach_nearest

ACTIVITY = "id bigint, start_date_local timestamp_ntz, start_latitude double, start_longitude double"
STATION = "station_id bigint, lat double, lon double, obs_hour timestamp_ntz, temp double, rhum double"


def frames(spark, activities, stations):
    def build(rows, schema, time):
        text = schema.replace("timestamp_ntz", "string")
        return spark.createDataFrame(rows, text).withColumn(
            time, F.col(time).cast("timestamp_ntz")
        )

    return (
        build(activities, ACTIVITY, "start_date_local"),
        build(stations, STATION, "obs_hour"),
    )


def km(lat1, lon1, lat2, lon2):
    p, q = math.radians(lat1), math.radians(lat2)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(
        math.radians(lon2 - lon1) / 2
    ) ** 2
    return 12742 * math.asin(math.sqrt(min(1.0, h)))


def brute(activities, stations, max_km=math.inf):
    out = {}
    for i, time, lat, lon in activities:
        hour = time[:13]
        ranked = [
            (round(km(lat, lon, s[1], s[2]), 6), s[0], s[4])
            for s in stations
            if lat is not None and s[3][:13] == hour
        ]
        ranked = [r for r in ranked if r[0] <= max_km]
        out[i] = min(ranked)[2] if ranked else None
    return out


def world(seed, count, station_box):
    rng = random.Random(seed)
    hours = ["2024-01-01 05", "2024-01-01 06", "2024-01-02 05"]
    south, north, west, east = station_box
    stations = [
        (s, rng.uniform(south, north), rng.uniform(west, east), f"{h}:00:00", float(1000 * k + s), 50.0)
        for k, h in enumerate(hours[:2])
        for s in range(count)
        if rng.random() < 0.8
    ]
    corners = [(90.0, 0.0), (-90.0, 10.0), (0.0, 180.0), (0.0, -180.0), (12.5, 179.99)]
    points = corners + [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(150)]
    near = [(rng.uniform(south, north), rng.uniform(west, east)) for _ in range(100)]
    activities = [
        (i, f"{rng.choice(hours)}:{rng.randrange(60):02d}:07", lat, lon)
        for i, (lat, lon) in enumerate(points + near)
    ]
    return activities + [(9999, "2024-01-01 05:30:00", None, None)], stations


@pytest.mark.parametrize(
    "seed, count, box",
    [
        (1, 400, (-90, 90, -180, 180)),  # dense
        (2, 4, (-90, 90, -180, 180)),  # sparse: wide and whole-hour search
        (3, 60, (40, 42, 9, 12)),  # clustered: most of the world is far away
    ],
)
def test_grid_equals_brute_force(spark, seed, count, box):
    activities, stations = world(seed, count, box)
    acts, obs = frames(spark, activities, stations)
    got = {r.id: r.temp for r in attach_nearest(acts, obs).collect()}
    assert got == brute(activities, stations)


def test_direct_equals_brute_force_and_split_hot(spark):
    activities, stations = world(4, 20, (-90, 90, -180, 180))
    acts, obs = frames(spark, activities, stations)
    want = brute(activities, stations)
    for options in ({}, {"split_hot": True}):
        found = attach_nearest(acts, obs, stations_at_most=20, **options).collect()
        assert {r.id: r.temp for r in found} == want and len(found) == len(activities)
    limited = attach_nearest(acts, obs, stations_at_most=20, max_km=900.0)
    assert {r.id: r.temp for r in limited.collect()} == brute(activities, stations, 900.0)


def test_ties_go_to_the_lower_station_and_columns_stay(spark):
    acts, obs = frames(
        spark,
        [(1, "2024-01-01 05:59:59", 0.0, 0.0)],
        [(8, 0.0, 10.0, "2024-01-01 05:00:00", 8.0, 80.0), (3, 0.0, -10.0, "2024-01-01 05:00:00", 3.0, 30.0)],
    )
    out = attach_nearest(acts, obs)
    assert out.columns == [*acts.columns, "temp", "rhum"]
    assert (out.first().temp, out.first().rhum) == (3.0, 30.0)


def test_every_width_is_searched_once(spark):
    activities, stations = world(5, 6, (-90, 90, -180, 180))
    plan = attach_nearest(*frames(spark, activities, stations))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2  # one for each width; each was planned again by wider ones
