"""Scalar expressions against literal expected values."""

from __future__ import annotations

import datetime as dt
import math

import pytest

from trailmill.functions import geo, numeric, temporal, text, units


def ntz(moment: str) -> str:
    return f"TIMESTAMP_NTZ'{moment}'"


@pytest.mark.parametrize(
    "x, want",
    [("0.125D", 0.12), ("0.375D", 0.38), ("2.675D", 2.68), ("-0.125D", -0.12), ("1D", 1.0)],
)
def test_half_even(value, x, want):
    assert value(numeric.half_even("x"), x=x) == want


def test_half_even_nan_and_null(value):
    assert value(numeric.not_nan("x"), x="double('NaN')") is None
    assert value(numeric.to_units("x"), x="double('NaN')") is None
    assert value(numeric.half_even("x"), x="cast(null as double)") is None


@pytest.mark.parametrize("x, want", [("1234.567D", 1234), ("-3.9D", -3), ("2.999D", 3)])
def test_round_then_truncate(value, x, want):
    assert value(numeric.truncated(numeric.half_even("x")), x=x) == want


def test_units(value):
    assert value(units.miles2("x"), x="5000D") == 3.11
    assert value(units.mph2("x"), x="3D") == 6.71
    assert value(units.feet2("x"), x="100D") == 328.08
    assert value(units.miles("x"), x="1609.34D") == 1.0
    assert value(units.fahrenheit("x"), x="20D") == 68.0


@pytest.mark.parametrize(
    "moment, hour",
    [
        ("2024-03-01 10:30:00", 10),
        ("2024-03-01 11:30:00", 12),
        ("2024-03-01 11:29:59", 11),
        ("2024-03-01 23:29:59", 23),
        ("2024-03-01 23:30:00", 0),
        ("2024-03-01 23:45:00", 0),
        ("2024-03-01 00:30:00", 0),
        ("1969-12-31 22:40:00", 23),
    ],
)
def test_nearest_hour(value, moment, hour):
    assert value(temporal.nearest_hour("t"), t=ntz(moment)) == hour


def test_wrapped_and_whole_durations(value):
    assert value(temporal.wrap_day("s"), s="90061L") == 3661
    assert value(text.hours_minutes("s"), s="90061L") == "25 hrs 1 min"
    assert value(text.duration_text("s"), s="90061L") == "1 days 01:01:01"
    assert value(text.hours2("s"), s="5400L") == 1.5
    assert value(temporal.as_interval("s"), s="90061L") == dt.timedelta(seconds=90061)


@pytest.mark.parametrize(
    "stored, seconds",
    [
        ("0 days 01:01:01", 3661),
        ("1 day 00:00:05", 86405),
        ("12 days 23:59:59", 12 * 86400 + 86399),
        ("01:02:03", 3723),
        ("0 days 00:00:01.500000", 1),
        ("soon", None),
    ],
)
def test_duration_parse(value, stored, seconds):
    assert value(text.duration_seconds("d"), d=f"'{stored}'") == seconds


@pytest.mark.parametrize(
    "iso", ["2024-02-29T07:08:09Z", "2024-02-29T07:08:09.987+02:00", "2024-02-29 07:08:09"]
)
def test_zone_and_fraction_are_dropped(value, iso):
    assert value(temporal.wall_clock("t"), t=f"'{iso}'") == dt.datetime(2024, 2, 29, 7, 8, 9)


def test_bad_time_is_null(value):
    assert value(temporal.wall_clock("t"), t="'yesterday'") is None
    assert value(temporal.whole_second("t"), t=ntz("2024-02-29 07:08:09.75")) == dt.datetime(
        2024, 2, 29, 7, 8, 9
    )


def test_calendar_labels(value):
    t = ntz("2024-02-29 13:05:09")
    assert value(temporal.clock24("t"), t=t) == "13:05:09"
    assert value(temporal.clock12("t"), t=t) == "01:05 PM"
    assert value(temporal.weekday_name("t"), t=t) == "Thursday"
    assert value(temporal.weekday_number("t"), t=t) == 3
    assert value(temporal.month_name("t"), t=t) == "February"
    assert value(temporal.month_start("t"), t=t) == dt.date(2024, 2, 1)
    assert value(temporal.season_month("t"), t=t) == dt.date(2025, 2, 1)
    assert value(temporal.month_label("t"), t=t) == "Feb 2024"
    assert value(temporal.day_text("t"), t=t) == "2024-02-29"
    assert value(temporal.iso_text("t"), t=t) == "2024-02-29T13:05:09"
    assert value(text.ordered_weekday("n", "w"), n="0", w="'Monday'") == "1-Monday"


@pytest.mark.parametrize(
    "utc, label",
    [("2024-07-01 16:30:00", "2024-07-01 12:30 PM"), ("2024-01-01 02:00:00", "2023-12-31 09:00 PM")],
)
def test_refresh_stamp(value, utc, label):
    assert value(temporal.refresh_stamp("t"), t=ntz(utc)) == label
    assert value(temporal.refresh_time("l"), l=f"'{label}'") == dt.datetime.fromisoformat(utc)


def test_minute_label_rank_sorts_like_its_text(spark):
    moments = spark.sql(
        "SELECT timestampadd(SECOND, cast(id * 1013 as int), TIMESTAMP_NTZ'1969-12-30') AS t "
        "FROM range(600)"
    )
    rank = temporal.minute_label_rank("t")
    found = moments.selectExpr(
        f"{rank} AS r", f"{temporal.minute_label('t')} AS l",
        f"{temporal.minute_label(temporal.minute_label_time(rank))} AS again",
    ).collect()
    assert [x.l for x in sorted(found, key=lambda x: (x.r, x.l))] == sorted(x.l for x in found)
    assert all(x.l == x.again for x in found)


@pytest.mark.parametrize(
    "hundredths, shown",
    [(123450, "1,234.5"), (123400, "1,234.0"), (123456, "1,234.56"), (0, "0.0"), (5, "0.05")],
)
def test_grouped_text(value, hundredths, shown):
    assert value(text.grouped_hundredths("n"), n=f"{hundredths}L") == shown


def test_grouped_integer(value):
    assert value(text.grouped_integer("n"), n="1234567L") == "1,234,567"


def test_arc_matches_haversine(spark):
    places = [(51.5, -0.12, 40.71, -74.0), (0.0, 179.9, 0.0, -179.9), (90.0, 0.0, -90.0, 10.0)]
    for lat1, lon1, lat2, lon2 in places:
        a = geo.unit_vector(f"{lat1}D", f"{lon1}D")
        b = geo.unit_vector(f"{lat2}D", f"{lon2}D")
        km = spark.sql(
            f"SELECT {geo.arc_km(geo.chord(tuple(f'({x})' for x in a), tuple(f'({x})' for x in b)))} AS v"
        ).first()["v"]
        p, q = math.radians(lat1), math.radians(lat2)
        h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(
            math.radians(lon2 - lon1) / 2
        ) ** 2
        assert km == pytest.approx(12742 * math.asin(math.sqrt(min(1.0, h))), abs=1e-4)
