"""Box summaries against hand cases and a plain sorted-list computation."""

from __future__ import annotations

import math
import random

import pytest

from trailmill.operators import boxes


def frame(spark, samples):
    return spark.createDataFrame(samples, "k string, v double")


def expected(values):
    a = sorted(values)
    n = len(a)

    def at(p):
        position = min(max(p * n - 0.5, 0.0), n - 1.0)
        share = position - math.floor(position)
        return share * a[math.ceil(position)] + (1 - share) * a[math.floor(position)]

    q1, median, q3 = at(0.25), at(0.5), at(0.75)
    low = min(q1, min(x for x in a if x >= 2.5 * q1 - 1.5 * q3))
    high = max(q3, max(x for x in a if x <= 2.5 * q3 - 1.5 * q1))
    return (n, q1, median, q3, low, high, sum(x < low or x > high for x in a))


def summary(df, **options):
    return {r[0]: tuple(r)[1:] for r in boxes.box_summary(df, "k", "v", **options).collect()}


def test_hand_cases(spark):
    samples = [("a", x) for x in (1.0, 2.0, 2.0, 3.0, 4.0, 10.0)] + [("one", 7.0)]
    samples += [("a", None), ("none", None), ("nan", float("nan")), (None, 5.0)]
    got = summary(frame(spark, samples))
    assert got == {
        "a": (6, 2.0, 2.5, 4.0, 1.0, 4.0, 1),
        "one": (1, 7.0, 7.0, 7.0, 7.0, 7.0, 0),
    }


@pytest.mark.parametrize("widths", [boxes.HUNDREDTHS, boxes.RAW])
@pytest.mark.parametrize("keys_at_most", [None, 10])
def test_random_groups(spark, widths, keys_at_most):
    rng = random.Random(11)
    groups = {
        "flat": [5.0] * 40,
        "two": [1.25, 900.5],
        "wide": [round(rng.uniform(-500, 5000), 2) for _ in range(997)],
        "hot": [round(rng.gauss(50, 9), 2) for _ in range(4000)],
        "raw": [rng.gauss(50, 9) for _ in range(500)],
    }
    samples = [(k, v) for k, values in groups.items() for v in values]
    rng.shuffle(samples)
    got = summary(frame(spark, samples), widths=widths, keys_at_most=keys_at_most)
    assert got == {k: expected(v) for k, v in groups.items()}
    for n, q1, median, q3, low, high, _ in got.values():
        assert low <= q1 <= median <= q3 <= high and n > 0


def test_points_flag_exactly_the_outliers(spark):
    samples = [("a", float(x)) for x in (1, 2, 2, 3, 4, 10)]
    points = boxes.box_points(frame(spark, samples), "k", "v").collect()
    assert sorted((p.value, p.is_outlier) for p in points) == [
        (1.0, False), (2.0, False), (2.0, False), (3.0, False), (4.0, False), (10.0, True),
    ]


def test_linear_method_is_the_builtin_percentile(spark):
    rng = random.Random(5)
    df = frame(spark, [("a", round(rng.uniform(0, 100), 2)) for _ in range(321)])
    want = df.selectExpr("percentile(v, array(0.25, 0.5, 0.75)) AS p").first().p
    assert summary(df, method="linear")["a"][1:4] == pytest.approx(tuple(want))


def test_approx_is_close(spark):
    df = frame(spark, [("a", float(x)) for x in range(1001)])
    assert summary(df, method="approx")["a"][1:4] == pytest.approx((250, 500, 750), abs=2)
