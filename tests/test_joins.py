"""Lookups: suffixes, skew and missing keys."""

from __future__ import annotations

from trailmill.operators import joins
from trailmill.operators.shape import append, drop_suffixed, flatten_structs, nan_to_null, title_headers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_only_colliding_columns_take_a_suffix(spark):
    acts = spark.sql("SELECT * FROM VALUES (1, 'a', 10, 'g1'), (2, 'b', 20, NULL) t(id, name, d, gear_id)")
    gear = spark.sql("SELECT * FROM VALUES ('g1', 'shoe', 'x') t(id, name, brand_name)")
    out = joins.left_enrich(acts, gear, "gear_id", "id", ("_activity", "_gear"))
    assert out.columns == ["gear_id", "id_activity", "name_activity", "d", "name_gear", "brand_name"]
    assert rows(out) == [("g1", 1, "a", 10, "shoe", "x"), (None, 2, "b", 20, None, None)]


def test_spread_lookup_equals_plain_join(spark):
    # A third of all rows share one key, a third has none.
    left = spark.range(3000).selectExpr(
        "id", "CASE id % 3 WHEN 0 THEN 7 WHEN 1 THEN NULL ELSE id % 500 END AS k"
    )
    right = spark.range(400).selectExpr("id AS k", "concat('v', id) AS v")
    want = rows(left.join(right, ["k"], "left").select("id", "k", "v"))
    for limit in (1_000, 10):  # broadcast, then spread
        got = joins.left_lookup(left, right, ["k"], limit=limit)
        assert rows(got.select("id", "k", "v")) == want
    assert len(want) == 3000


def test_hot_keys_are_few_and_right(spark):
    left = spark.range(10_000).selectExpr("IF(id % 3 = 0, -1, id) AS k")
    assert rows(joins.hot_keys(left, ["k"], share=0.01)) == [(-1,)]


def test_size_check_stops_early(spark):
    assert joins.fits_broadcast(spark.range(10), limit=10)
    assert not joins.fits_broadcast(spark.range(11), limit=10)
    assert joins.fits_broadcast(spark.range(10**12), rows_at_most=5)


def test_used_dimension(spark):
    facts = spark.sql("SELECT * FROM VALUES ('a'), ('a'), (NULL), ('z') t(gear_id)")
    gear = spark.sql("SELECT * FROM VALUES ('a', 1), ('b', 2) t(id, n)")
    assert rows(joins.used_ids(facts, "gear_id")) == [("a",), ("z",)]
    assert rows(joins.used_dimension(gear, facts, "id", "gear_id")) == [("a", 1)]


def test_shape_operators(spark):
    nested = spark.sql(
        "SELECT 1 AS id, named_struct('id', 5, 'in', named_struct('x', 2)) AS athlete, array(1) AS a, 'q' AS id_str"
    )
    flat = flatten_structs(nested)
    assert flat.columns == ["id", "athlete.id", "athlete.in.x", "a", "id_str"]
    assert drop_suffixed(flat).columns == ["id", "athlete.id", "athlete.in.x", "a"]
    assert title_headers(nested.select("id_str")).columns == ["Id Str"]
    cleaned = nan_to_null(spark.sql("SELECT double('NaN') AS a, float('NaN') AS b, 'NaN' AS c, 1.5D AS d"))
    assert rows(cleaned) == [(None, None, "NaN", 1.5)]
    both = append([spark.sql("SELECT 1 AS a, 2 AS b"), spark.sql("SELECT 3 AS a, 4 AS c")])
    assert rows(both) == [(1, 2, None), (3, None, 4)]
