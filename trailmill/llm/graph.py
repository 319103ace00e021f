"""Connected components of a link table, by rounds of joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.llm.common import landed


def components(links: DataFrame) -> DataFrame:
    """``node, label`` for every node of ``a, b`` links; the label is the
    smallest node of its component.

    Each round links every node to the smallest node it can see, first for
    larger neighbours, then for smaller ones. A star with a million arms is
    minima of partial minima, never a list. Rounds grow with the logarithm of
    the longest chain; the state of each is landed.
    """
    # Every link in both directions: (u, v) and (v, u).
    edges = landed(
        links.selectExpr("greatest(a, b) AS u", "least(a, b) AS v").where("u <> v").distinct(), "links"
    )
    while True:
        before = edges
        # Large star: larger neighbours of u go to the smallest node near u.
        both = edges.union(edges.selectExpr("v AS u", "u AS v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).selectExpr("u", "least(u, m) AS m")
        large = both.where("v > u").join(low, "u").selectExpr("v AS u", "m AS v").distinct()
        # Small star: u and its smaller neighbours go to the smallest of them.
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(down, "u")
            .selectExpr("inline(array(struct(v AS u, m AS v), struct(u AS u, m AS v)))")
            .where("u <> v")
            .distinct()
        )
        edges = landed(small, "links")
        total = "count(1) AS n", "bit_xor(xxhash64(u, v)) AS x"
        if before.selectExpr(*total).first() == edges.selectExpr(*total).first():
            break
    stars = edges.selectExpr("u AS node", "v AS label")
    return stars.union(stars.select("label", "label").distinct())
