"""Reports per athlete: each athlete's own rolling year, keyed roll-ups, boxes
and domains, for a table that holds many athletes.

The global report treats the table as one athlete. Here every frame carries the
athlete key, and the rolling year counts back from each athlete's own latest
activity (the same label rule as :func:`~trailmill.operators.selection.latest_minute`).

Scale: anchors are one row per athlete, found by a hash aggregate that combines
map-side, so an athlete holding a third of all rows costs one row per task.
Activities meet their anchor through :func:`~trailmill.operators.joins.left_lookup`:
the anchors are broadcast behind a checked row count, else joined by a shuffle
in which the rows of hot athletes are spread over many tasks and only their
anchor rows are copied. The range condition (time at or after the start) is a
filter on the joined row. Roll-ups, boxes and domains group by the athlete as
one more key, so they inherit the skew safety of the global forms.

Activities without an athlete have no rolling year: a rolling selection leaves
them out; other selections and the frames keep them out of keyed results too.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmill.functions.temporal import minute_label_rank, minute_label_time
from trailmill.operators.boxes import box_summary
from trailmill.operators.joins import BROADCAST_ROWS, left_lookup
from trailmill.operators.rollup import rollup
from trailmill.operators.selection import DEFAULT_TYPES, ROLLING, Selection
from trailmill.operators.shape import quoted

KEY = "athlete_id"


def with_athlete(df: DataFrame, column: str = "athlete.id") -> DataFrame:
    """The enriched frame with its athlete as a plain ``athlete_id`` column."""
    if KEY in df.columns:
        return df
    return df.withColumn(KEY, F.col(quoted(column)))


def athlete_anchors(
    df: DataFrame, key: str = KEY, time: str = "start_date_local", strict: bool = False
) -> DataFrame:
    """``key``, ``anchor``, ``start``: each athlete's anchor and the start of its
    rolling year (anchor less 12 months)."""
    present = df.where(f"{quoted(key)} IS NOT NULL")
    if strict:
        anchors = present.groupBy(key).agg(F.expr(f"max({time}) AS anchor"))
    else:
        ranked = present.groupBy(key).agg(F.expr(f"max({minute_label_rank(time)}) AS _r"))
        anchors = ranked.selectExpr(quoted(key), f"{minute_label_time('_r')} AS anchor")
    return anchors.selectExpr("*", "anchor - INTERVAL 12 MONTH AS start")


@dataclass(frozen=True)
class AthleteSelection:
    """A :class:`Selection` whose rolling year is each athlete's own.

    Calendar years, types and brands filter as in the global selection.
    ``anchors_at_most`` is a bound on the number of athletes the caller can
    prove; without it the anchors are counted up to ``limit`` before they are
    broadcast.
    """

    years: str | int = ROLLING
    types: Sequence[str] = DEFAULT_TYPES
    brands: Sequence[str] | None = None
    strict_anchor: bool = False
    time: str = "start_date_local"
    key: str = KEY
    anchors_at_most: int | None = None
    limit: int = BROADCAST_ROWS

    def apply(self, df: DataFrame) -> DataFrame:
        df = with_athlete(df) if self.key == KEY else df
        if self.years != ROLLING:
            chosen = Selection(self.years, self.types, self.brands, time=self.time).apply(df)
            return chosen.where(f"{quoted(self.key)} IS NOT NULL")
        brand = F.col("brand_name")
        plain = [
            F.col("type").isin(list(self.types)),
            brand.isNotNull() if self.brands is None else brand.isin(list(self.brands)),
        ]
        chosen = df.where(reduce(lambda a, b: a & b, plain))
        anchors = athlete_anchors(df, self.key, self.time, self.strict_anchor).select(self.key, "start")
        joined = left_lookup(
            chosen.where(f"{quoted(self.key)} IS NOT NULL"),
            anchors,
            [self.key],
            rows_at_most=self.anchors_at_most,
            limit=self.limit,
        )
        return joined.where(F.col(self.time) >= F.col("start")).drop("start")


def athlete_series(measure: str, keys: dict[str, str], key: str = KEY):
    """A roll-up frame per athlete: ``keys`` and ``measure`` as in the global report."""
    return lambda df: rollup(df, {key: key} | keys, [measure])


def athlete_box(value: str, key: str, name: str, widths: Sequence[float], athlete: str = KEY):
    """Box statistics per athlete and ``key``: one box per (athlete, key)."""

    def frame(df: DataFrame) -> DataFrame:
        both = df.where(f"{quoted(athlete)} IS NOT NULL AND {quoted(key)} IS NOT NULL")
        pair = f"named_struct('a', {quoted(athlete)}, 'k', {quoted(key)})"
        boxed = box_summary(both, pair, value, name="_pair", widths=widths)
        rest = [c for c in boxed.columns if c != "_pair"]
        return boxed.selectExpr(f"_pair.a AS {quoted(athlete)}", f"_pair.k AS {quoted(name)}", *rest)

    return frame


def athlete_domain(df: DataFrame, column: str, key: str = KEY) -> DataFrame:
    """Per athlete, its distinct values of ``column``, most frequent first (``position``
    from 1; equal counts by value)."""
    counted = (
        df.where(f"{quoted(key)} IS NOT NULL AND {quoted(column)} IS NOT NULL")
        .groupBy(key, column)
        .agg(F.expr("count(1) AS n"))
    )
    return counted.selectExpr(
        "*", f"row_number() OVER (PARTITION BY {quoted(key)} ORDER BY n DESC, {quoted(column)}) AS position"
    )
