"""Filters a report applies, and the domains they choose from."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmill.functions.temporal import minute_label, minute_label_rank, minute_label_time
from trailmill.operators.shape import quoted

# The year choices besides a calendar year, and the types
# selected before the user chooses.
ALL_YEARS = "All"
ROLLING = "Rolling 12 Months"
DEFAULT_TYPES = ("Run", "Hike", "Walk", "Ride")


def latest_minute(
    df: DataFrame,
    time: str = "start_date_local",
    strict: bool = False,
    year_partitioned: bool = False,
) -> DataFrame:
    """One row, ``anchor``: the activity time the rolling year counts back from.

    The label shown to users has a 12-hour clock, and its largest text is the
    anchor; ``strict`` takes the true latest time instead. Labels start with
    the date, so in a table partitioned by year only the last year is read.
    """
    if year_partitioned:
        last = df.agg(F.expr("max(year) AS last")).scalar()
        df = df.where(F.col("year") == last)
    if strict:
        return df.agg(F.expr(f"max({time}) AS anchor"))
    ranked = df.agg(F.expr(f"max({minute_label_rank(time)}) AS r"))
    return ranked.selectExpr(f"{minute_label_time('r')} AS anchor")


def latest_label(df: DataFrame, time: str = "start_date_local") -> DataFrame:
    """One row, ``label``: the largest minute label."""
    return latest_minute(df, time).selectExpr(f"{minute_label('anchor')} AS label")


@dataclass(frozen=True)
class Selection:
    """Chosen years, activity types and gear brands; the parts are ANDed.

    ``brands=None`` means every brand in use, which leaves out activities
    without a brand, exactly as naming all brands would. An empty ``types`` or
    ``brands`` selects nothing. Where the frame has a ``year``, year choices
    name it too and prune the directories of a table partitioned by it;
    ``year_partitioned`` says that it is one, so that the rolling year's anchor
    is looked up in the last year only.
    """

    years: str | int = ROLLING
    types: Sequence[str] = DEFAULT_TYPES
    brands: Sequence[str] | None = None
    strict_anchor: bool = False
    year_partitioned: bool = False
    time: str = "start_date_local"

    def predicates(self, df: DataFrame) -> list[Column]:
        brand = F.col("brand_name")
        return [
            F.col("type").isin(list(self.types)),
            *self._year_conditions(df),
            brand.isNotNull() if self.brands is None else brand.isin(list(self.brands)),
        ]

    def _year_conditions(self, df: DataFrame) -> list[Column]:
        if self.years == ALL_YEARS:
            return []
        if self.years == ROLLING:
            # Scalar subqueries: evaluated once, then ordinary comparisons that
            # are pushed into a Parquet scan of a stored table.
            anchor = latest_minute(df, self.time, self.strict_anchor, self.year_partitioned)
            start = anchor.selectExpr("anchor - INTERVAL 12 MONTH AS start").scalar()
            conditions = [F.col(self.time) >= start]
            if "year" in df.columns:  # prunes where it is a partition column
                conditions.append(F.col("year") >= F.year(start))
            return conditions
        # A range on the stored time can be pushed down; year(time) cannot.
        year = int(self.years)
        in_range = (
            f"{self.time} >= TIMESTAMP_NTZ'{year:04d}-01-01' "
            f"AND {self.time} < TIMESTAMP_NTZ'{year + 1:04d}-01-01'"
        )
        return [F.expr(in_range + (f" AND year = {year}" if "year" in df.columns else ""))]

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(reduce(lambda a, b: a & b, self.predicates(df)))


def frequency_domain(df: DataFrame, column: str) -> DataFrame:
    """Distinct values, most frequent first; equal counts by value."""
    counted = df.where(f"{quoted(column)} IS NOT NULL").groupBy(column).agg(F.expr("count(1) AS n"))
    return counted.orderBy(F.desc("n"), column)


def year_domain(df: DataFrame) -> DataFrame:
    """``All``, ``Rolling 12 Months``, then years, latest first.

    ``position`` carries the order and is not the row number.
    """
    literals = df.sparkSession.sql(
        f"SELECT * FROM VALUES ('{ALL_YEARS}', -2), ('{ROLLING}', -1) AS t(label, position)"
    )
    years = (
        df.where("year IS NOT NULL")
        .select("year")
        .distinct()
        .selectExpr("cast(year as string) AS label", "9999 - year AS position")
    )
    return literals.unionByName(years).orderBy("position")
