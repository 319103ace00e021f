"""What the corpus operators share: reading tables, cutting lineage, spans of text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmill.session import shared_path

#: A run of characters that are no ASCII white space.
SPACED_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def landed(df: DataFrame, name: str) -> DataFrame:
    """The rows, written to the shared folder and read back.

    Later steps read the files instead of computing the rows again, also after
    executors are lost.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def joined_spans(spans: str) -> str:
    """SQL text: an array of ``kind:start:end`` texts as one comma-joined text."""
    return f"array_join({spans}, ',')"


def distinct_sorted(values: str) -> str:
    return f"array_join(array_sort(array_distinct({values})), ',')"


def same_row(left: str, right: str, *columns: str) -> F.Column:
    """Null-safe equality of key columns of two aliased frames."""
    condition = F.lit(True)
    for c in columns:
        condition = condition & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return condition
