"""Small tables for the corpus operators."""

from __future__ import annotations

import duckdb
import pytest
from conftest import SMALL

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="session")
def docs_of(spark):
    """A documents frame, with a column whose name clashes with inner ones."""

    def build(*rows, partitions: int = 2):
        schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, frag string"
        full = [
            (r[0], r[1], *(r[2:] or ()), *[None] * (4 - len(r)), len(r[1] or ""), "x") for r in rows
        ]
        return spark.createDataFrame(full, schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def tables():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return con
