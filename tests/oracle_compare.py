"""Compare registered queries with their SQL on DuckDB, value by value.

    python tests/oracle_compare.py [sf_dir] [key part ...]
"""

from __future__ import annotations

import datetime
import sys
import time
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = ("lineitem", "part", "orders", "events")


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


# Spark type to the DuckDB type a matching column must have.
TYPES = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR",
    "date": "DATE", "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN",
}


def _cell(value: object) -> str:
    if value is None or value is pd.NaT or value is pd.NA or value != value:
        return "<null>"
    if isinstance(value, (bool, np.bool_)):
        return str(bool(value))
    if isinstance(value, (int, float, np.number)):
        return repr(float(value))
    if isinstance(value, (pd.Timestamp, datetime.date)):
        return pd.Timestamp(value).isoformat()
    return str(value)


def rows_of(df: pd.DataFrame) -> list[tuple[str, ...]]:
    cells = [[_cell(v) for v in df[c].tolist()] for c in sorted(df.columns)]
    return sorted(zip(*cells))


def type_difference(frame, con: duckdb.DuckDBPyConnection, sql: str) -> str | None:
    found = {r[0]: r[1] for r in con.execute(f"DESCRIBE {sql}").fetchall()}
    pairs = [(n, t, found.get(n)) for n, t in frame.dtypes if TYPES.get(t) != found.get(n)]
    return f"types {pairs}" if pairs else None


def difference(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    """None when equal; else the first difference found."""
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    for a, b in zip(rows_of(got), rows_of(want)):
        if a != b:
            return f"{a} != {b}"
    return None


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from trailmill.session import build_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    parts = sys.argv[2:]
    spark = build_session("local[8]", spark__sql__shuffle__partitions="8", spark__ui__enabled="false", spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = connect(sf_dir), oracle_sql(), 0
    for key, query in queries().items():
        if parts and not any(p in key for p in parts):
            continue
        started = time.time()
        try:
            frame = query(spark, sf_dir)
            got = frame.toPandas()
            spent = time.time() - started
            if key not in sqls:
                print(f"{key:36s} no oracle, {len(got)} rows, {spent:.2f}s", flush=True)
                continue
            issue = difference(got, con.execute(sqls[key]).df())
            issue = issue or type_difference(frame, con, sqls[key])
        except Exception as error:  # report and go on with the next key
            spent, got, issue = time.time() - started, [], f"{type(error).__name__}: {str(error)[:500]}"
        bad += issue is not None
        print(f"{key:36s} {'ok' if issue is None else 'DIFF ' + issue} {len(got)} rows {spent:.2f}s", flush=True)
    print("different:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(main())
