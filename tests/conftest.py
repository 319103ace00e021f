from __future__ import annotations

import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
sys.path.insert(0, str(ROOT / "tests"))

from trailmill.session import build_session  # noqa: E402

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[8]",
        "tests",
        spark__sql__shuffle__partitions="8",
        spark__driver__memory="8g",
        spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false",
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture()
def value(spark):
    """Evaluate one SQL expression over one-row columns."""

    def evaluate(expression: str, **columns: str):
        source = ", ".join(f"{x} AS {n}" for n, x in columns.items()) or "1 AS one"
        return spark.sql(f"SELECT {source}").selectExpr(f"{expression} AS v").first()["v"]

    return evaluate
