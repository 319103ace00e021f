"""Session defaults the operators assume."""

from __future__ import annotations

import tempfile
from uuid import uuid4

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def build_session(
    master: str | None = None, app: str = "trailmill", **conf: str
) -> SparkSession:
    """A session with the defaults above; ``conf`` keys use ``__`` for dots.

    Shuffle width is left to the cluster: adaptive execution coalesces small
    shuffles, and ``spark.sql.shuffle.partitions`` is the ceiling to raise for
    large ones. Local runs pass a small value.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in DEFAULTS.items():
        builder = builder.config(key, value)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder ``spark.checkpoint.dir`` names.

    Only a local session, where all executors are this machine, may fall back
    to a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="trailmill-")
    return f"{folder.rstrip('/')}/{name}-{uuid4().hex}"
