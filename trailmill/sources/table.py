"""The stored activity table: full refresh, reload, fallback, records."""

from __future__ import annotations

import json
from collections.abc import Sequence
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmill.functions import temporal as t
from trailmill.functions.text import duration_seconds, duration_text
from trailmill.operators.selection import Selection
from trailmill.operators.shape import conform, derive, drop_suffixed, nan_to_null, quoted
from trailmill.sources.schemas import TABLE

DURATIONS = ("moving_time", "elapsed_time")
TIMES = ("start_date", "start_date_local")
DATES = ("monthly_date", "month_year")


def storable(df: DataFrame, target: T.StructType = TABLE) -> DataFrame:
    """What an insert may carry: NaN as NULL, the target's columns only.

    An athlete id that only came as text takes its plain name; other ``*_str``
    twins are dropped.
    """
    if "athlete.id_str" in df.columns and "athlete.id" not in df.columns:
        df = df.withColumnRenamed("athlete.id_str", "athlete.id")
    return conform(nan_to_null(drop_suffixed(df)), target)


POINTER, SNAPSHOTS, REJECTS = "CURRENT", "snapshots", "rejects"


class MissingSnapshot(FileNotFoundError):
    """The pointer of a table names a snapshot that is not there."""


def _folder(spark: SparkSession, path: str):  # noqa: ANN202 - Hadoop objects
    """A Hadoop path and its file system."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def new_snapshot() -> str:
    return uuid4().hex


def landed_path(path: str, snapshot: str) -> str:
    """Where a refresh lands what it parsed, with its status."""
    return f"{path.rstrip('/')}/{LANDED}/{snapshot}"


def rejects_path(path: str, snapshot: str) -> str:
    return f"{path.rstrip('/')}/{REJECTS}/{snapshot}"


def _named(spark: SparkSession, path: str) -> list[str]:
    """The current snapshot and the one before it, from the pointer."""
    pointer, files = _folder(spark, f"{path.rstrip('/')}/{POINTER}")
    if not files.exists(pointer):
        return []
    stream = files.open(pointer)
    try:
        return stream.readLine().split()
    finally:
        stream.close()


def _point(spark: SparkSession, path: str, names: list[str]) -> None:
    """Replace the pointer in one step, so readers see the old or the new one."""
    base = path.rstrip("/")
    target, files = _folder(spark, f"{base}/{POINTER}")
    fresh, _ = _folder(spark, f"{base}/{POINTER}-{uuid4().hex}")
    stream = files.create(fresh, False)
    try:
        stream.writeBytes(" ".join(names) + "\n")
    finally:
        stream.close()
    jvm = spark._jvm
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(
        target.toUri(), spark._jsc.hadoopConfiguration()
    )
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    options = spark.sparkContext._gateway.new_array(rename, 1)
    options[0] = rename.OVERWRITE
    context.rename(context.makeQualified(fresh), context.makeQualified(target), options)


#: Unnamed folders that may still be in use by a concurrent refresh (a snapshot
#: without ``_SUCCESS``, landed and rejected records) are kept until this old.
GRACE_SECONDS = 3600
LANDED = "_landed"


#: Statistics of a snapshot, observed while it is written, in its folder.
STATS = "_stats.json"


def write_snapshot(df: DataFrame, path: str, snapshot: str, rebalance: bool = True) -> None:
    """Write a snapshot folder; readers do not see it until :func:`commit`.

    REBALANCE sizes files by year and splits years that are larger than
    others; nothing is gathered into one task per year. Without ``rebalance``
    the caller has done so (``enrich`` does it on fewer columns). The same pass observes
    the rolling anchor (as a label rank and as a time), the years and the row
    count, and stores them in ``_stats.json``, so the anchor and the year domain
    of a stored table need no scan. The years are a domain: one value a year.
    """
    folder = f"{path.rstrip('/')}/{SNAPSHOTS}/{snapshot}"
    seen = Observation("snapshot")
    observed = storable(df).observe(
        seen,
        F.expr(f"max({t.minute_label_rank('start_date_local')}) AS anchor_rank"),
        F.expr("CAST(max(start_date_local) AS STRING) AS latest"),
        F.expr("sort_array(collect_set(year)) AS years"),
        F.expr("count(1) AS rows"),
    )
    sized = observed.hint("rebalance", "year") if rebalance else observed
    sized.write.partitionBy("year").parquet(folder, compression="zstd")
    target, files = _folder(df.sparkSession, f"{folder}/{STATS}")
    stream = files.create(target, True)
    try:
        stream.writeBytes(json.dumps({k: seen.get.get(k) for k in ("anchor_rank", "latest", "years", "rows")}))
    finally:
        stream.close()


def snapshot_stats(spark: SparkSession, path: str) -> dict | None:
    """The statistics of the current snapshot; None without a table or for a
    snapshot written before statistics were kept."""
    names = _named(spark, path)
    if not names:
        return None
    target, files = _folder(spark, f"{path.rstrip('/')}/{SNAPSHOTS}/{names[0]}/{STATS}")
    if not files.exists(target):
        return None
    stream = files.open(target)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def stored_anchor(spark: SparkSession, path: str) -> DataFrame:
    """One row, ``anchor``: the rolling year's anchor of the stored table, from its
    statistics (the largest minute label, as :func:`latest_minute` finds it)."""
    stats = snapshot_stats(spark, path) or {}
    rank = spark.createDataFrame([(stats.get("anchor_rank"),)], "r bigint")
    return rank.selectExpr(f"{t.minute_label_time('r')} AS anchor")


def stored_years(spark: SparkSession, path: str) -> list[int]:
    """The years of the stored table, from its statistics."""
    return list((snapshot_stats(spark, path) or {}).get("years") or [])


def commit(spark: SparkSession, path: str, snapshot: str, grace_seconds: float = GRACE_SECONDS) -> None:
    """Point the table at ``snapshot``, keeping the snapshot current until now
    as the previous one, then delete old folders.

    The pointer is read again just before it is replaced, so a refresh that
    committed meanwhile stays named (optimistic: the last commit wins, the one
    before it stays readable). Of the folders named by neither, a finished
    snapshot (with ``_SUCCESS``) is deleted at once; one without it, which
    another refresh may still be writing, and landed or rejected records, which
    it may still read, only when older than ``grace_seconds``. Should a
    concurrent cleanup have deleted this snapshot before the pointer moved,
    the pointer is put back and :class:`MissingSnapshot` raised.
    """
    base = path.rstrip("/")
    current = _named(spark, path)[:2]
    _point(spark, path, [snapshot, *[c for c in current[:1] if c != snapshot]])
    mine, files = _folder(spark, f"{base}/{SNAPSHOTS}/{snapshot}")
    if not files.exists(mine):
        if current:
            _point(spark, path, current)
        raise MissingSnapshot(mine.toString())
    keep = {snapshot, *current[:1]}
    now_ms = spark._jvm.java.lang.System.currentTimeMillis()
    for part in (SNAPSHOTS, REJECTS, LANDED):
        folder, files = _folder(spark, f"{base}/{part}")
        for old in files.listStatus(folder) if files.exists(folder) else ():
            if old.getPath().getName() in keep:
                continue
            young = now_ms - old.getModificationTime() < grace_seconds * 1000
            done, _ = _folder(spark, f"{old.getPath().toString()}/_SUCCESS")
            if not young or (part == SNAPSHOTS and files.exists(done)):
                files.delete(old.getPath(), True)


def full_refresh(
    df: DataFrame,
    path: str,
    snapshot: str | None = None,
    grace_seconds: float = GRACE_SECONDS,
    rebalance: bool = True,
) -> None:
    """Replace the table at ``path`` by a new snapshot.

    Every snapshot has a folder of its own. A small pointer names the current
    one and is replaced when the new one is complete: a failed job leaves the
    old table, nothing is moved or copied, and readers that have begun keep
    their files until the refresh after the next. Two refreshes at once both
    leave readable snapshots (see :func:`commit`).
    """
    snapshot = snapshot or new_snapshot()
    write_snapshot(df, path, snapshot, rebalance)
    commit(df.sparkSession, path, snapshot, grace_seconds)


def empty_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TABLE)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The current snapshot; a typed empty frame only if none was ever made."""
    names = _named(spark, path)
    if not names:
        return empty_table(spark)
    stored = f"{path.rstrip('/')}/{SNAPSHOTS}/{names[0]}"
    folder, files = _folder(spark, stored)
    if not files.exists(folder):
        raise MissingSnapshot(stored)
    return retype(spark.read.schema(TABLE).parquet(stored))


def retype(df: DataFrame) -> DataFrame:
    """Rows in record form to typed ones: durations to seconds, times to
    whole-second naive timestamps, and the calendar and clock columns rebuilt
    from the local start.

    Columns that are typed already pass untouched, so filters on a stored
    table reach its files.
    """
    text = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    durations = {n: duration_seconds(n) for n in DURATIONS if n in text}
    times = {n: t.wall_clock(n) for n in TIMES if n in text}
    typed = derive(df, durations | times) if durations or times else df
    start = "start_date_local"
    if start not in times:
        return typed
    return derive(
        typed,
        {"start_time_local_24h": t.clock24(start), "start_time_local_12h": t.clock12(start)}
        | {n: t.month_start(start) for n in DATES},
    )


def usable(new: DataFrame, last_good: DataFrame) -> DataFrame:
    """The new snapshot, or the last good one when the new one has no rows."""
    return last_good if new.isEmpty() else new


def load(
    spark: SparkSession,
    path: str,
    selection: Selection | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """What one analysis reads of the table, cached across its reports.

    The selection and the columns are applied first, so they prune the scan and
    only what is left is kept; ``unpersist`` to refresh.
    """
    chosen = read_table(spark, path)
    if selection is not None:
        chosen = selection.apply(chosen)
    if columns is not None:
        chosen = chosen.select(*map(quoted, columns))
    if "refresh_date" in chosen.columns:
        label = t.minute_label(t.minute_label_parsed("refresh_date"))
        chosen = derive(chosen, {"refresh_date": label})
    return chosen.persist(StorageLevel.MEMORY_AND_DISK)


def to_records(df: DataFrame) -> DataFrame:
    """Record form for row-oriented sinks: durations, times and dates as text,
    NaN as NULL."""
    present = set(df.columns)
    text = {c: duration_text(c) for c in DURATIONS} | {c: t.iso_text(c) for c in TIMES + DATES}
    return nan_to_null(derive(df, {c: x for c, x in text.items() if c in present}))
