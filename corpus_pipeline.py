"""The corpus pipeline: from documents to a training mix.

Each stage takes what its predecessor kept, as a table; its decision takes
effect there. All but the last return the columns of documents, whatever these
are; the last returns each document as often as the mix takes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from trailmill.llm import decontaminate, jaccard, langid, lines, mixing
from trailmill.llm.common import landed, read

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose language is not clear. Learns from those that
    language ID does not hold out."""
    learned = docs.where("NOT coalesce(crc32(cast(doc_id as string)) % 3 = 1, false)")
    dictionaries = langid.train(learned.select("text", "lang"))
    kept = langid.identify(docs.select("*"), dictionaries).where("NOT rejected")
    return kept.select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines; counts the characters of what is left."""
    columns = {"n_chars": "char_length(text) AS n_chars"}
    kept = lines.dedup(docs)
    return kept.selectExpr(*[columns.get(c.lower(), f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return jaccard.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents by their sources' weights, each as often as it is taken."""
    return mixing.mix(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]

#: Compression and log templates have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = landed(stage(spark, docs, sf_dir), name)
    return docs
