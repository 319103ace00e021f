"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession

from trailmill.llm import (
    decontaminate,
    jaccard,
    langid,
    licenses,
    lines,
    mixing,
    quality,
    search,
    secrets,
    topk,
    trie,
    toxicity,
    urls,
)


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_license_scan": licenses.op1_license_scan,
        "op2_ngram_jaccard": jaccard.op2_ngram_jaccard,
        "op3_source_mix": mixing.op3_source_mix,
        "op4_decontamination": decontaminate.op4_decontamination,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_language_id": langid.op6_language_id,
        "op7_top_k": topk.op7_top_k,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_url_filter": urls.op9_url_filter,
        "op10_line_dedup": lines.op10_line_dedup,
        "op11_conversation_trie": trie.op11_conversation_trie,
        "op12_ranked_search": search.op12_ranked_search,
        "op13_quality_rules": quality.op13_quality_rules,
        "pipeline": corpus_pipeline.run,
    }


def llm_sql() -> dict[str, str]:
    return {
        "op1_license_scan": licenses.op1_sql(),
        "op3_source_mix": mixing.op3_sql(),
        "op4_decontamination": decontaminate.op4_sql(),
        "op7_top_k": topk.op7_sql(),
        "op12_ranked_search": search.op12_sql(),
    }
