"""Names of the registered training-data queries and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from lectern.llm import queries_dedup, queries_manifest, queries_scan, queries_text


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": queries_text.op1_quality,
        "op2_sentencepiece": queries_text.op2_sentencepiece,
        "op3_toxicity": queries_text.op3_toxicity,
        "op4_decontaminate": queries_dedup.op4_decontaminate,
        "op5_sharding": queries_scan.op5_sharding,
        "op6_main_text": queries_scan.op6_main_text,
        "op7_nearest": queries_scan.op7_nearest,
        "op8_licences": queries_scan.op8_licences,
        "op9_simhash": queries_dedup.op9_simhash,
        "op10_chat": queries_scan.op10_chat,
        "op11_alignment": queries_text.op11_alignment,
        "op12_bpe": queries_text.op12_bpe,
        "op13_manifest": queries_manifest.op13_manifest,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """The scorers, encoders, extraction and graph queries are tested against brute force and held-out rows instead."""
    return {
        "op4_decontaminate": queries_dedup.OP4_SQL,
        "op5_sharding": queries_scan.OP5_SQL,
        "op8_licences": queries_scan.OP8_SQL,
        "op10_chat": queries_scan.OP10_SQL,
        "op13_manifest": queries_manifest.OP13_SQL,
    }
