"""Registered queries of the corpus operators with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tallyspark.llm import alignment, bpe, chat, language, mixing, pii, quality, repeats, simhash, syncmers, token_files, toxicity, whitening
from tallyspark.llm.common import table


def _over_documents(operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_bpe": _over_documents(bpe.query),
        "op2_simhash": _over_documents(simhash.query),
        "op3_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
        "op4_syncmers": _over_documents(syncmers.query),
        "op5_chat_format": lambda spark, sf_dir: chat.query(table(spark, sf_dir, "conversations")),
        "op6_quality_rules": _over_documents(quality.query),
        "op7_mix_sources": _over_documents(mixing.query),
        "op8_token_files": _over_documents(token_files.query),
        "op9_suffix_dedup": _over_documents(repeats.query),
        "op10_pii": _over_documents(pii.query),
        "op11_whitening": lambda spark, sf_dir: whitening.query(table(spark, sf_dir, "embeddings")),
        "op12_token_alignment": _over_documents(alignment.query),
        "op13_language": _over_documents(language.query),
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_chat_format": chat.SQL,
        "op6_quality_rules": quality.SQL,
        "op7_mix_sources": mixing.SQL,
        "op9_suffix_dedup": repeats.SQL,
    }
