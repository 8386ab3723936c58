"""The training-data queries and their checking SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from loomgraph.llm import bin_slack, byte_bpe, filter_trie, html_blocks, jaccard_join, language_mixture, quality_kernel, quality_rules, repair_trie, secret_ledger, soft_mixing, sparse_suffix, transport_stream


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html_blocks.query,
        "op2_quality_rules": quality_rules.query,
        "op3_quality_classifier": quality_kernel.query,
        "op4_language_id": language_mixture.query,
        "op5_byte_bpe": byte_bpe.query,
        "op6_suffix_array_dedup": sparse_suffix.query,
        "op7_media_columns": transport_stream.query,
        "op8_ngram_jaccard_join": jaccard_join.query,
        "op9_secret_scans": secret_ledger.query,
        "op10_mixing_sources": soft_mixing.query,
        "op11_filter_interactions": filter_trie.query,
        "op12_packing": bin_slack.query,
        "op13_conversation_repair": repair_trie.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.ORACLE,
        "op6_suffix_array_dedup": sparse_suffix.ORACLE,
        "op8_ngram_jaccard_join": jaccard_join.ORACLE,
        "op9_secret_scans": secret_ledger.ORACLE,
        "op11_filter_interactions": filter_trie.ORACLE,
    }
