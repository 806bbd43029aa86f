"""The queries of this subpackage by name, and the SQL that returns the same rows where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keysift.llm import decontamination, divergence, lines, packing, paragraphs, prefixes, quality, sharding, simhash, substrings, tokens, urls, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": quality.query,
        "op2_sharding": sharding.query,
        "op3_simhash": simhash.query,
        "op4_paragraph_dedup": paragraphs.query,
        "op5_warc": warc.query,
        "op6_url_reputation": urls.query,
        "op7_best_fit_packing": packing.query,
        "op8_line_dedup": lines.query,
        "op9_token_ids": tokens.query,
        "op10_decontamination": decontamination.query,
        "op11_source_divergence": divergence.query,
        "op12_prefix_trie": prefixes.query,
        "op13_substring_dedup": substrings.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": quality.SQL,
        "op2_sharding": sharding.SQL,
        "op5_warc": warc.SQL,
        "op6_url_reputation": urls.SQL,
        "op8_line_dedup": lines.SQL,
        "op11_source_divergence": divergence.SQL,
        "op12_prefix_trie": prefixes.SQL,
        "op13_substring_dedup": substrings.SQL,
    }
