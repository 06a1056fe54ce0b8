"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import conversation_trie, decontamination, divergence, html_extraction, packing, quality_classifier, quality_rules, quote_linking, secrets, simhash, token_files, toxicity, url_filter

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_decontamination": decontamination.op2_decontamination,
    "op3_quality_classifier": quality_classifier.op3_quality_classifier,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_token_files": token_files.op5_token_files,
    "op6_simhash": simhash.op6_simhash,
    "op7_packing": packing.op7_packing,
    "op8_secrets": secrets.op8_secrets,
    "op9_quote_linking": quote_linking.op9_quote_linking,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_source_divergence": divergence.op11_source_divergence,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_conversation_trie": conversation_trie.op13_conversation_trie,
}
ORACLE_SQL: dict[str, str] = {
    "op1_quality_rules": quality_rules.OP1_SQL,
    "op2_decontamination": decontamination.OP2_SQL,
    "op10_url_filter": url_filter.OP10_SQL,
    "op11_source_divergence": divergence.OP11_SQL,
    "op13_conversation_trie": conversation_trie.OP13_SQL,
}
