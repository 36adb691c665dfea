"""The registered text queries, one per operator, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from poolboard.llm import (
    classifier, context_tree, fingerprints, jaccard, line_dedup, merkle, mixing, packing, prefix_trie, secret_scan, token_count,
    token_file, trie_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": classifier.op1_quality,
        "op2_secret_scan": secret_scan.op2_secrets,
        "op3_ngram_jaccard": jaccard.op3_jaccard,
        "op4_exact_dedup": trie_dedup.op4_exact_dedup,
        "op5_mix_sources": mixing.op5_mix,
        "op6_language_model": context_tree.op6_language_model,
        "op7_fingerprints": fingerprints.op7_fingerprints,
        "op8_best_fit_packing": packing.op8_pack,
        "op9_token_counts": token_count.op9_token_counts,
        "op10_token_files": token_file.op10_token_files,
        "op11_prefix_trie": prefix_trie.op11_prefix_trie,
        "op12_line_dedup": line_dedup.op12_line_dedup,
        "op13_merkle_manifest": merkle.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_exact_dedup": trie_dedup.OP4_SQL,
        "op5_mix_sources": mixing.OP5_SQL,
        "op11_prefix_trie": prefix_trie.OP11_SQL,
        "op12_line_dedup": line_dedup.OP12_SQL,
        "op13_merkle_manifest": merkle.OP13_SQL,
    }
