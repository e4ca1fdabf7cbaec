"""The subpackage's queries and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ball_clusters, chat, conv_quality, fm_index, line_runs, mixing, near_dups, neighbours, packing, product_codes, rules, substrings, suffix_tree

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": mixing.query,
    "op2_conv_quality": conv_quality.query,
    "op3_chat_format": chat.query,
    "op4_quality_rules": rules.query,
    "op5_learned_partitions": neighbours.query,
    "op6_pattern_packing": packing.query,
    "op7_suffix_tree": suffix_tree.query,
    "op8_exact_substrings": substrings.query,
    "op9_near_duplicates": near_dups.query,
    "op10_line_runs": line_runs.query,
    "op11_fm_index": fm_index.query,
    "op12_product_codes": product_codes.query,
    "op13_ball_clusters": ball_clusters.query,
}
ORACLES: dict[str, str] = {"op3_chat_format": chat.ORACLE, "op10_line_runs": line_runs.ORACLE, "op12_product_codes": product_codes.ORACLE, "op13_ball_clusters": ball_clusters.ORACLE}
