"""The queries of the training-data operators, and the SQL of those SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import (dom_marginals, license_scan, lm_scoring, merkle, mixing, packing, phrase_index, pivot_topk, quality,
                            rotated_bits, tgm_join, token_counts, whitening)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_deleted_interpolation": lm_scoring.op1_deleted_interpolation,
    "op2_license_containment": license_scan.op2_license_containment,
    "op3_rotated_bits": rotated_bits.op3_rotated_bits,
    "op4_dom_marginals": dom_marginals.op4_dom_marginals,
    "op5_pivot_table": pivot_topk.op5_pivot_table,
    "op6_token_group_join": tgm_join.op6_token_group_join,
    "op7_curriculum_mix": mixing.op7_curriculum_mix,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_best_two_fit": packing.op9_best_two_fit,
    "op10_bradley_terry": quality.op10_bradley_terry,
    "op11_bitmap_merkle": merkle.op11_bitmap_merkle,
    "op12_lanczos_whitening": whitening.op12_lanczos_whitening,
    "op13_positional_index": phrase_index.op13_positional_index,
}

ORACLE_SQL: dict[str, str] = {
    "op2_license_containment": license_scan.OP2_SQL,
    "op5_pivot_table": pivot_topk.OP5_SQL,
    "op7_curriculum_mix": mixing.OP7_SQL,
    "op11_bitmap_merkle": merkle.OP11_SQL,
    "op13_positional_index": phrase_index.OP13_SQL,
}
