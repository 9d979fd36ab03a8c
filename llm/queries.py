"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from . import byte_bpe, jaccard_join, language_id, line_dedup, packing, quality_classifier, quality_rules, substring_dedup, suffix_dedup, topk

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_best_fit_packing": packing.op2_best_fit_packing,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_line_dedup": line_dedup.op4_line_dedup,
    "op5_topk": topk.op5_topk,
    "op6_byte_bpe": byte_bpe.op6_byte_bpe,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_language_id": language_id.op8_language_id,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
    "op10_jaccard_join": jaccard_join.op10_jaccard_join,
}
ORACLE_SQL: dict[str, str] = {"op4_line_dedup": line_dedup.SQL, "op5_topk": topk.SQL}
