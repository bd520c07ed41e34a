"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import decontamination, html_extraction, line_dedup, packing, passage_dedup, pii, quality_rules, simhash, suffix_dedup, token_counts

QUERIES = {
    "op1_best_fit_packing": packing.op1_best_fit_packing,
    "op2_pii": pii.op2_pii,
    "op3_line_dedup": line_dedup.op3_line_dedup,
    "op4_html_extraction": html_extraction.op4_html_extraction,
    "op5_substring_dedup": passage_dedup.op5_substring_dedup,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_suffix_array_dedup": suffix_dedup.op7_suffix_array_dedup,
    "op8_simhash_near_dedup": simhash.op8_simhash_near_dedup,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_benchmark_decontamination": decontamination.op10_benchmark_decontamination,
}

ORACLE_SQL = {"op3_line_dedup": line_dedup.ORACLE_SQL, "op6_quality_rules": quality_rules.ORACLE_SQL}
