"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quillon.llm import changes, exact_dedup, hard_negatives, html_extract, jaccard, line_dedup, lm_score, mixing, packing, secret_scan, suffix_dedup, toxicity, vector_dedup


def queries() -> dict:
    return {
        "op1_vector_dedup": vector_dedup.op1_vector_dedup,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_html": html_extract.op3_html,
        "op4_secret_scan": secret_scan.op4_secret_scan,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_packing": packing.op6_packing,
        "op7_mixing": mixing.op7_mixing,
        "op8_lm_score": lm_score.op8_lm_score,
        "op9_jaccard": jaccard.op9_jaccard,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_changes": changes.op13_changes,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_vector_dedup": vector_dedup.ORACLE,
        "op4_secret_scan": secret_scan.oracle(),
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op7_mixing": mixing.ORACLE,
        "op9_jaccard": jaccard.ORACLE,
        "op11_suffix_dedup": suffix_dedup.op11_suffix_dedup,
        "op12_hard_negatives": hard_negatives.ORACLE,
    }
