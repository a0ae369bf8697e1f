"""The queries of this package and their SQL, for the driver's entry module."""

from __future__ import annotations

from . import ann, delta_lloyd, exact_dedup, filter_audit, html_text, jaccard_join, language_id, line_dedup, packing, pieces, substring_dedup, topk, toxicity

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_language_id": language_id.op3_language_id,
    "op4_jaccard_join": jaccard_join.op4_jaccard_join,
    "op5_ann": ann.op5_ann,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_topk": topk.op7_topk,
    "op8_packing": packing.op8_packing,
    "op9_html_text": html_text.op9_html_text,
    "op10_sentencepiece": pieces.op10_sentencepiece,
    "op11_delta_lloyd": delta_lloyd.op11_delta_lloyd,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_filter_audit": filter_audit.op13_filter_audit,
}
ORACLES = {
    "op1_line_dedup": line_dedup.ORACLE_SQL,
    "op4_jaccard_join": jaccard_join.ORACLE_SQL,
    "op6_substring_dedup": substring_dedup.ORACLE_SQL,
    "op7_topk": topk.ORACLE_SQL,
    "op11_delta_lloyd": delta_lloyd.ORACLE_SQL,
    "op12_exact_dedup": exact_dedup.ORACLE_SQL,
    "op13_filter_audit": filter_audit.ORACLE_SQL,
}
