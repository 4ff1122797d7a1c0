"""Queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from . import alignment, ann, html_text, jaccard_join, line_dedup, line_quality, lm_score, mixing, packing, personal_data, quality_lm, toxicity, whitening

QUERIES = {
    "op1_quality_lm": quality_lm.op1,
    "op10_html_text": html_text.op10,
    "op11_whitening": whitening.op11,
    "op12_personal_data": personal_data.op12,
    "op13_alignment": alignment.op13,
    "op2_jaccard_join": jaccard_join.op2,
    "op3_toxicity": toxicity.op3,
    "op4_packing": packing.op4,
    "op5_ann": ann.op5,
    "op6_lm_score": lm_score.op6,
    "op7_mixing": mixing.op7,
    "op8_line_dedup": line_dedup.op8,
    "op9_line_quality": line_quality.op9,
}
ORACLE_SQL = {"op2_jaccard_join": jaccard_join.SQL, "op8_line_dedup": line_dedup.SQL, "op9_line_quality": line_quality.SQL}
