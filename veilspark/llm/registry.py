"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import decontaminate, exact_dedup, html_text, interpolation, licenses, mixing, near_dedup, quality, substring_dedup, warc

QUERIES = {
    "op1_substring_dedup": substring_dedup.op1_substring_dedup,
    "op2_html_text": html_text.op2_html_text,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_quality": quality.op4_quality,
    "op5_lm_score": interpolation.op5_lm_score,
    "op6_licenses": licenses.op6_licenses,
    "op7_warc": warc.op7_warc,
    "op8_mixing": mixing.op8_mixing,
    "op9_near_dedup": near_dedup.op9_near_dedup,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLES = {"op3_exact_dedup": exact_dedup.SQL, "op8_mixing": mixing.SQL}
