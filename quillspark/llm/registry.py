"""Queries of the operators, and SQL where SQL can express them."""

from __future__ import annotations

from quillspark.llm import align, ann, chat, decontaminate, html_text, mixing, negatives, quality, simhash, substring_dedup, token_output, toxicity, url_filter


def queries() -> dict:
    return {
        "op1_ann": ann.op1_ann,
        "op2_url_filter": url_filter.op2_url_filter,
        "op3_quality": quality.op3_quality,
        "op4_chat_format": chat.op4_chat_format,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_substring_dedup": substring_dedup.op6_substring_dedup,
        "op7_mixing": mixing.op7_mixing,
        "op8_decontamination": decontaminate.op8_decontamination,
        "op9_simhash": simhash.op9_simhash,
        "op10_token_output": token_output.op10_token_output,
        "op11_alignment": align.op11_alignment,
        "op12_hard_negatives": negatives.op12_hard_negatives,
        "op13_html": html_text.op13_html,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_ann": ann.ORACLE, "op4_chat_format": chat.ORACLE, "op6_substring_dedup": substring_dedup.ORACLE, "op7_mixing": mixing.ORACLE, "op12_hard_negatives": negatives.ORACLE}
