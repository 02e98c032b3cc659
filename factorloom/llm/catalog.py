"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from factorloom.llm import archive, chat, decontam, fingerprint, jaccard, lmscore, packing, sitetree, templates, toxicity


def queries() -> dict:
    return {
        "op1_chat_format": chat.op1_query,
        "op2_pack": packing.op2_query,
        "op3_jaccard_join": jaccard.op3_query,
        "op4_warc": archive.op4_query,
        "op5_decontaminate": decontam.op5_query,
        "op6_line_dedup": templates.op6_query,
        "op7_html_text": sitetree.op7_query,
        "op8_lm_score": lmscore.op8_query,
        "op9_toxicity": toxicity.op9_query,
        "op10_fingerprint": fingerprint.op10_query,
    }


def oracles() -> dict[str, str]:
    return {"op1_chat_format": chat.ORACLE, "op4_warc": archive.ORACLE}
