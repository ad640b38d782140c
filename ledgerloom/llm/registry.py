"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat, exactdedup, infill, jaccard, langid, merkle, mixing, neardup, oracles, packing, quality, topk, toxicity, urlrules


def queries() -> dict:
    return {
        "op1_language": langid.op1_language,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_topk": topk.op3_topk,
        "op4_chat": chat.op4_chat,
        "op5_neardup": neardup.op5_neardup,
        "op6_packing": packing.op6_packing,
        "op7_urlrules": urlrules.op7_urlrules,
        "op8_jaccard": jaccard.op8_jaccard,
        "op9_mixing": mixing.op9_mixing,
        "op10_quality": quality.op10_quality,
        "op11_exactdedup": exactdedup.op11_exactdedup,
        "op12_infill": infill.op12_infill,
        "op13_merkle": merkle.op13_merkle,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLE)
