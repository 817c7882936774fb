"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, chat, html_extract, minhash_dedup, mixing, pu_classifier, quality_rules, spotsigs, training_order, warc

QUERIES = {
    "op1_warc": warc.op1_warc,
    "op2_quality_classifier": pu_classifier.op2_quality_classifier,
    "op3_quality_rules": quality_rules.op3_quality_rules,
    "op4_mixing": mixing.op4_mixing,
    "op5_minhash": minhash_dedup.op5_minhash,
    "op6_training_order": training_order.op6_training_order,
    "op7_spotsigs": spotsigs.op7_spotsigs,
    "op8_html": html_extract.op8_html,
    "op9_chat": chat.op9_chat,
    "op10_bpe": bpe.op10_bpe,
}

ORACLES = {
    "op1_warc": warc.ORACLE,
    "op3_quality_rules": quality_rules.ORACLE,
    "op5_minhash": minhash_dedup.ORACLE,
    "op9_chat": chat.ORACLE,
}
