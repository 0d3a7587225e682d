"""The queries of this subpackage, one for each operator, and their SQL."""

from __future__ import annotations

from . import bpe, chat, licenses, packing, quality, secrets, simhash, spotsigs, substring_dedup, toxicity

QUERIES = {
    "op1_secret_scan": secrets.op1_secret_scan,
    "op10_chat_format": chat.op10_chat_format,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_simhash": simhash.op3_simhash,
    "op4_license_scan": licenses.op4_license_scan,
    "op5_best_fit_packing": packing.op5_best_fit_packing,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_byte_bpe": bpe.op7_byte_bpe,
    "op8_spotsigs": spotsigs.op8_spotsigs,
    "op9_substring_dedup": substring_dedup.op9_substring_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op9_substring_dedup": substring_dedup.OP9_SQL,
    "op10_chat_format": chat.OP10_SQL,
}
