"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from . import bpe_codec, chat_format, embedding_dedup, hard_negatives, license_scan, lm_scoring, mixing, packing, quality_rules, simhash_dedup, spelling_variants, suffix_dedup, url_filter

QUERIES = {
    "op1_license_scan": license_scan.op1_license_scan,
    "op2_packing": packing.op2_packing,
    "op3_embedding_dedup": embedding_dedup.op3_embedding_dedup,
    "op4_chat_format": chat_format.op4_chat_format,
    "op5_lm_scoring": lm_scoring.op5_lm_scoring,
    "op6_simhash_dedup": simhash_dedup.op6_simhash_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_url_filter": url_filter.op8_url_filter,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_suffix_dedup": suffix_dedup.op10_suffix_dedup,
    "op11_spelling_variants": spelling_variants.op11_spelling_variants,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_bpe_codec": bpe_codec.op13_bpe_codec,
}
ORACLE_SQL = {
    "op1_license_scan": license_scan.OP1_SQL,
    "op3_embedding_dedup": embedding_dedup.OP3_SQL,
    "op4_chat_format": chat_format.OP4_SQL,
    "op8_url_filter": url_filter.OP8_SQL,
    "op9_quality_rules": quality_rules.OP9_SQL,
    "op11_spelling_variants": spelling_variants.OP11_SQL,
    "op12_hard_negatives": hard_negatives.OP12_SQL,
}
