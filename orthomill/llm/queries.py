"""Registered queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from . import hard_negatives, media, mixing, near_dup, ngram_join, packing, pii, quality_model, quality_rules, substring_dedup, suffix_dedup, toxicity, vector_codes

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_near_dup": near_dup.op2_near_dup,
    "op3_packing": packing.op3_packing,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_pii": pii.op5_pii,
    "op6_substring_dedup": substring_dedup.op6_substring_dedup,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_mixing": mixing.op8_mixing,
    "op9_quality_model": quality_model.op9_quality_model,
    "op10_gif": media.op10_gif,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_vector_codes": vector_codes.op13_vector_codes,
    "gif_frames": media.gif_frames,
}

ORACLE_SQL = {
    "op8_mixing": mixing.OP8_SQL,
    "op11_hard_negatives": hard_negatives.OP11_SQL,
    "op12_ngram_join": ngram_join.op12_ngram_join,
    "op13_vector_codes": vector_codes.OP13_SQL,
    "gif_frames": media.GIF_FRAMES_SQL,
}
