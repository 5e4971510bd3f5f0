"""Queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from . import ann, class_lm, exact_dedup, line_dedup, mixing, packing, quality, sharding, simhash, store

QUERIES = {
    "op1_anisotropic_ann": ann.query,
    "op2_interleaved_shards": sharding.query,
    "op3_class_lm": class_lm.query,
    "op4_line_dedup": line_dedup.query,
    "op5_simhash_neardup": simhash.query,
    "op6_ss_packing": packing.query,
    "op7_raked_mixture": mixing.query,
    "op8_id_store": store.query,
    "op9_exact_dedup": exact_dedup.query,
    "op10_rule_quality": quality.query,
}

ORACLE_SQL = {"op9_exact_dedup": exact_dedup.ORACLE}
