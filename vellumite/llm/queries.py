"""The queries of this subpackage by name, and their SQL where SQL can say the same."""

from __future__ import annotations

from vellumite.llm import bottom_k, byte_bpe, divergence, exact_dedup, gated_lm, language_id, packing, periodic_runs, quality_rules, sharding, simhash, suffix_dedup, toxicity

QUERIES = {
    "op1_gated_lm": gated_lm.op1_gated_lm,
    "op2_packing": packing.op2_packing,
    "op3_exact_dedup": exact_dedup.op3_exact_dedup,
    "op4_language_id": language_id.op4_language_id,
    "op5_sharding": sharding.op5_sharding,
    "op6_quality_rules": quality_rules.op6_quality_rules,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_simhash": simhash.op8_simhash,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_periodic_runs": periodic_runs.op11_periodic_runs,
    "op12_fingerprints": bottom_k.op12_fingerprints,
    "op13_divergence": divergence.op13_divergence,
}

ORACLES = {
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op6_quality_rules": quality_rules.ORACLE,
    "op11_periodic_runs": periodic_runs.ORACLE,
    "op12_fingerprints": bottom_k.ORACLE,
    "op13_divergence": divergence.ORACLE,
}
