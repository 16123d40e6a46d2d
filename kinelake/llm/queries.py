"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontaminate, exact_dedup, hard_negatives, langid, mixing, near_dedup, prefix_trie, quality, quality_rules, secrets, sharding, substring_dedup, toxicity

QUERIES = {
    "op1_decontamination": decontaminate.op1_decontamination,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_mixing": mixing.op3_mixing,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_quality": quality.op6_quality,
    "op7_sharding": sharding.op7_sharding,
    "op8_exact_dedup": exact_dedup.op8_exact_dedup,
    "op9_language_id": langid.op9_language_id,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_prefix_trie": prefix_trie.op11_prefix_trie,
    "op12_quality_rules": quality_rules.op12_quality_rules,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
    "exact_dedup_batches": exact_dedup.exact_dedup_batches,
}
ORACLES = {
    "op3_mixing": mixing.ORACLE, "op7_sharding": sharding.ORACLE, "op8_exact_dedup": exact_dedup.ORACLE, "op11_prefix_trie": prefix_trie.ORACLE,
    "op12_quality_rules": quality_rules.ORACLE, "op13_hard_negatives": hard_negatives.ORACLE, "exact_dedup_batches": exact_dedup.BATCHES_ORACLE,
}
