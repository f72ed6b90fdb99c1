"""The queries of this subpackage and of the pipeline, and their oracle SQL."""

from __future__ import annotations

import corpus_pipeline
from folioworks.llm import conversations, decontamination, fingerprints, licenses, line_dedup, near_dedup, oracles, packing, pii, sharding, spelling, substring_dedup, tiers, toxicity

_QUERIES = {
    "op1_substring_dedup": substring_dedup.query,
    "op2_fingerprints": fingerprints.query,
    "op3_near_dedup": near_dedup.query,
    "op4_line_dedup": line_dedup.query,
    "op5_license_scan": licenses.query,
    "op6_sharding": sharding.query,
    "op7_pii": pii.query,
    "op8_toxicity": toxicity.query,
    "op9_packing": packing.query,
    "op10_decontamination": decontamination.query,
    "op11_conversation_repair": conversations.query,
    "op12_tiered_packing": tiers.query,
    "op13_spelling_variants": spelling.query,
    "pipeline": corpus_pipeline.run,
}
_ORACLES = {
    "op1_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op3_near_dedup": oracles.NEAR_DEDUP,
    "op13_spelling_variants": oracles.SPELLING,
}


def queries():
    return dict(_QUERIES)


def oracle_sql():
    return dict(_ORACLES)
