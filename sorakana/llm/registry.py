"""Queries and SQL of this subpackage, for the entry module."""

from __future__ import annotations

from . import embeddings, language, licenses, mixing, neardup, packing, quality, suffixes, tokens, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_suffix_dedup": suffixes.op2_repeats,
    "op3_quality_rules": quality.op3_quality,
    "op4_embedding_neardup": embeddings.op4_embeddings,
    "op5_minhash_neardup": neardup.op5_near_duplicates,
    "op6_token_files": tokens.op6_token_files,
    "op7_source_mixing": mixing.op7_mixing,
    "op8_license_scan": licenses.op8_licenses,
    "op9_language_id": language.op9_language,
    "op10_best_fit_packing": packing.op10_packing,
}
ORACLES = {"op3_quality_rules": quality.ORACLE, "op4_embedding_neardup": embeddings.ORACLE, "op5_minhash_neardup": neardup.ORACLE, "op7_source_mixing": mixing.ORACLE, "op8_license_scan": licenses.ORACLE}
