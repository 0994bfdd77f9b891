"""Registered queries of the training-data operators and their DuckDB SQL."""

from __future__ import annotations

from codescope.llm import (chat, fingerprints, jaccard_join, langid, licenses, merkle, mixing, near_vectors, packing, quality,
                           suffix_dedup, toxicity, whitening)

QUERIES = {
    "op1_chat_formatting": chat.op1_chat_formatting,
    "op2_license_scan": licenses.op2_license_scan,
    "op3_mixing": mixing.op3_mixing,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_quality_rules": quality.op6_quality_rules,
    "op7_ngram_jaccard_join": jaccard_join.op7_ngram_jaccard_join,
    "op8_best_fit_packing": packing.op8_best_fit_packing,
    "op9_language_id": langid.op9_language_id,
    "op10_fingerprints": fingerprints.op10_fingerprints,
    "op11_embedding_near_dedup": near_vectors.op11_embedding_near_dedup,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat.op1_sql(),
        "op2_license_scan": licenses.op2_sql(),
        "op3_mixing": mixing.op3_sql(),
        "op6_quality_rules": quality.op6_sql(),
        "op7_ngram_jaccard_join": jaccard_join.op7_sql(),
        "op10_fingerprints": fingerprints.op10_sql(),
        "op11_embedding_near_dedup": near_vectors.op11_sql(),
        "op12_merkle_manifest": merkle.op12_sql(),
    }
