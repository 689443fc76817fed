"""The operators' queries by name, and DuckDB SQL where it can express one."""

from __future__ import annotations

from tessera.llm import encoding, fingerprints, id_files, jaccard_join, language_id, mixing, ngram_lm, packing, quality, secrets, sharding  # noqa: F401

QUERIES = {
    "op1_mcd_quality": quality.op1,
    "op2_kneser_ney": ngram_lm.op2,
    "op3_jaccard_join": jaccard_join.op3,
    "op4_secret_scan": secrets.op4,
    "op5_shortest_pack_first": packing.op5,
    "op6_language_mixture": language_id.op6,
    "op7_entropy_balance": mixing.op7,
    "op8_elias_fano_ids": id_files.op8,
    "op9_multiset_hash": fingerprints.op9,
    "op10_extendible_shards": sharding.op10,
}
SQL = {
    "op3_jaccard_join": jaccard_join.sql(),
    "op7_entropy_balance": mixing.sql(),
    "op10_extendible_shards": sharding.sql(),
}
