"""Queries and SQL of this subpackage, for the registry at the repository top."""

from __future__ import annotations

from foliant.llm import byte_bpe, chat_format, exact_dedup, hnsw, jaccard, license_scan, mixing, quality, ring_sharding, wavelet


def queries() -> dict:
    return {
        "op1_exact_dedup": exact_dedup.op1_exact_dedup,
        "op2_chat_format": chat_format.op2_chat_format,
        "op3_quality_classifier": quality.op3_quality_classifier,
        "op4_jaccard_join": jaccard.op4_jaccard_join,
        "op5_ring_sharding": ring_sharding.op5_ring_sharding,
        "op6_wavelet_shards": wavelet.op6_wavelet_shards,
        "op7_byte_bpe": byte_bpe.op7_byte_bpe,
        "op8_license_scan": license_scan.op8_license_scan,
        "op9_mixing": mixing.op9_mixing,
        "op10_hnsw_near_dedup": hnsw.op10_hnsw_near_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": exact_dedup.ORACLE, "op2_chat_format": chat_format.ORACLE}
