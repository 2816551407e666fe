"""The queries of this subpackage and, where SQL can express one, its SQL."""

from __future__ import annotations

from . import bpe, clustering, exact_dedup, jaccard_join, langid, mixing, near_vectors, pii, pipeline, secrets, sharding, substring_dedup, warc, whitening


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_mix_sources": mixing.op1_mix_sources,
        "op2_pii": pii.op2_pii,
        "op3_secrets": secrets.op3_secrets,
        "op4_merkle_audit": warc.op4_merkle_audit,
        "op5_substring_dedup": substring_dedup.op5_substring_dedup,
        "op6_exact_dedup": exact_dedup.op6_exact_dedup,
        "op7_byte_bpe": bpe.op7_byte_bpe,
        "op8_jaccard_join": jaccard_join.op8_jaccard_join,
        "op9_near_vectors": near_vectors.op9_near_vectors,
        "op10_language_id": langid.op10_language_id,
        "op11_whiten": whitening.op11_whiten,
        "op12_cluster": clustering.op12_cluster,
        "op13_shard": sharding.op13_shard,
    }


def oracle_sql() -> dict[str, str]:
    return {"op4_merkle_audit": warc.ORACLE_SQL, "op6_exact_dedup": exact_dedup.ORACLE_SQL, "op12_cluster": clustering.ORACLE_SQL}
