"""Queries of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

from gleaner.llm import bpe, flac, licenses, minhash, packing, quality, secrets, suffixes, vectors, warc


def queries() -> dict:
    found = (vectors.op1_vector_near_dedup, suffixes.op2_suffix_dedup, quality.op3_quality, warc.op4_warc_derivatives, bpe.op5_bpe_round_trip, flac.op6_flac_media, minhash.op7_minhash_near_dedup, packing.op8_packing, licenses.op9_license_scan, secrets.op10_secret_scan)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op1_vector_near_dedup": vectors.SQL}
