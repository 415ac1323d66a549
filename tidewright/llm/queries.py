"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import audit, bpe, codes, fingerprint, html, idfiles, minhash, mixing, private, quality, rules, substrings, toxicity


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extraction": html.op1,
        "op2_personal_data": private.op2,
        "op3_quality_classifier": quality.op3,
        "op4_toxicity": toxicity.op4,
        "op5_minhash_near_dedup": minhash.op5,
        "op6_quality_rules": rules.op6,
        "op7_fingerprints": fingerprint.op7,
        "op8_substring_dedup": substrings.op8,
        "op9_source_mixing": mixing.op9,
        "op10_bpe": bpe.op10,
        "op11_vector_codes": codes.op11,
        "op12_filter_audit": audit.op12,
        "op13_token_files": idfiles.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_minhash_near_dedup": minhash.SQL, "op6_quality_rules": rules.SQL, "op8_substring_dedup": substrings.SQL, "op9_source_mixing": mixing.SQL, "op11_vector_codes": codes.SQL, "op12_filter_audit": audit.SQL}
