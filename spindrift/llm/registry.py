"""The queries of this subpackage, by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline

from . import decontaminate, fingerprints, lm_score, near_dedup, packing, quality, secrets, substring_dedup, suffix_dedup, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": fingerprints.query,
        "op2_quality": quality.query,
        "op3_url_filter": url_filter.query,
        "op4_lm_score": lm_score.query,
        "op5_near_dedup": near_dedup.query,
        "op6_secrets": secrets.query,
        "op7_decontaminate": decontaminate.query,
        "op8_packing": packing.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_suffix_dedup": suffix_dedup.query,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    """SQL can't express the others: their hashes, models, tokenisers and samples have no counterpart there, or every byte
    string spelt out is too much. The tests hold those against plain versions."""
    return {"op9_substring_dedup": substring_dedup.SQL}
