"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import ann, byte_bpe, chunk_dedup, media, near_dedup, packing, quality, suffix_dedup, token_counts, url_filter


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_counts": token_counts.query,
        "op2_suffix_dedup": suffix_dedup.query,
        "op3_nearest_neighbours": ann.query,
        "op4_media_columns": media.query,
        "op5_near_dedup": near_dedup.query,
        "op6_byte_bpe": byte_bpe.query,
        "op7_quality_rules": quality.query,
        "op8_url_filter": url_filter.query,
        "op9_packing": packing.query,
        "op10_chunk_dedup": chunk_dedup.query,
    }


def oracle_sql() -> dict[str, str]:
    """Only the URL filter can be said in SQL; the tests hold the others against brute force, round trips or held-out labels."""
    return {"op8_url_filter": url_filter.ORACLE}
