"""From documents to packed training sequences: each stage works on all that the one before it kept.

Defined results of run(). A null text is rejected by the classifier; an empty one may pass, counts as a copy of other empty ones, and has no
tokens to pack. A null doc_id is no copy of anything, comes after all others where repeats are cut, and is packed with a null in doc_ids.
Very long texts are scored, compared and cut whole, and packed in pieces. Of copies and repeated rows the one with the smallest doc_id stays;
of repeated passages the first in order of doc_id. Without labels of both kinds nothing but null texts is rejected. An empty table gives no
row. Columns other than doc_id, text and n_chars pass through until the last stage, whatever their names; that one returns sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import near_dedup, packing, quality, suffix_dedup
from quadrille.llm._base import written

STAGES = [
    ("quality classifier", quality.accept),
    ("MinHash near-dedup", near_dedup.keep_one),
    ("suffix-array dedup", suffix_dedup.stage),
    ("best-fit packing", packing.stage),
]

#: The classifier, the signatures and the packing can't be said in SQL; the tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
