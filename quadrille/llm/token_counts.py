"""Operator 1: token counts with a whole-token shortcut.

Offline, the merges are run over every string of the vocabulary; those that end in a single token are proved to encode alone. A
pre-token that is such a string counts one, straight from a hash table; only the other pre-tokens are merged, each distinct one
once a step. Nothing is shuffled.

Defined results. A null text counts null in every column; an empty one counts 0. Texts of any length are counted whole. Each row
gives one row, repeated rows repeated ones, with doc_id as it is, null or not. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, joined, steps
from ._bpe import NONE, VOCABULARY, pretokens, vocabulary


def _count(path: str):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in steps(batches):
            data, offsets = joined(b.column("text"))
            starts, ends = pretokens(data, offsets[1:] - 1)
            one, piece, (_, at) = v.encode(data, starts, ends)
            tokens = np.ones(len(starts), np.int64)
            rest = piece >= 0
            tokens[rest] = np.diff(at)[piece[rest]]
            doc = np.searchsorted(offsets, starts, side="right") - 1
            n = b.num_rows
            null = b.column("text").is_null().to_numpy(zero_copy_only=False)
            of = lambda w: pa.array(np.bincount(doc, w, n).astype(np.int64), mask=null)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), of(tokens), of(None), of((one != NONE).astype(np.int64))], ["doc_id", "n_tokens", "n_pretokens", "n_whole"])

    return count


def token_counts(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_tokens, n_pretokens, and n_whole: the pre-tokens that the shortcut took."""
    bound_batches(docs.sparkSession)
    have = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return have.mapInArrow(_count(vocabulary_path), "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_whole bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
