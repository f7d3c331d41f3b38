"""Operator 10: substring dedup by content-defined chunks.

A gear hash rolls over the bytes of each text; a chunk ends where its low bits are zero, MIN_CHUNK bytes after the last end at
least (MAX_CHUNK at most), so chunks find their old ends again after an insertion. Chunks whose rolling fingerprint (64 bits) occurs
once in the corpus are left alone; the others are compared by their BLAKE2b digest (128 bits) over all documents, and of equal ones the
first in order of doc_id and place stays. Counts and minima are combined before they are shuffled, so a chunk that every document has
isn't one task's work. A run of repeated chunks is cut out of a text if it
holds RUN_BYTES or more: shorter repeats are ordinary phrases.

Defined results. A null text stays null, an empty one empty; a null doc_id comes after all others in the order. Rows that repeat
doc_id and text are one document and have the same result; a doc_id with two texts comes in order of a hash of the text. A
document whose every chunk is a repeat keeps its row, with what is left of the text. Texts of any length are chunked whole. Other
columns pass through; n_chars is counted again where the text changed.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import BYTE_VALUES, GEAR, bound_batches, joined, signed, span_hashes, steps, written
from ._cuts import CUTS, cut, keep_bytes, kept, row_key

MASK_BITS = 4
MIN_CHUNK = 24
#: Bytes that the rolling hash sees.
WINDOW = 32
MAX_CHUNK = 2048
RUN_BYTES = 96


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of GEAR[byte] << age over the last 32 bytes, by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each chunk of joined texts, in bytes of the whole."""
    at = np.flatnonzero(gear(data) >> np.uint32(32 - MASK_BITS) == 0) + 1
    inner = data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80  # never inside a character
    while inner.any():
        at[inner] += 1
        inner = data[np.minimum(at, len(data) - 1)] & 0xC0 == 0x80
    marks = at.tolist()
    ends: list[int] = []
    put = ends.append
    i, n = 0, len(marks)
    for begin, end in zip(offsets[:-1].tolist(), (offsets[1:] - 1).tolist()):
        last = begin
        while i < n and marks[i] < end:
            m = marks[i]
            if m - last >= MIN_CHUNK and m - begin >= WINDOW:  # before that the hash still sees the text before
                while m - last > MAX_CHUNK:
                    last += MAX_CHUNK
                    while data[last] & 0xC0 == 0x80:
                        last += 1
                    put(last)
                last = m
                put(m)
            i += 1
        while end - last > MAX_CHUNK:
            last += MAX_CHUNK
            while data[last] & 0xC0 == 0x80:
                last += 1
            put(last)
        if end > last:
            put(end)
        while i < n and marks[i] <= end + 1:
            i += 1
    stop = np.array(ends, np.int64)
    doc = np.searchsorted(offsets, stop, side="left") - 1
    start = np.concatenate((stop[:1] * 0, stop[:-1]))
    first = np.concatenate((np.ones(len(doc[:1]), bool), doc[1:] != doc[:-1]))
    start[first] = offsets[doc[first]]
    return doc, start, stop


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        data, offsets = joined(b.column("text"))
        _, start, stop = chunks(data, offsets)
        yield pa.RecordBatch.from_arrays([pa.array(signed(span_hashes(BYTE_VALUES[0][data], start, stop)))], ["print"])


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        data, offsets = joined(b.column("text"))
        doc, start, stop = chunks(data, offsets)
        place = (start - offsets[doc]) << 24 | (stop - start)
        raw = memoryview(data.tobytes())
        digest = pa.array([blake2b(raw[x:y], digest_size=16).digest() for x, y in zip(start.tolist(), stop.tolist())], pa.binary())
        take = pa.array(doc)
        yield pa.RecordBatch.from_arrays([b.column("doc_id").take(take), b.column("row").take(take), pa.array(place), pa.array(signed(span_hashes(BYTE_VALUES[0][data], start, stop))), digest], ["doc_id", "row", "place", "print", "digest"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows, ids, keeps, n_cut = [], [], [], []
        for row, doc_id, places in zip(*(b.column(c).to_pylist() for c in ("row", "doc_id", "places"))):
            runs: list[list[int]] = []
            for p in sorted(set(places)):
                a, z = p >> 24, (p >> 24) + (p & 0xFFFFFF)
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
            runs = [r for r in runs if r[1] - r[0] >= RUN_BYTES]
            if runs:
                rows.append(row)
                ids.append(doc_id)
                keeps.append(kept(runs))
                n_cut.append(sum(z - a for a, z in runs))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), pa.array(keeps, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))), pa.array(n_cut, pa.int64())], ["row", "doc_id", "keep", "n_cut"])


def repeats(docs: DataFrame) -> DataFrame:
    """What to keep of each text that has repeated runs (CUTS)."""
    bound_batches(docs.sparkSession)
    have = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs["doc_id"], docs["text"]).alias("row"))
    prints = written(have.select("text").mapInArrow(_fingerprints, "print bigint").groupBy("print").agg(F.count("*").alias("n")).where("n > 1").select(F.col("print").alias("_print")), "fingerprints")
    found = have.mapInArrow(_chunk, "doc_id bigint, row bigint, place bigint, print bigint, digest binary")
    found = written(found.join(prints, F.col("print") == F.col("_print"), "left_semi").drop("print"), "chunks")
    first = found.groupBy(F.col("digest").alias("_digest")).agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "row", "place")).alias("first"), F.count("*").alias("n"))
    first = written(first.where("n > 1").select("_digest", F.col("first.row").alias("_row"), F.col("first.doc_id").alias("_id"), F.col("first.place").alias("_place")), "first-chunks")
    later = found.join(first, F.col("digest") == F.col("_digest")).where("NOT (row = _row AND place = _place AND doc_id <=> _id)").select("row", "doc_id", "place")
    return later.groupBy("row", "doc_id").agg(F.collect_list("place").alias("places")).mapInArrow(_runs, CUTS)


def dedup(docs: DataFrame) -> DataFrame:
    return cut(docs, written(repeats(docs), "chunk-cuts"), "keep", keep_bytes)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without what an earlier one has already."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
