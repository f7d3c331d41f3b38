"""Operator 9: best-fit packing by the sum of squares.

Documents are encoded in BPE tokens and cut into pieces of at most CAPACITY tokens (only a longer document is cut). A piece goes
into the open bin, or the new one, after which the sum of N(gap)^2 is smallest, where N(gap) counts the open bins with that
room left: with room g taken, the sum changes by 2 * (N(g - size) - N(g)) + 2, so the choice needs one pass over the gaps.
Pieces are packed within shards of about SHARD_BYTES of text, dealt by a hash of doc_id, so packing is parallel and a shard is
all that a task holds. A bin is one training sequence: its token ids, and of each piece in it the document and where it begins.

Defined results, of the query and the stage. A null or empty text: the row has no tokens to place and is in no bin. A null doc_id: the
row is packed like any other, with a null in doc_ids and a copy number that counts such rows of its shard; pack() alone does so if it
is told to. Very long texts are cut into pieces. Ties: the smallest gap wins; among bins of one gap, the one opened first. Rows that
repeat a doc_id are packed each, as copies (copy = 0, 1, ..., in order of token count). An empty table gives no row. Other columns are
not read, whatever their names.
"""

from __future__ import annotations

from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, release
from ._bpe import VOCABULARY, vocabulary
from .byte_bpe import _encode

CAPACITY = 2048
#: Text that the documents of a shard should have, in bytes.
SHARD_BYTES = 24 << 20
#: Bins that are sent back at once.
BINS = 256

#: A sequence. Piece i of it, number pieces[i] of copy copies[i] of document doc_ids[i], begins at starts[i].
SCHEMA = "shard int, bin int, n_tokens int, doc_ids array<bigint>, copies array<int>, pieces array<int>, starts array<int>, tokens array<int>"


def sum_of_squares(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin of each piece in order, its offset there, and the room left in each bin."""
    counts = np.zeros(capacity + 1, np.int64)  # counts[0] and counts[capacity] stay 0: full and new bins don't count
    bins: dict[int, deque] = defaultdict(deque)
    bin_of, offset, room = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    far = np.int64(1) << 60
    for i, s in enumerate(sizes.tolist()):
        gaps = counts[s:]
        # change / 2, less the 1 that both have; a full bin and a new one leave out one term each, which is half as much
        score = 2 * (counts[: capacity + 1 - s] - gaps) + 2
        score[gaps == 0] = far
        if gaps[0]:
            score[0] = 1 - 2 * counts[s]
        score[capacity - s] = 2 * counts[capacity - s] + 1 if s < capacity else 0
        g = int(score.argmin()) + s
        if g == capacity:
            b = len(room)
            room.append(capacity)
        else:
            b = bins[g].popleft()
            counts[g] -= 1
        bin_of[i], offset[i] = b, capacity - room[b]
        room[b] = left = g - s
        if left:
            bins[left].append(b)
            counts[left] += 1
    return bin_of, offset, np.array(room, np.int64)


def _narrow(path: str):
    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Token ids as bytes, two a token where the vocabulary allows: half of what is shuffled, and nothing to convert."""
        width = 2 if len(vocabulary(path).tokens) <= 1 << 16 else 4
        for b in _encode(path)(batches):
            tokens = b.column("tokens")
            at = tokens.offsets.to_numpy().astype(np.int64)
            raw = tokens.values.to_numpy()[at[0] : at[-1]].astype(f"<u{width}")
            offsets = (at - at[0]) * width
            body = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_tokens"), body], ["doc_id", "n_tokens", "tokens"])

    return narrow


def _pack(capacity: int):
    def pack(shard: int, table: pa.Table) -> Iterator[pa.RecordBatch]:
        table = table.combine_chunks()
        ids, null = table.column("doc_id").fill_null(0).to_numpy(), table.column("doc_id").is_null().to_numpy()
        n = table.column("n_tokens").to_numpy()
        body = table.column("tokens").combine_chunks().cast(pa.large_binary())
        ends = np.frombuffer(body.buffers()[1], np.int64)[body.offset : body.offset + len(body) + 1]
        width = int(ends[-1] - ends[0]) // int(n.sum())
        flat = np.frombuffer(body.buffers()[2], f"<u{width}", int(n.sum()), int(ends[0]))
        begin = np.cumsum(n) - n
        rows = np.lexsort((n, ids, null))
        new = np.concatenate(([True], (ids[rows][1:] != ids[rows][:-1]) | (null[rows][1:] != null[rows][:-1])))
        at = np.arange(len(rows))
        copy = np.empty(len(rows), np.int64)
        copy[rows] = at - np.maximum.accumulate(np.where(new, at, 0))
        pieces = -(-n[rows] // capacity)
        row = np.repeat(rows, pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.minimum(n[row] - piece * capacity, capacity)
        # arrival in a fixed shuffled order: the rule is for items that come at random
        order = np.random.Generator(np.random.PCG64(len(row))).permutation(len(row))
        row, piece, size = row[order], piece[order], size[order]
        b, start, room = sum_of_squares(size, capacity)
        o = np.lexsort((start, b))
        row, piece, size, b, start = row[o], piece[o], size[o], b[o], start[o]
        first = begin[row] + piece * capacity
        whole = np.concatenate([flat[x:y] for x, y in zip(first.tolist(), (first + size).tolist())] or [flat[:0]])
        ends = np.searchsorted(b, np.arange(len(room) + 1))
        cut = np.concatenate(([0], np.cumsum(capacity - room)))
        for k in range(0, len(room), BINS):
            z = min(k + BINS, len(room))
            own = slice(ends[k], ends[z])
            of = lambda values, at: pa.ListArray.from_arrays(pa.array((at - at[0]).astype(np.int32)), values)
            out = [pa.array(np.full(z - k, shard, np.int32)), pa.array(np.arange(k, z, dtype=np.int32)), pa.array((capacity - room[k:z]).astype(np.int32)), of(pa.array(ids[row[own]], mask=null[row[own]]), ends[k : z + 1]), *(of(pa.array(x.astype(np.int32)), ends[k : z + 1]) for x in (copy[row[own]], piece[own], start[own])), of(pa.array(whole[cut[k] : cut[z]].astype(np.int32)), cut[k : z + 1])]
            yield pa.RecordBatch.from_arrays(out, ["shard", "bin", "n_tokens", "doc_ids", "copies", "pieces", "starts", "tokens"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All of a partition: one shard, or several whole ones."""
        parts = [b for b in batches if b.num_rows]
        if parts:
            table = pa.Table.from_batches(parts)
            for shard in sorted(pc.unique(table.column("shard")).to_pylist()):
                yield from pack(shard, table.filter(pc.equal(table.column("shard"), shard)))
        release()

    return packed


def sequences(docs: DataFrame, capacity: int = CAPACITY, shard_bytes: int = SHARD_BYTES, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """One row a bin (SCHEMA): a training sequence of at most `capacity` tokens."""
    bound_batches(docs.sparkSession)
    have = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text <> ''")
    shards = max(1, -(-(have.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
    encoded = have.mapInArrow(_narrow(vocabulary_path), "doc_id bigint, n_tokens bigint, tokens binary")
    # rows without doc_id are dealt by their tokens, so that no shard gets them all
    shard = F.pmod(F.when(F.col("doc_id").isNull(), F.xxhash64("tokens")).otherwise(F.xxhash64("doc_id")), F.lit(shards)).cast("int")
    return encoded.withColumn("shard", shard).repartitionById(shards, "shard").mapInArrow(_pack(capacity), SCHEMA)


def pack(docs: DataFrame, capacity: int = CAPACITY, shard_bytes: int = SHARD_BYTES, unnamed: bool = False) -> DataFrame:
    """One row a piece: where it lies (shard, bin, bin_offset) and what it is (doc_id, copy, piece, piece_start, n_tokens). unnamed: rows without doc_id too."""
    docs = docs if unnamed else docs.where("doc_id IS NOT NULL")
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array("n_tokens"))
    rows = sequences(docs, capacity, shard_bytes).select("shard", "bin", F.explode(F.arrays_zip("doc_ids", "copies", "pieces", "starts", ends.alias("ends"))).alias("p"))
    return rows.select("shard", "bin", F.col("p.starts").alias("bin_offset"), F.col("p.doc_ids").alias("doc_id"), F.col("p.copies").alias("copy"), F.col("p.pieces").alias("piece"), (F.col("p.pieces").cast("bigint") * capacity).alias("piece_start"), (F.col("p.ends") - F.col("p.starts")).alias("n_tokens"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as training sequences; defined results as above."""
    return sequences(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as training sequences."""
    return sequences(spark.read.parquet(f"{sf_dir}/documents.parquet"))
