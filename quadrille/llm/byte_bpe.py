"""Operator 6: byte-level BPE encoding and decoding as a monoid tree reduction.

A text is halved until its parts are LEAF bytes at most; the leaves are encoded as if each stood alone. Neighbours are joined up the
tree: from the last pre-token of the left part that the cut can't have changed, a window of the two is encoded again. It grows until
one of its pre-tokens, ended before the window does, ends where one of the right part ends; pre-tokens have no memory, so from there
on the right part stands, and so does the left before the window. All joins of one level are encoded together. Decoding maps tokens
to their bytes at the leaves and concatenates up the tree.

Defined results. A null text gives null tokens and text, an empty one no tokens and ''. No text is cut, however long. Each row
gives one row, repeated rows repeated ones, with doc_id as it is, null or not. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import bound_batches, joined, steps
from ._bpe import NONE, VOCABULARY, Vocabulary, pretokens, vocabulary

LEAF = 8192
WINDOW = 64

#: An encoded part: its bytes, token ids, where its pre-tokens begin, and the first token of each.
Part = tuple[bytes, np.ndarray, np.ndarray, np.ndarray]


def encode_flat(v: Vocabulary, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts each followed by one byte that isn't theirs, every one encoded alone: ids, starts of pre-tokens, first token of each (and the end)."""
    starts, stops = pretokens(data, ends)
    one, piece, (ids, at) = v.encode(data, starts, stops)
    rest = np.flatnonzero(piece >= 0)
    count = np.ones(len(starts), np.int64)
    count[rest] = np.diff(at)[piece[rest]]
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(count, out=first[1:])
    out = np.repeat(one, count)
    if len(rest):
        n = count[rest]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(first[rest], n) + within] = ids[np.repeat(at[piece[rest]], n) + within]
    return out, starts, first


def encode_each(v: Vocabulary, texts: list[bytes]) -> list[Part]:
    data = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    ids, starts, first = encode_flat(v, data, ends)
    begin = np.concatenate(([0], ends[:-1] + 1))
    at = np.append(np.searchsorted(starts, begin), len(starts))
    return [(t, ids[first[a] : first[b]], starts[a:b] - o, first[a:b] - first[a]) for t, o, a, b in zip(texts, begin, at[:-1], at[1:])]


def _char_cut(text: bytes, at: int) -> int:
    """The first place from `at` on where a UTF-8 character begins."""
    while at < len(text) and text[at] & 0xC0 == 0x80:
        at += 1
    return at


def join_level(v: Vocabulary, pairs: list[tuple[Part, Part]]) -> list[Part]:
    """Each pair of neighbours as one part."""
    out: list[Part | None] = [None] * len(pairs)
    todo = []
    for i, (a, b) in enumerate(pairs):
        if not a[0] or not b[0]:
            out[i] = b if not a[0] else a
            continue
        # a pre-token is settled if it ends before the cut and the three bytes at its start are there
        c = min(len(a[2]) - 1, int(np.searchsorted(a[2], len(a[0]) - 2)))
        todo.append((i, c, WINDOW))
    while todo:
        windows = [(pairs[i][0][0][pairs[i][0][2][c] :], _char_cut(pairs[i][1][0], w)) for i, c, w in todo]
        again = []
        for (i, c, w), (tail, cut), win in zip(todo, windows, encode_each(v, [tail + pairs[i][1][0][:cut] for (i, _, _), (tail, cut) in zip(todo, windows)])):
            a, b = pairs[i]
            m = j = None
            if cut < len(b[0]):
                inside = np.flatnonzero((win[2][1:] >= len(tail)) & (win[2][:-1] + 3 <= len(win[0]))) + 1
                at = win[2][inside] - len(tail)
                k = np.searchsorted(b[2], at)
                same = np.flatnonzero(b[2][np.minimum(k, len(b[2]) - 1)] == at)
                if not len(same):
                    again.append((i, c, 2 * w))
                    continue
                m, j = int(inside[same[0]]), int(k[same[0]])
            else:
                m, j = len(win[2]), len(b[2])
            ids = [a[1][: a[3][c]], win[1][: win[3][m] if m < len(win[3]) else None], b[1][b[3][j] :] if j < len(b[3]) else b[1][:0]]
            n = len(ids[0]) + len(ids[1])
            starts = np.concatenate((a[2][:c], win[2][:m] + a[2][c], b[2][j:] + len(a[0])))
            first = np.concatenate((a[3][:c], win[3][:m] + len(ids[0]), b[3][j:] - (b[3][j] if j < len(b[3]) else 0) + n))
            out[i] = (a[0] + b[0], np.concatenate(ids), starts, first)
        todo = again
    return out


def encode_trees(v: Vocabulary, texts: list[bytes], leaf: int = LEAF) -> list[np.ndarray]:
    """Token ids of each text; all trees rise together."""
    leaves: list[bytes] = []

    def halve(text: bytes) -> int | tuple:
        cut = _char_cut(text, len(text) // 2)
        if len(text) <= leaf or cut == len(text):
            leaves.append(text)
            return len(leaves) - 1
        return halve(text[:cut]), halve(text[cut:])

    trees = [halve(t) for t in texts]
    parts = encode_each(v, leaves)
    while any(isinstance(t, tuple) for t in trees):
        pairs: list[tuple[Part, Part]] = []

        def ready(t):
            """The tree with each pair of leaves as a leaf to be."""
            if isinstance(t, int):
                return t
            if isinstance(t[0], int) and isinstance(t[1], int):
                pairs.append((parts[t[0]], parts[t[1]]))
                return len(parts) + len(pairs) - 1
            return ready(t[0]), ready(t[1])

        trees = [ready(t) for t in trees]
        parts += join_level(v, pairs)
    return [parts[t][1] for t in trees]


def decode_tree(v: Vocabulary, ids: np.ndarray, leaf: int = LEAF) -> bytes:
    if len(ids) <= leaf:
        return v.decode(ids, np.array([0, len(ids)]))[0].tobytes()
    return decode_tree(v, ids[: len(ids) // 2], leaf) + decode_tree(v, ids[len(ids) // 2 :], leaf)


def _encode(path: str):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for b in steps(batches):
            null = b.column("text").is_null().to_numpy(zero_copy_only=False)
            data, offsets = joined(b.column("text"))
            size = np.diff(offsets) - 1
            tall = np.flatnonzero(size > LEAF)
            trees = dict(zip(tall.tolist(), encode_trees(v, [data[offsets[i] : offsets[i + 1] - 1].tobytes() for i in tall]))) if len(tall) else {}
            # texts of one leaf are encoded where they lie
            flat = np.flatnonzero(size <= LEAF)
            low = data if len(flat) == len(size) else data[np.repeat(size <= LEAF, size + 1)]
            ends = np.cumsum(size[flat] + 1) - 1
            ids, starts, first = encode_flat(v, low, ends)
            at = first[np.searchsorted(starts, ends)]
            count = np.zeros(len(size), np.int64)
            count[flat] = np.diff(np.concatenate(([0], at)))
            for i, t in trees.items():
                count[i] = len(t)
            row = np.zeros(len(size) + 1, np.int64)
            np.cumsum(count, out=row[1:])
            if trees:
                cut = np.concatenate(([0], at))
                where = dict(zip(flat.tolist(), range(len(flat))))
                ids = np.concatenate([trees[i] if i in trees else ids[cut[where[i]] : cut[where[i] + 1]] for i in range(len(size))] or [ids])
            tokens = pa.ListArray.from_arrays(pa.array(row.astype(np.int32), mask=np.append(null, False)), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), tokens, pa.array(count, mask=null)], ["doc_id", "tokens", "n_tokens"])

    return encode


def _decode(path: str):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                b = batch.slice(k, 500)
                tokens = b.column("tokens")
                flat, lengths = tokens.flatten().to_numpy().astype(np.int64), np.diff(tokens.offsets.to_numpy())
                lengths = np.where(tokens.is_null().to_numpy(zero_copy_only=False), 0, lengths)
                ends = np.cumsum(lengths)
                if (lengths > LEAF).any():
                    parts = [decode_tree(v, flat[e - n : e]) for e, n in zip(ends, lengths)]
                    data, offsets = b"".join(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
                else:
                    data, offsets = v.decode(flat, np.concatenate(([0], ends)))
                texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(np.asarray(offsets, np.int64).tobytes()), pa.py_buffer(bytes(data))])
                texts = pa.array([None if n else t for t, n in zip(texts.to_pylist(), tokens.is_null().to_pylist())], pa.binary()) if tokens.null_count else texts.cast(pa.binary())
                rest = [b.column(c) for c in b.schema.names]
                yield pa.RecordBatch.from_arrays([*rest, texts], [*b.schema.names, "bytes"])

    return decode


def encode(docs: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, n_tokens."""
    bound_batches(docs.sparkSession)
    have = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return have.mapInArrow(_encode(vocabulary_path), "doc_id bigint, tokens array<int>, n_tokens bigint")


def decode(encoded: DataFrame, vocabulary_path: str = VOCABULARY) -> DataFrame:
    """doc_id, tokens, n_tokens and the text that the tokens spell."""
    have = encoded.select("doc_id", "tokens", "n_tokens")
    return have.mapInArrow(_decode(vocabulary_path), "doc_id bigint, tokens array<int>, n_tokens bigint, bytes binary").select("doc_id", "tokens", "n_tokens", F.col("bytes").cast("string").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its tokens."""
    return decode(encode(spark.read.parquet(f"{sf_dir}/documents.parquet")))
