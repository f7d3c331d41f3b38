"""Operator 5: near duplicates by an inverted join over MinHash signatures.

A document's signature has COORDINATES minima over the hashed shingles of its folded words. Documents whose whole signatures
agree are one entry. Each entry is posted under every (coordinate, value) pair; two entries are a pair if they collide on at
least MATCHES coordinates. Two such entries also collide within the COORDINATES - MATCHES + 1 rarest pairs of either one, so
only that prefix is joined; entries with fewer than MATCHES pairs that anyone shares are skipped, as are, within a list,
entries that are already known to be connected. A pair counts only if the exact Jaccard similarity of its shingle sets is
MATCHES / COORDINATES or more; where a pair fails, the pairs that were skipped in its lists because of it are looked at as well,
so groups are the connected components of all pairs that collide often enough and are as similar as that.

Defined results. A null doc_id or a null text: the row belongs to no group and the stage keeps it. A text without letters or
digits is compared byte by byte (so empty texts are copies of one another). A text with fewer words than a shingle has one
shingle, of all its words. Rows that repeat doc_id and text are one document, of which the stage keeps one row; rows that share
only doc_id are documents of their own, so a doc_id may be in several groups. Ties: the smallest doc_id of a group stays, and of
its texts that of the smallest hash. Other columns pass through unread.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._base import BASES, BYTE_VALUES, bound_batches, folded_words, joined, mixed, small, span_hashes, steps, written
from ._cuts import row_key

COORDINATES = 64
MATCHES = 26
SHINGLE = 3

_rng = np.random.Generator(np.random.PCG64(77))
_A = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, COORDINATES, dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed shingles of joined texts with their documents, in order; the documents that are too short for one, with the one they get."""
    n = len(offsets) - 1
    starts, _, words = folded_words(data)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(doc, minlength=n)
    first = np.cumsum(counts) - counts
    grams = words.copy()
    for j in range(1, shingle):
        grams[:-j] += words[j:] * np.uint64(pow(BASES[1], j, 2**64))
    whole = np.zeros(len(words), bool)
    if len(words) >= shingle:
        whole[: len(words) - shingle + 1] = doc[shingle - 1 :] == doc[: len(doc) - shingle + 1]
    grams, rest, raw = mixed(grams), np.flatnonzero(counts < shingle), np.zeros(0, np.uint64)
    if len(rest):  # too short for a shingle: all its words, or its bytes, are the one shingle
        left, right = offsets[rest], offsets[rest + 1] - 1
        raw = span_hashes(BYTE_VALUES[1][data], left, right)
        some = counts[rest] > 0
        at = first[rest[some]]
        acc = np.zeros(len(at), np.uint64)
        for j in range(shingle - 1):
            has = counts[rest[some]] > j
            acc[has] += words[at[has] + j] * np.uint64(pow(BASES[1], j, 2**64))
        raw[some] = mixed(acc ^ counts[rest[some]].astype(np.uint64))
    keep = np.flatnonzero(whole)
    return grams[keep], doc[keep], rest, raw


def signatures(data: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> np.ndarray:
    """The signature (uint32, one row a document) of joined texts."""
    n = len(offsets) - 1
    grams, doc, rest, raw = shingles(data, offsets, shingle)
    out = np.zeros((n, COORDINATES), np.uint32)
    if len(grams):
        begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        for k in range(COORDINATES):
            out[doc[begin], k] = np.minimum.reduceat(((grams * _A[k] + _B[k]) >> np.uint64(32)).astype(np.uint32), begin)
    if len(rest):
        out[rest] = ((raw[:, None] * _A + _B) >> np.uint64(32)).astype(np.uint32)
    return out


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        s = signatures(*joined(b.column("text")))
        sig = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * COORDINATES), len(s), [None, pa.py_buffer(s.tobytes())]).cast(pa.binary())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), sig], ["doc_id", "row", "sig"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text's shingles, ascending and distinct, as bytes."""
    for b in steps(batches):
        grams, doc, rest, raw = shingles(*joined(b.column("text")))
        grams, doc = np.concatenate([grams, raw]), np.concatenate([doc, rest])
        order = np.lexsort((grams, doc))
        grams, doc = grams[order], doc[order]
        new = np.concatenate(([True], (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])))
        grams, doc = grams[new], doc[new]
        ends = np.searchsorted(doc, np.arange(b.num_rows + 1)) * 8
        sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64).tobytes()), pa.py_buffer(grams.tobytes())])
        yield pa.RecordBatch.from_arrays([b.column("row"), sets.cast(pa.binary())], ["row", "grams"])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets (ascending) are as similar as a pair must be."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both * COORDINATES >= MATCHES * (len(a) + len(b) - both)


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ok = [alike(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)) for x, y in zip(b.column("a"), b.column("b"))]
        yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), pa.array(ok, pa.bool_())], ["u", "v", "ok"])


def _sigs(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        s = _sigs(b.column("sig"))
        keys = s.astype(np.int64) | (np.arange(COORDINATES, dtype=np.int64) << 32)
        rep = np.repeat(b.column("rep").to_numpy(), COORDINATES)
        yield pa.RecordBatch.from_arrays([pa.array(rep), pa.array(keys.ravel())], ["rep", "key"])


def linked(sig: np.ndarray, matches: int = MATCHES) -> tuple[np.ndarray, np.ndarray]:
    """Pairs that connect exactly those rows that a chain of pairs with enough matches connects. Rows already reached are skipped."""
    left, right = [], []
    rest = np.arange(len(sig))
    while len(rest) > 1:
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            hit = (sig[rest] == sig[at]).sum(1) >= matches
            if hit.any():
                found = rest[hit]
                left.append(np.full(len(found), at))
                right.append(found)
                queue.extend(found)
                rest = rest[~hit]
    none = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (none, none)


def apart(sig: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with enough matches whose roots differ."""
    left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(sig) - 1):
        other = np.flatnonzero(root[i + 1 :] != root[i]) + i + 1
        found = other[(sig[other] == sig[i]).sum(1) >= MATCHES]
        left.append(np.full(len(found), i))
        right.append(found)
    return np.concatenate(left), np.concatenate(right)


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by key. A list that goes on in the next batch waits for it. Rows with roots: all pairs of unequal ones."""

    def pairs(keys: np.ndarray, reps: np.ndarray, sig: np.ndarray, root: np.ndarray | None = None) -> pa.RecordBatch:
        edge = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1], [True])))
        size = np.diff(edge)
        two = edge[:-1][size == 2]  # most lists, at once
        ok = (sig[two] == sig[two + 1]).sum(1) >= MATCHES if len(two) else np.zeros(0, bool)
        if root is not None:
            ok &= root[two] != root[two + 1]
        a, b = [reps[two[ok]]], [reps[two[ok] + 1]]
        for i in np.flatnonzero(size > 2):
            one = slice(edge[i], edge[i + 1])
            x, y = linked(sig[one]) if root is None else apart(sig[one], root[one])
            a.append(reps[edge[i] + x])
            b.append(reps[edge[i] + y])
        a, b = np.concatenate(a), np.concatenate(b)
        both = np.unique(np.stack([np.maximum(a, b), np.minimum(a, b)]), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["u", "v"])

    held: list[tuple] = []
    for b in batches:
        if not b.num_rows:
            continue
        now = (b.column("key").to_numpy(), b.column("rep").to_numpy(), _sigs(b.column("sig")), *(b.column(c).to_numpy() for c in b.schema.names if c == "root"))
        last = np.searchsorted(now[0], now[0][-1])
        if last == 0 and held and held[-1][0][-1] == now[0][0]:
            held.append(now)
            continue
        done = [*held, tuple(x[:last] for x in now)]
        yield pairs(*(np.concatenate(x) for x in zip(*done)))
        held = [tuple(x[last:] for x in now)]
    if held:
        yield pairs(*(np.concatenate(x) for x in zip(*held)))


def components(edges: DataFrame) -> DataFrame:
    """(u, root) for every vertex but the roots, root the smallest vertex reachable. edges: (u, v) with u > v.

    Large and small stars in turn until nothing moves: rounds grow with the logarithm of a component's size.
    """
    by_u = Window.partitionBy("u")
    before = None
    while True:
        both = edges.union(edges.select("v", "u")).toDF("u", "v")
        large = both.withColumn("m", F.least(F.min("v").over(by_u), "u")).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.withColumn("m", F.min("v").over(by_u))
        edges = written(least.select("u", F.col("m").alias("v")).union(least.where("v > m").select("v", "m")).distinct(), "stars")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.toDF("u", "root")
        before = state


def checked(edges: DataFrame, have: DataFrame) -> DataFrame:
    """edges (u, v: rows of have) with ok: whether their texts are alike."""
    ends = edges.select("u").union(edges.select("v")).distinct().toDF("_end")
    texts = have.join(small(written(ends, "ends"), 8), F.col("row") == F.col("_end"), "left_semi").dropDuplicates(["row"])
    sets = written(texts.select("row", "text").mapInArrow(_sets, "row bigint, grams binary"), "shingles")
    left, right = sets.toDF("u", "a"), sets.toDF("v", "b")
    return written(edges.join(left, "u").join(right, "v").select("u", "v", "a", "b").mapInArrow(_alike, "u bigint, v bigint, ok boolean"), "checked")


def _groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc_id, row, root, keep) of every document of a group of two or more, keep the doc_id and row that stays, and doc_id of repeated rows."""
    bound_batches(docs.sparkSession)
    have = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    have = have.withColumn("row", row_key(F.col("doc_id"), F.col("text")))
    signed = written(have.mapInArrow(_sign, "doc_id bigint, row bigint, sig binary"), "signatures")
    # counts and minima are combined before they are shuffled, so a text that all documents share is no one's burden
    entries = written(signed.groupBy("sig").agg(F.min(F.struct("doc_id", "row"))["row"].alias("rep"), F.count("*").alias("n")), "entries")
    many = entries.where("n > 1").select(F.col("sig").alias("_sig"), "rep")
    member = signed.join(small(many, 4 * COORDINATES + 16), F.col("sig") == F.col("_sig"), "left").select("doc_id", "row", F.coalesce("rep", "row").alias("rep"))
    entries = entries.select("rep", "sig")
    posts = entries.mapInArrow(_post, "rep bigint, key bigint")
    counts = written(posts.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "postings")
    shared = posts.join(small(counts.withColumnRenamed("key", "_key"), 16), F.col("key") == F.col("_key")).select("rep", "key", "n")
    prefix = shared.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "key"))).alias("keys")).where(F.size("keys") >= MATCHES).select("rep", F.expr(f"slice(keys.key, 1, size(keys) - {MATCHES - 1})").alias("keys"))
    prefix = written(prefix, "prefixes")

    def pairs(rows: DataFrame) -> DataFrame:
        return written(rows.repartition("key").sortWithinPartitions("key", "rep").mapInArrow(_lists, "u bigint, v bigint").where("u > v").distinct(), "edges")

    found = checked(pairs(prefix.join(entries, "rep").select("rep", F.explode("keys").alias("key"), "sig")), have)
    roots = components(found.where("ok").select("u", "v"))
    failed = found.where("NOT ok")
    if failed.head(1):  # the lists of such a pair again: pairs that were skipped as connected by it
        u, v = prefix.toDF("u", "_u"), prefix.toDF("v", "_v")
        lists = written(failed.join(u, "u").join(v, "v").select(F.explode(F.array_intersect("_u", "_v")).alias("key")).distinct(), "lists")
        rows = prefix.select("rep", F.explode("keys").alias("key")).join(small(lists, 8), "key", "left_semi").join(entries, "rep").join(roots.withColumnRenamed("u", "rep"), "rep", "left")
        more = pairs(rows.select("rep", "key", "sig", F.coalesce("root", "rep").alias("root"))).join(failed.select("u", "v"), ["u", "v"], "left_anti")
        more = checked(written(more, "more"), have).where("ok").select("u", "v")
        if more.head(1):
            roots = components(roots.toDF("u", "v").union(more).distinct())
    rooted = member.select("doc_id", "row", "rep").distinct().join(roots, F.col("rep") == F.col("u"), "left").select("doc_id", "row", F.coalesce("root", "rep").alias("root"))
    rooted = written(rooted, "rooted")
    keep = rooted.groupBy(F.col("root").alias("_root")).agg(F.min(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("_n")).where("_n > 1").drop("_n")
    grouped = rooted.join(small(written(keep, "kept"), 24), F.col("root") == F.col("_root")).select("doc_id", "row", "root", "keep")
    again = signed.groupBy("doc_id").count().where("count > 1").select("doc_id")
    return grouped, again


def near_groups(docs: DataFrame) -> DataFrame:
    """One row a group of two or more: keep_doc_id, doc_ids (ascending, with the kept one), n_docs."""
    grouped, _ = _groups(docs)
    return grouped.groupBy("root").agg(F.min("doc_id").alias("keep_doc_id"), F.sort_array(F.collect_set("doc_id")).alias("doc_ids")).where(F.size("doc_ids") > 1).select("keep_doc_id", "doc_ids", F.size("doc_ids").cast("bigint").alias("n_docs"))


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document of each group."""
    grouped, again = _groups(docs)
    gone = small(written(grouped.where("row <> keep.row").select(F.col("row").alias("_gone_row")), "gone"), 16)
    again = written(again.select(F.col("doc_id").alias("_again_id")), "again")
    row = F.when(docs["doc_id"].isNotNull() & docs["text"].isNotNull(), row_key(docs["doc_id"], docs["text"]))
    left = docs.join(gone, row == gone["_gone_row"], "left_anti")
    if not again.head(1):
        return left
    twice = small(again, 16)
    whole = left.join(twice, left["doc_id"] == twice["_again_id"], "left_anti")
    return whole.unionByName(left.join(twice, left["doc_id"] == twice["_again_id"], "left_semi").dropDuplicates(["doc_id", "text"]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
