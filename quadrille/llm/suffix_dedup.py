"""Operator 2: dedup of repeated passages by suffix arrays built with external induced sorting.

A passage is a window of WORDS white-space separated words. To find those that occur twice anywhere in the corpus, windows are dealt
to shards by content: each window has an anchor, the least hash of GRAM consecutive words in it, and equal windows have equal
anchors. Windows in a row that share an anchor form a segment; segments whose anchor occurs once in the corpus hold no repeat, all
others are shuffled to the shard of their anchor. A shard is one string: its distinct segments, each as the hashes of its GRAMs of words,
so that equal windows are equal substrings of WIDE symbols. Its suffix and common-prefix arrays come from induced sorting with
disk-backed priority queues (_suffix_array), and runs of common prefixes of WIDE or more are all windows that are equal. Of equal
windows the first in order of doc_id and place stays; the words of the others are cut out of their texts. No window is left out,
whatever its count.

A shard may be far larger than memory: strings, orders, prefixes and the lists of who holds what are files in the shared folder, read
and written in sequence, and a task holds MEMORY_ROWS rows of a step at a time.

GRAMs of words are compared by 32 bits of their hashes in a shard, WIDE of them in a row, after 64-bit hashes of anchors have agreed.

Defined results. A null text stays null; texts with fewer than WORDS words, empty ones among them, stay as they are. A null doc_id
comes after all others in the order. Rows that repeat doc_id and text are one document and have the same result; a doc_id with two
texts comes in order of a hash of the text. A document all of whose passages are repeats keeps its row, with what is left of the
text. Texts of any length are read whole. Other columns pass through; n_chars is counted again where the text changed.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._base import BASES, bound_batches, drop_folder, filesystem, fresh_path, joined, mixed, release, signed, small, spaced_words, steps, written
from ._cuts import cut, row_key
from ._external import MEMORY_ROWS, Along, Rows, Scratch, ordered, with_last
from ._suffix_array import suffixes

WORDS = 50
GRAM = 16
#: GRAMs of a window.
WIDE = WORDS - GRAM + 1
#: Symbols of a shard's string: 0 ends it, then come the ends of segments, each one different, then GRAMs.
GRAMS = 1 << 32


def segments(words: np.ndarray, word_doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of each segment, as numbers of words of joined texts; the hash of the GRAM at each word."""
    none = np.zeros(0, np.int64)
    n = len(words)
    if n < WORDS:
        return none, none, none.view(np.uint64), none.view(np.uint64)
    grams = words.copy()
    span = 1
    while span < GRAM:  # GRAM is a power of two
        grams[:-span] = grams[:-span] + grams[span:] * np.uint64(pow(BASES[0], span, 2**64))
        span *= 2
    grams = mixed(grams)
    wide = WIDE
    # the least of each `wide` grams and its place, the last of equals, by doubling
    least, place, span = grams.copy(), np.arange(n), 1
    while span < wide:
        step = min(span, wide - span)
        left, right = least[:-step], least[step:]
        lower = right <= left
        place = np.concatenate((np.where(lower, place[step:], place[:-step]), place[n - step :]))
        least = np.concatenate((np.where(lower, right, left), least[n - step :]))
        span += step
    start = np.flatnonzero(word_doc[WORDS - 1 :] == word_doc[: n - WORDS + 1])
    at = place[start]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)))) if len(start) else none
    if not len(new):
        return none, none, none.view(np.uint64), grams
    last = np.append(new[1:], len(start)) - 1
    return start[new], start[last], grams[at[new]], grams


def _of(b: pa.RecordBatch) -> tuple:
    data, offsets = joined(b.column("text"))
    starts, _, words = spaced_words(data)
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return doc, np.searchsorted(doc, np.arange(b.num_rows)), *segments(words, doc)


def _anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in steps(batches):
        doc, begin, first, _, anchor, _ = _of(b)
        d = doc[first]
        yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), b.column("row").take(pa.array(d)), pa.array((first - begin[d]).astype(np.int32))], ["anchor", "row", "first"])


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The segments that are wanted, with the low halves of their GRAMs' hashes."""
    for b in steps(batches):
        doc, begin, first, last, anchor, grams = _of(b)
        wanted = b.column("firsts")
        lengths = np.diff(wanted.offsets.to_numpy())
        want = np.repeat(np.arange(b.num_rows), lengths) << 32 | wanted.flatten().to_numpy().astype(np.int64)
        d = doc[first]
        take = np.flatnonzero(np.isin(d << 32 | (first - begin[d]), want))
        first, last, anchor, d = first[take], last[take], anchor[take], d[take]
        low = (grams & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        size = last - first + WIDE
        at = np.zeros(len(size) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        flat = low[np.arange(at[-1]) + np.repeat(first - at[:-1], size)]
        body = pa.BinaryArray.from_buffers(pa.binary(), len(size), [None, pa.py_buffer((at * 4).astype(np.int32).tobytes()), pa.py_buffer(flat.tobytes())])
        rows = pa.array(d)
        yield pa.RecordBatch.from_arrays([pa.array(signed(anchor)), b.column("row").take(rows), b.column("doc_id").take(rows), pa.array((first - begin[d]).astype(np.int32)), body], ["anchor", "row", "doc_id", "first", "grams"])


class Shard:
    """The string of a shard, and who holds its segments. Tables are of int64 rows (_external).

    bodies: (where it begins in the string, its length) of each distinct segment; held: (body, whether doc_id is null, doc_id, row,
    first) of each segment of the corpus, first the word of the document where it begins.
    """

    def __init__(self, scratch: Scratch):
        self.scratch = scratch
        self.text, self.bodies, self.held = Rows(scratch, 1), Rows(scratch, 2), Rows(scratch, 5)
        self.last: tuple[int, bytes] = (0, b"")

    def add(self, b: pa.RecordBatch) -> None:
        """Rows with anchor, h, row, doc_id, first, grams, where equal grams come one after another."""
        key, body = b.column("h").to_numpy(), b.column("grams")
        offsets = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1].astype(np.int64)
        raw = body.buffers()[2]
        data = np.frombuffer(raw, np.uint32)[offsets[0] // 4 : offsets[-1] // 4]
        at = (offsets - offsets[0]) // 4
        bytes_of = lambda i: data[at[i] : at[i + 1]].tobytes()
        new = np.ones(b.num_rows, bool)
        for i in np.flatnonzero(np.concatenate(([key[0] == self.last[0]], key[1:] == key[:-1]))):  # equal hashes: the grams tell
            new[i] = bytes_of(i) != (bytes_of(i - 1) if i else self.last[1])
        self.last = (int(key[-1]), bytes_of(b.num_rows - 1))
        fresh = np.flatnonzero(new)
        number = self.bodies.n - 1 + np.cumsum(new)
        size = np.diff(at)[fresh]
        begin = self.text.n + np.cumsum(size + 1) - size - 1
        whole = np.empty(int((size + 1).sum()), np.int64)
        ends = np.cumsum(size + 1) - 1
        inside = np.ones(len(whole), bool)
        inside[ends] = False
        whole[ends] = GRAMS - 1 - number[fresh]
        shift = np.repeat(at[fresh] - (np.cumsum(size) - size), size)
        whole[inside] = GRAMS + data[np.arange(int(size.sum())) + shift].astype(np.int64)
        self.text.add(whole[:, None])
        self.bodies.add(np.stack((begin, size), 1))
        doc, null = b.column("doc_id").fill_null(0).to_numpy(), b.column("doc_id").is_null().to_numpy(zero_copy_only=False)
        self.held.add(np.stack((number, null, doc, b.column("row").to_numpy(), b.column("first").to_numpy()), 1))

    def _holders(self) -> Rows:
        """(body, order, row, first, doc_id, null): order is the place among all segments by doc_id and place. A repeated row is one."""
        out = Rows(self.scratch, 6)
        n = 0

        def numbered() -> Iterator[np.ndarray]:
            nonlocal n
            by_doc = ordered(self.scratch, (c[:, [1, 2, 3, 4, 0]] for c in self.held.chunks()), 5, 4)
            for c, last in with_last(by_doc):
                before = np.concatenate((c[:1] - 1 if last is None else last[None], c[:-1]))
                c = c[(c[:, :4] != before[:, :4]).any(1)]
                yield np.stack((c[:, 4], n + np.arange(len(c)), c[:, 2], c[:, 3], c[:, 1], c[:, 0]), 1)
                n += len(c)

        for c in ordered(self.scratch, numbered(), 6, 2):
            out.add(c)
        self.held.free()
        return out

    def _windows(self) -> Iterator[np.ndarray]:
        """(position, group, whether it is alone in its group) of all suffixes in order."""
        group = -1
        held = None
        for c in suffixes(self.text, 2 * GRAMS, self.scratch):
            c = c if held is None else np.concatenate((held, c))
            new = c[:, 1] < WIDE
            own = group + np.cumsum(new)  # the last row waits: is it alone?
            if len(c) > 1:
                alone = new[:-1] & new[1:]
                yield np.stack((c[:-1, 0], own[:-1], alone), 1)
            held, group = c[-1:], int(own[-1]) - int(new[-1])
        if held is not None:
            yield np.array([[held[0, 0], group + int(held[0, 1] < WIDE), int(held[0, 1] < WIDE)]])

    def _decided(self, bodies: Rows) -> Iterator[np.ndarray]:
        """(body, offset, row and place of the equal window that stays) of windows that are there more than once, by body."""

        def placed() -> Iterator[np.ndarray]:
            """(group, order of the body's first holder, offset, body, row, first)."""
            along = Along(bodies)
            for c in ordered(self.scratch, self._windows(), 3, 1):
                number, body = along.find(c[:, 0])
                offset = c[:, 0] - body[:, 0]
                ok = (offset <= body[:, 1] - WIDE) & ((c[:, 2] == 0) | (body[:, 5] > 1))
                yield np.stack((c[:, 1], body[:, 2], offset, number, body[:, 3], body[:, 4]), 1)[ok]

        def led() -> Iterator[np.ndarray]:
            lead = None  # group, row and place of the leader
            for c in ordered(self.scratch, placed(), 6, 3):
                head = np.concatenate(([lead is None or lead[0] != c[0, 0]], c[1:, 0] != c[:-1, 0]))
                at = np.maximum.accumulate(np.where(head, np.arange(len(c)), -1))
                row, place = c[at, 4], c[at, 5] + c[at, 2]
                if lead is not None:
                    row, place = np.where(at < 0, lead[1], row), np.where(at < 0, lead[2], place)
                lead = (c[-1, 0], row[-1], place[-1])
                yield np.stack((c[:, 3], c[:, 2], row, place), 1)

        return ordered(self.scratch, led(), 4, 2)

    def cuts(self) -> Iterator[pa.RecordBatch]:
        """row, doc_id and span of all words to cut: of equal windows all but the first."""
        if not self.bodies.n:
            return
        self.text.add(np.zeros((1, 1), np.int64))
        holders = self._holders()
        # (begin, length, order, row, first of the first holder, and 1 or, if it has more, another number) of each body
        bodies = Rows(self.scratch, 6)
        numbers = self.bodies.chunks()
        left = np.zeros((0, 2), np.int64)
        held = np.zeros((0, 6), np.int64)

        def first_of(rows: np.ndarray) -> None:
            """rows: holders of whole bodies."""
            nonlocal left
            head = np.flatnonzero(np.concatenate(([True], rows[1:, 0] != rows[:-1, 0])))
            while len(left) < len(head):
                left = np.concatenate((left, next(numbers)))
            count = np.diff(np.append(head, len(rows)))
            bodies.add(np.concatenate((left[: len(head)], rows[head][:, [1, 2, 3]], count[:, None]), 1))
            left = left[len(head) :]

        for c in holders.chunks():
            rows = np.concatenate((held, c))
            cut = int(np.searchsorted(rows[:, 0], rows[-1, 0]))
            if cut:
                first_of(rows[:cut])
            held = rows[cut : cut + 2]  # of the last body, which may go on: the first, and whether there is another
        if len(held):
            first_of(held)
        self.bodies.free()
        rest = iter(holders.chunks())
        spare = np.zeros((0, 6), np.int64)
        wait = np.zeros((0, 4), np.int64)

        def spans(windows: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Of whole bodies."""
            nonlocal spare
            while True:
                if not len(spare):
                    spare = next(rest, None)
                    if spare is None:
                        spare = np.zeros((0, 6), np.int64)
                        return
                z = int(np.searchsorted(spare[:, 0], windows[-1, 0], side="right"))
                now, spare = spare[:z], spare[z:]
                a, b = (np.searchsorted(windows[:, 0], now[:, 0], side=side) for side in ("left", "right"))
                now, a, b = now[b > a], a[b > a], b[b > a]
                total = np.cumsum(b - a)
                at = 0
                while at < len(now):
                    to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + self.scratch.most // 4)))
                    yield from self._spans(windows, now[at:to], a[at:to], b[at:to])
                    at = to
                if len(spare):
                    return

        for c in self._decided(bodies):
            windows = np.concatenate((wait, c))
            cut = int(np.searchsorted(windows[:, 0], windows[-1, 0]))
            if cut:
                yield from spans(windows[:cut])
            wait = windows[cut:]
        if len(wait):
            yield from spans(wait)
        holders.free()
        bodies.free()

    def _spans(self, windows: np.ndarray, holders: np.ndarray, a: np.ndarray, b: np.ndarray) -> Iterator[pa.RecordBatch]:
        n = b - a
        s = np.repeat(np.arange(len(holders)), n)
        w = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(len(s))
        start, row = holders[s, 3] + windows[w, 1], holders[s, 2]
        stays, stays_at = windows[w, 2], windows[w, 3]
        end = start + WORDS
        # a passage that overlaps the one that stays loses only what is after it
        begin = np.where((stays == row) & (stays_at <= start), np.maximum(start, stays_at + WORDS), start)
        go = ~((stays == row) & (stays_at == start)) & (begin < end)
        s, begin, end = _merged(s[go], begin[go], end[go])
        if len(s):
            yield pa.RecordBatch.from_arrays([pa.array(holders[s, 2]), pa.array(holders[s, 4], mask=holders[s, 5] == 1), pa.array(begin << 32 | end)], ["row", "doc_id", "span"])


def _merged(s: np.ndarray, a: np.ndarray, z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each segment, ascending, as few as they can be."""
    if not len(s):
        return s, a, z
    o = np.lexsort((z, a, s))
    s, a, z = s[o], a[o], z[o]
    lift = s * (z.max() + 1)
    reach = np.maximum.accumulate(z + lift)
    new = np.concatenate(([True], (s[1:] != s[:-1]) | (a[1:] + lift[1:] > reach[:-1])))
    first = np.flatnonzero(new)
    return s[first], a[first], (reach - lift)[np.append(first[1:], len(s)) - 1]


def _shard(folder: str, most: int):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor and hash."""
        system, path = filesystem(folder)
        own = f"{path}/{uuid.uuid4().hex}"
        system.create_dir(own, recursive=True)
        scratch = Scratch(system, own, most)
        try:
            all_ = Shard(scratch)
            for b in batches:
                for at in range(0, b.num_rows, 2000):
                    all_.add(b.slice(at, 2000))
            yield from all_.cuts()
        finally:
            system.delete_dir(own)
            release()

    return shard


def _compact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans of each row, ascending and as few as they can be."""
    for b in batches:
        spans = b.column("spans")
        p = spans.flatten().to_numpy()
        s = np.repeat(np.arange(b.num_rows), np.diff(spans.offsets.to_numpy()))
        s, a, z = _merged(s, p >> 32, p & 0xFFFFFFFF)
        at = np.searchsorted(s, np.arange(b.num_rows + 1)).astype(np.int32)
        yield pa.RecordBatch.from_arrays([b.column("row"), b.column("doc_id"), pa.ListArray.from_arrays(pa.array(at), pa.array(a << 32 | z))], ["row", "doc_id", "spans"])


@F.arrow_udf(T.StringType())
def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """Texts without these spans of words; a cut goes from a word's start to the start of the next word that stays."""
    out: list[str | None] = []
    for b in steps(iter([pa.RecordBatch.from_arrays([texts, spans], ["text", "spans"])])):
        some = b.filter(b.column("text").is_valid())
        data, offsets = joined(some.column("text"))
        starts, _, _ = spaced_words(data)
        begin = np.searchsorted(starts, offsets)
        raw = data.tobytes()
        done = []
        for i, own in enumerate(some.column("spans").to_pylist()):
            at, end = starts[begin[i] : begin[i + 1]], int(offsets[i + 1]) - 1
            last, parts = int(offsets[i]), []
            for p in sorted(own):
                a, z = p >> 32, p & 0xFFFFFFFF
                x, y = int(at[a]), int(at[z]) if z < len(at) else end
                if x > last:
                    parts.append(raw[last:x])
                last = max(last, y)
            parts.append(raw[last:end])
            done.append(b"".join(parts).decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode())
        new = iter(done)
        out += [next(new) if ok else None for ok in b.column("text").is_valid().to_pylist()]
    return pa.array(out, pa.string())


def repeats(docs: DataFrame, most: int = MEMORY_ROWS) -> tuple[DataFrame, str]:
    """(row, doc_id, spans) of texts with repeated passages, spans of words to cut as from << 32 | to; and the folder of the shards' files."""
    spark = docs.sparkSession
    bound_batches(spark)
    folder = fresh_path(spark, "queues")
    have = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), row_key(docs["doc_id"], docs["text"]).alias("row"))
    anchors = written(have.select("text", "row").mapInArrow(_anchors, "anchor bigint, row bigint, first int"), "anchors")
    # counts are combined before they are shuffled
    twice = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select(F.col("anchor").alias("_anchor")), "shared-anchors")
    shared = anchors.join(small(twice, 8), F.col("anchor") == F.col("_anchor"), "left_semi")
    wanted = shared.groupBy("row").agg(F.collect_set("first").alias("firsts")).withColumnRenamed("row", "_row")
    parts = have.join(wanted.hint("shuffle_hash"), F.col("row") == F.col("_row")).select("doc_id", "text", "row", "firsts").mapInArrow(_payloads, "anchor bigint, row bigint, doc_id bigint, first int, grams binary")
    spans = parts.withColumn("h", F.xxhash64("grams")).repartition("anchor").sortWithinPartitions("anchor", "h").mapInArrow(_shard(folder, most), "row bigint, doc_id bigint, span bigint")
    return spans.groupBy("row", "doc_id").agg(F.collect_set("span").alias("spans")).mapInArrow(_compact, "row bigint, doc_id bigint, spans array<bigint>"), folder


def dedup(docs: DataFrame, most: int = MEMORY_ROWS) -> DataFrame:
    spans, folder = repeats(docs, most)
    spans = written(spans, "passages")
    system, path = filesystem(folder)
    if system.get_file_info(path).type.name == "Directory":
        drop_folder(folder)
    return cut(docs, spans, "spans", without)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without passages that an earlier one has already; defined results as above."""
    return dedup(docs)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, without passages that an earlier one has already."""
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
