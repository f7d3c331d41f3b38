"""Operator 4: media columns over content-addressed payloads in tar shards.

Each distinct payload is stored once, as a member named by its SHA-256 digest, in a tar shard in the shared folder; a row carries
digest, shard, offset and length. Text-like payloads are deflated (codec), others are stored as they are. Metadata columns are
filled by range reads of READ_BYTES at a payload's offset and, where a header goes on, behind it: the segments of a JPEG are followed by
their lengths, HTML is inflated until its head ends. What isn't header is not read again. A task writes its shard
under a name of its own and moves it into place; a task run again writes the same members, so no shard is ever half written.

Defined results. A null payload: all columns but the id are null. An empty payload is stored, with size 0 and kind 'empty'. Equal
payloads share one member, which the row with the smallest id stores; repeated rows give repeated rows (where they repeat the id too,
each task may store the payload; all rows then name one place). A payload whose header isn't known has kind 'unknown' and null
metadata. Payloads of any length are stored whole. Other columns are not read.
"""

from __future__ import annotations

import re
import struct
import tarfile
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import filesystem, fresh_path, small, written

#: Bytes of payload that a shard should hold.
SHARD_BYTES = 64 << 20
#: Bytes of one range read of a header; a longer header takes several.
READ_BYTES = 1024
META = "kind string, width int, height int, charset string, language string, title string"
PLACE = "digest string, shard string, offset bigint, length bigint, codec string, size bigint"


class Payload:
    """The first bytes of a stored payload, read as far as they are asked for."""

    def __init__(self, stream, offset: int, length: int, codec: str):
        self.stream, self.offset, self.length = stream, offset, length
        self.inflate = zlib.decompressobj() if codec == "deflate" else None
        self.done, self.known = 0, bytearray()  # stored bytes that were inflated, and what came of them

    def range(self, a: int, n: int) -> bytes:
        """Bytes [a, a + n) of the payload, or as many as there are."""
        if self.inflate is None:
            self.stream.seek(self.offset + a)
            return self.stream.read(max(0, min(n, self.length - a)))
        while len(self.known) < a + n and self.done < self.length:
            self.stream.seek(self.offset + self.done)
            raw = self.stream.read(min(READ_BYTES, self.length - self.done))
            self.known += self.inflate.decompress(raw)
            self.done += len(raw)
        return bytes(self.known[a : a + n])


def _html(p: Payload, size: int) -> tuple:
    n = 4 * READ_BYTES
    while True:  # until the head has ended
        raw = p.range(0, n)
        end = re.search(rb"</head\s*>|<body[\s>]", raw, re.I)
        if end or len(raw) < n or n >= size:
            break
        n *= 2
    text = raw[: end.start() if end else len(raw)].decode("utf-8", "replace")
    find = lambda p: (m := re.search(p, text, re.I | re.S)) and m[1].strip()
    return ("html", None, None, find(r"<meta[^>]*charset=[\"']?([\w-]+)"), find(r"<html[^>]*\blang=[\"']?([\w-]+)"), find(r"<title[^>]*>(.*?)</title>"))


def _jpeg(p: Payload) -> tuple:
    at = 2
    while len(raw := p.range(at, 9)) == 9 and raw[0] == 0xFF:
        if raw[1] == 0xFF:  # fill
            at += 1
            continue
        if 0xC0 <= raw[1] <= 0xCF and raw[1] not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack(">HH", raw[5:9])
            return ("jpeg", w, h, None, None, None)
        alone = raw[1] == 0x01 or 0xD0 <= raw[1] <= 0xD8  # markers without a length
        at += 2 if alone else 2 + struct.unpack(">H", raw[2:4])[0]
    return ("jpeg", None, None, None, None, None)


def header(p: Payload, size: int) -> tuple:
    """(kind, width, height, charset, language, title) of a payload of so many bytes."""
    none = (None,) * 5
    if size == 0:
        return ("empty", *none)
    raw = p.range(0, READ_BYTES)
    if raw[:8] == b"\x89PNG\r\n\x1a\n" and len(raw) >= 24:
        return ("png", *struct.unpack(">II", raw[16:24]), None, None, None)
    if raw[:6] in (b"GIF87a", b"GIF89a") and len(raw) >= 10:
        return ("gif", *struct.unpack("<HH", raw[6:10]), None, None, None)
    if raw[:2] == b"BM" and len(raw) >= 26:
        old = struct.unpack("<I", raw[14:18])[0] == 12
        return ("bmp", *(struct.unpack("<HH", raw[18:22]) if old else map(abs, struct.unpack("<ii", raw[18:26]))), None, None, None)
    if raw[:4] == b"RIFF" and len(raw) >= 12:
        if raw[8:12] == b"WEBP" and len(raw) >= 30:
            if raw[12:16] == b"VP8X":
                return ("webp", 1 + int.from_bytes(raw[24:27], "little"), 1 + int.from_bytes(raw[27:30], "little"), None, None, None)
            if raw[12:16] == b"VP8 " and raw[23:26] == b"\x9d\x01\x2a":
                return ("webp", *(x & 0x3FFF for x in struct.unpack("<HH", raw[26:30])), None, None, None)
            if raw[12:16] == b"VP8L" and raw[20] == 0x2F:
                bits = int.from_bytes(raw[21:25], "little")
                return ("webp", 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF), None, None, None)
        return ({b"WEBP": "webp", b"WAVE": "wav"}.get(raw[8:12], "riff"), *none)
    if raw[:3] == b"\xff\xd8\xff":
        return _jpeg(p)
    if raw[:5] == b"%PDF-":
        return ("pdf", *none)
    if re.match(rb"(\xef\xbb\xbf)?\s*(<!--.*?-->\s*)*<(!doctype html|html|head)\b", raw, re.I | re.S):
        return _html(p, size)
    return ("unknown", *none)


def _shard(folder: str):
    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        system.create_dir(path, recursive=True)
        part = f"{path}/part-{uuid.uuid4().hex}"
        scheme = folder[: len(folder) - len(path)] if folder.endswith(path) else ""
        rows: list[tuple] = []
        out = None
        seen: set[str] = set()
        at = 0
        names: list[str] = []

        def close():
            out.write(b"\0" * 1024)
            out.close()
            system.move(names[-1] + ".writing", names[-1])

        for b in batches:
            for digest, payload in zip(b.column("digest").to_pylist(), b.column("payload").to_pylist()):
                if digest in seen:
                    continue
                seen.add(digest)
                if out is None:
                    names.append(f"{part}-{len(names):04d}.tar")
                    out, at = system.open_output_stream(names[-1] + ".writing"), 0
                packed = zlib.compress(payload, 6)
                codec, body = ("deflate", packed) if len(packed) < 0.8 * len(payload) else ("raw", payload)
                info = tarfile.TarInfo(digest)
                info.size = len(body)
                head = info.tobuf(tarfile.USTAR_FORMAT)
                fill = b"\0" * (-len(body) % 512)
                out.write(head + body + fill)
                rows.append((digest, scheme + names[-1], at + len(head), len(body), codec, len(payload)))
                at += len(head) + len(body) + len(fill)
                if at >= SHARD_BYTES:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64()))], ["digest", "shard", "offset", "length", "codec", "size"])

    return shard


def payload_at(shard: str, offset: int, length: int, codec: str) -> bytes:
    """A whole payload, by its row's columns."""
    system, path = filesystem(shard)
    with system.open_input_file(path) as f:
        f.seek(offset)
        raw = f.read(length)
    return zlib.decompress(raw) if codec == "deflate" else raw


def _headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    stream = shard = None
    for b in batches:
        found = []
        for s, o, n, codec, size in zip(*(b.column(c).to_pylist() for c in ("shard", "offset", "length", "codec", "size"))):
            if s != shard:
                if stream is not None:
                    stream.close()
                system, path = filesystem(s)
                stream, shard = system.open_input_file(path), s
            found.append(header(Payload(stream, o, n, codec), size))
        columns = [pa.array([f[i] for f in found], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names), *columns], [*b.schema.names, "kind", "width", "height", "charset", "language", "title"])
    if stream is not None:
        stream.close()


def store(rows: DataFrame, id_column: str, payload_column: str) -> DataFrame:
    """The id, and of its payload digest, shard, offset, length, codec, size and the metadata columns."""
    spark = rows.sparkSession
    folder = fresh_path(spark, "payloads")
    raw = rows.select(F.col(id_column).alias("id"), F.col(payload_column).cast("binary").alias("payload"))
    named = raw.withColumn("digest", F.sha2("payload", 256))
    # payloads stay where they are read: only digests are shuffled, to tell which row of several stores its payload
    again = written(named.where("payload IS NOT NULL").groupBy("digest").agg(F.min("id").alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("digest").alias("_digest"), "_first"), "payload-copies")
    mine = named.where("payload IS NOT NULL").join(small(again, 160), F.col("digest") == F.col("_digest"), "left").where("_digest IS NULL OR id <=> _first")
    index = written(mine.select("digest", "payload").mapInArrow(_shard(folder), PLACE), "payload-index")
    known = written(index.mapInArrow(_headers, f"{PLACE}, {META}"), "payload-headers")
    columns = [c for c in known.columns if c != "digest"]
    one = known.groupBy(F.col("digest").alias("_digest")).agg(F.min(F.struct(*columns)).alias("_place")).select("_digest", *(F.col(f"_place.{c}").alias(c) for c in columns))
    return named.select("id", "digest").join(one, F.col("digest") == F.col("_digest"), "left").drop("_digest").withColumnRenamed("id", id_column)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' html as payloads."""
    return store(spark.read.parquet(f"{sf_dir}/pages.parquet"), "page_id", "html")
