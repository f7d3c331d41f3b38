"""What the operators of this subpackage share: the shared folder, written tables, and vectorised views of text."""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.storage import drop_folder, filesystem, fresh_path, local_path, shared_dir, written  # noqa: F401

#: Text bytes that one vectorised step works on; a longer document is a step of its own.
STEP_BYTES = 1 << 19
#: Bytes of an Arrow batch between the JVM and Python, which hold several at once; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20
#: Rows of at most this many bytes in all may be broadcast; beyond it joins shuffle.
BROADCAST_BYTES = 32 << 20
#: What a row takes in a broadcast hash table beside its values.
ROW_BYTES = 32


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """df with a broadcast hint if its counted rows, of so many bytes and what a hash table adds, are few enough; df must be cheap to
    count, as a written table is."""
    return F.broadcast(df) if df.count() * (row_bytes + ROW_BYTES) <= BROADCAST_BYTES else df


def bound_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches by bytes, unless they are bounded more narrowly: they are counted in rows, and rows of text may be of any length."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key))
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


@functools.cache
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: its memory stays with the worker
        return None


def release() -> None:
    """Gives memory that is free back to the system: Spark uses its Python workers again, and they'd stay as large as they ever were."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None and hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def steps(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches of at most `most` text bytes, or of one row. At the end of each batch memory is released."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < n:
            done = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
            yield batch.slice(at, to - at)
            at = to
        release()


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array of bytes, each followed by a line feed, and where each begins (with the end as last). Null counts as empty."""
    if pa.types.is_dictionary(texts.type):
        texts = texts.cast(texts.type.value_type)
    arr = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), ""), pa.scalar("", pa.large_string()), pa.scalar("\n", pa.large_string()))
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    offsets = np.frombuffer(arr.buffers()[1], np.int64)[arr.offset : arr.offset + len(arr) + 1]
    data = np.frombuffer(arr.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if len(arr) and arr.buffers()[2] else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


_rng = np.random.Generator(np.random.PCG64(20240607))
_odd = lambda n: _rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Random values of bytes, two independent hashes; odd bases with their inverses modulo 2^64.
BYTE_VALUES = np.stack([_odd(256), _odd(256)])
BASES = [int(x) for x in _odd(2) | np.uint64(5)]
INVERSES = [pow(b, -1, 2**64) for b in BASES]
GEAR = _rng.integers(0, 2**32, 256, dtype=np.uint32)
_powers: dict[tuple[int, bool], np.ndarray] = {}


def powers(which: int, inverse: bool, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    have = _powers.get((which, inverse))
    if have is None or len(have) < n:
        x = np.full(max(n, 1 << 16), (INVERSES if inverse else BASES)[which], np.uint64)
        x[0] = 1
        have = np.multiply.accumulate(x)
        if n <= 2 * STEP_BYTES:
            _powers[which, inverse] = have
    return have[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each span [start, end) of values (uint64), the same wherever the span lies."""
    n = len(values)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(which, False, n), out=total[1:])
    return mixed((total[ends] - total[starts]) * powers(which, True, n + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_WORD = np.zeros(256, bool)
_WORD[128:] = True
for _a, _b in ((48, 58), (65, 91), (97, 123)):
    _WORD[_a:_b] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLDED_VALUES = BYTE_VALUES[:, _FOLD]


def spans(inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of True begin and end; the last value must be False."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    return edge[0::2], edge[1::2]


def spaced_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of the words between white space, compared byte by byte."""
    starts, ends = spans(~_SPACE[data])
    return starts, ends, span_hashes(BYTE_VALUES[0][data], starts, ends)


def folded_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and hashes of runs of letters and digits, without case."""
    starts, ends = spans(_WORD[data])
    return starts, ends, span_hashes(_FOLDED_VALUES[0][data], starts, ends)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
