"""Tables of int64 rows on disk, and their sorting, in a bounded part of memory."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator

import numpy as np

#: Rows that a step holds in memory at once.
MEMORY_ROWS = 1 << 17
#: Runs that are merged at once.
FAN = 24


class Scratch:
    """Where the files of one sort lie, and how many rows a step of it may hold."""

    def __init__(self, system, folder: str, most: int = MEMORY_ROWS):
        self.system, self.folder, self.most = system, folder, max(2, most)
        self.written = 0  # bytes, all in all
        self.files: set[str] = set()

    def create(self):
        path = f"{self.folder}/rows-{uuid.uuid4().hex}"
        self.files.add(path)
        return path, self.system.open_output_stream(path)

    def delete(self, path: str) -> None:
        self.system.delete_file(path)
        self.files.discard(path)

    def close(self) -> None:
        for path in list(self.files):
            self.delete(path)


class Rows:
    """Rows that are appended, then read in slices. At most scratch.most of them are in memory while it grows; a table that stays
    below that never sees the disk."""

    def __init__(self, scratch: Scratch, columns: int):
        self.scratch, self.columns, self.n = scratch, columns, 0
        self.tail: list[np.ndarray] = []
        self.held = 0
        self.path = self.out = self.file = None
        self.block: tuple[int, np.ndarray] | None = None

    def add(self, rows: np.ndarray) -> None:
        if not len(rows):
            return
        rows = np.ascontiguousarray(rows, np.int64).reshape(-1, self.columns)
        self.tail.append(rows)
        self.held += len(rows)
        self.n += len(rows)
        if self.held > self.scratch.most // 4:
            self._flush()

    def _flush(self) -> None:
        if self.out is None:
            self.path, self.out = self.scratch.create()
        for rows in self.tail:
            self.out.write(rows.tobytes())
            self.scratch.written += rows.nbytes
        self.tail, self.held = [], 0

    def spill(self) -> Rows:
        """All of it on disk: for tables of which there are many."""
        self._flush()
        return self

    def _open(self) -> None:
        """From here on rows are only read."""
        if self.out is not None and self.file is None:
            self._flush()
            self.out.close()
            self.file = self.scratch.system.open_input_file(self.path)
        elif self.path is None and len(self.tail) != 1:
            self.tail = [np.concatenate(self.tail) if self.tail else np.zeros((0, self.columns), np.int64)]

    def slice(self, a: int, z: int) -> np.ndarray:
        self._open()
        if self.file is None:
            return self.tail[0][a:z]
        self.file.seek(a * 8 * self.columns)
        return np.frombuffer(self.file.read((z - a) * 8 * self.columns), np.int64).reshape(-1, self.columns)

    def chunks(self, size: int | None = None) -> Iterator[np.ndarray]:
        size = size or max(1, self.scratch.most // 8)
        for a in range(0, self.n, size):
            yield self.slice(a, min(a + size, self.n))

    def backward(self, size: int | None = None) -> Iterator[np.ndarray]:
        """Chunks from the end, each in falling order."""
        size = size or max(1, self.scratch.most // 8)
        for z in range(self.n, 0, -size):
            yield self.slice(max(0, z - size), z)[::-1]

    def gather(self, at: np.ndarray) -> np.ndarray:
        """The rows at ascending places; each block is read once."""
        out = np.empty((len(at), self.columns), np.int64)
        size = max(1, self.scratch.most // 8)
        which = at // size
        edge = np.flatnonzero(np.concatenate(([True], which[1:] != which[:-1], [True]))) if len(at) else np.zeros(1, np.int64)
        for a, z in zip(edge[:-1].tolist(), edge[1:].tolist()):
            b = int(which[a])
            if self.block is None or self.block[0] != b:
                self.block = (b, self.slice(b * size, min((b + 1) * size, self.n)))
            out[a:z] = self.block[1][at[a:z] - b * size]
        return out

    def free(self) -> None:
        if self.out is not None and self.file is None:
            self.out.close()
        if self.file is not None:
            self.file.close()
        if self.path is not None:
            self.scratch.delete(self.path)
        self.tail, self.block, self.n, self.path, self.out, self.file = [], None, 0, None, None, None


def of_chunks(scratch: Scratch, chunks: Iterable[np.ndarray], columns: int) -> Rows:
    out = Rows(scratch, columns)
    for c in chunks:
        out.add(c)
    return out


def _order(rows: np.ndarray, keys: int) -> np.ndarray:
    return np.lexsort(rows[:, :keys].T[::-1]) if keys > 1 else np.argsort(rows[:, 0], kind="stable")


def _not_above(rows: np.ndarray, bound: np.ndarray, keys: int) -> int:
    """How many of sorted rows are not above a bound, by their first columns."""
    a, z = 0, len(rows)
    for k in range(keys):  # rows [a, z) agree with the bound so far
        low = a + int(np.searchsorted(rows[a:z, k], bound[k], side="left"))
        high = a + int(np.searchsorted(rows[a:z, k], bound[k], side="right"))
        a, z = low, high
        if low == high:
            return low
    return z


def merged(runs: list[Rows], keys: int, scratch: Scratch) -> Iterator[np.ndarray]:
    """All rows of sorted runs in order; equal ones come by run."""
    size = max(1, scratch.most // (2 * len(runs) + 2))
    at = [0] * len(runs)
    held: list[np.ndarray] = [np.zeros((0, r.columns), np.int64) for r in runs]
    while True:
        for i, r in enumerate(runs):
            if not len(held[i]) and at[i] < r.n:
                held[i] = r.slice(at[i], min(at[i] + size, r.n))
                at[i] += len(held[i])
        open_ = [i for i, r in enumerate(runs) if at[i] < r.n]
        if open_:
            bound = min((tuple(held[i][-1, :keys].tolist()) for i in open_))
            take = [_not_above(h, np.array(bound), keys) for h in held]
        else:
            take = [len(h) for h in held]
        rows = np.concatenate([h[:t] for h, t in zip(held, take)])
        held = [h[t:] for h, t in zip(held, take)]
        if len(rows):
            yield rows[_order(rows, keys)]
        if not open_ and not any(len(h) for h in held):
            return


def ordered(scratch: Scratch, chunks: Iterable[np.ndarray], columns: int, keys: int) -> Iterator[np.ndarray]:
    """Rows in order of their first columns, stably. Sorted runs of scratch.most rows go to disk and are merged."""
    levels: list[list[Rows]] = [[]]  # runs of like size; FAN of them become one of the next level
    held: list[np.ndarray] = []
    size = 0
    limit = max(2, scratch.most // 2)

    def put() -> None:
        rows = np.concatenate(held)
        run = Rows(scratch, columns)
        run.add(rows[_order(rows, keys)])
        run.spill()
        held.clear()
        k = 0
        levels[0].append(run)
        while len(levels[k]) >= FAN:
            run = of_chunks(scratch, merged(levels[k], keys, scratch), columns).spill()
            for r in levels[k]:
                r.free()
            levels[k] = []
            k += 1
            if k == len(levels):
                levels.append([])
            levels[k].append(run)

    for c in chunks:
        while len(c):
            part = c[: limit - size]
            held.append(part)
            size += len(part)
            c = c[len(part) :]
            if size >= limit:
                put()
                size = 0
    runs = [r for level in reversed(levels) for r in level]
    if not runs:
        if held:
            rows = np.concatenate(held)
            rows = rows[_order(rows, keys)]
            step = max(1, scratch.most // 8)
            for a in range(0, len(rows), step):
                yield rows[a : a + step]
        return
    if held:
        put()
        runs = [r for level in reversed(levels) for r in level]
    yield from merged(runs, keys, scratch)
    for r in runs:
        r.free()


def with_last(chunks: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Each chunk with the last row of the one before it."""
    last = None
    for c in chunks:
        if len(c):
            yield c, last
            last = c[-1].copy()


class Along:
    """Of a table in order of its first column the last row that isn't above each of ascending keys."""

    def __init__(self, rows: Rows):
        self.chunks, self.base = rows.chunks(), 0
        self.held = np.zeros((0, rows.columns), np.int64)
        self.ended = False

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the rows, and the rows."""
        while not self.ended and (not len(self.held) or self.held[-1, 0] <= keys[-1]):
            more = next(self.chunks, None)
            if more is None:
                self.ended = True
            else:
                drop = max(0, int(np.searchsorted(self.held[:, 0], keys[0], side="right")) - 1)
                self.held = np.concatenate((self.held[drop:], more))
                self.base += drop
        at = np.searchsorted(self.held[:, 0], keys, side="right") - 1
        return self.base + at, self.held[at]
