"""Byte-level BPE over numpy arrays: pre-tokens, the whole-token proof, and merges of many pieces in lock-step."""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata

import numpy as np

from ._base import BYTE_VALUES, mixed, span_hashes

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
NONE = np.int32(2**31 - 1)
LONG = 32
L, N, O, S, END = range(5)


@functools.cache
def char_classes() -> np.ndarray:
    """The class of each code point: letter, number, other, white space."""
    table = np.full(sys.maxunicode + 1, O, np.uint8)
    for c in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(c))[0]
        if kind in "LN":
            table[c] = L if kind == "L" else N
    table[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = S
    return table


def code_points(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 bytes and where each begins, with the end as last; a byte that is no UTF-8 stands for itself."""
    points = np.frombuffer(data.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32)
    size = 1 + (points > 0x7F) + (points > 0x7FF).astype(np.int64) + (points > 0xFFFF)
    size[(points >= 0xDC80) & (points <= 0xDCFF)] = 1
    at = np.zeros(len(points) + 1, np.int64)
    np.cumsum(size, out=at[1:])
    return points, at


def pretokens(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of the pre-tokens of texts that lie one after another, each followed by one byte at `ends` that isn't its own."""
    points, at = code_points(data)
    cls = char_classes()[points]
    end = np.searchsorted(at, ends)
    cls[end] = END
    n = len(points)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.ones(n + 4, bool)
    np.not_equal(cls[1:], cls[:-1], out=start[1:n])
    start[end] = True
    # of white space before something else the last one stands alone, or, as a blank, belongs to what follows
    last = np.flatnonzero((cls[:-1] == S) & (cls[1:] < S))
    start[last] = True
    start[last[points[last] == 32] + 1] = False
    quote = np.flatnonzero(points == 39)
    quote = quote[start[quote] & (cls[quote] == O)]
    if len(quote):
        x, y = points[np.minimum(quote + 1, n - 1)], points[np.minimum(quote + 2, n - 1)]
        one = quote[np.isin(x, [115, 116, 109, 100])]
        two = quote[((y == 101) & ((x == 114) | (x == 118))) | ((x == 108) & (y == 108))]
        start[one + 1], start[one + 2] = False, True
        start[two + 1], start[two + 3] = False, True
    first = np.flatnonzero(start[:n])
    stop = np.append(first[1:], n)
    own = cls[first] != END
    return at[first[own]], at[stop[own]]


class Table:
    """Open addressing from 64-bit keys (0 is none) to int32, with room for so many keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, room: int = 0):
        self.mask = np.uint64((1 << max(4, (max(len(keys), room) * 4).bit_length())) - 1)
        self.keys, self.values = np.zeros(int(self.mask) + 1, np.uint64), np.full(int(self.mask) + 1, NONE, np.int32)
        self.add(keys, values)

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Keys that aren't there yet."""
        left = np.arange(len(keys))
        slot = keys & self.mask
        while len(left):
            free = self.keys[slot[left]] == 0
            self.keys[slot[left[free]]] = keys[left[free]]
            won = self.keys[slot[left]] == keys[left]
            self.values[slot[left[won]]] = values[left[won]]
            left = left[~won]
            slot[left] = (slot[left] + np.uint64(1)) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = keys & self.mask
        found = self.keys[slot]
        out = np.where(found == keys, self.values[slot], NONE)
        left = np.flatnonzero((found != keys) & (found != 0))
        while len(left):
            slot[left] = (slot[left] + np.uint64(1)) & self.mask
            found = self.keys[slot[left]]
            hit = found == keys[left]
            out[left[hit]] = self.values[slot[left[hit]]]
            left = left[~hit & (found != 0)]
        return out


class Pieces:
    """Token ids of pieces that were merged before, up to ROOM of them: most come again."""

    ROOM = 1 << 17

    def __init__(self):
        none = np.zeros(0, np.int32)
        self.table, self.n, self.used = Table(np.zeros(0, np.uint64), none, self.ROOM), 0, 0
        self.starts, self.counts, self.ids = np.zeros(self.ROOM, np.int64), np.zeros(self.ROOM, np.int64), np.zeros(4 * self.ROOM, np.int32)

    def add(self, keys: np.ndarray, ids: np.ndarray, offsets: np.ndarray) -> None:
        k = min(len(keys), self.ROOM - self.n)
        k = min(k, int(np.searchsorted(offsets, len(self.ids) - self.used, side="right")) - 1)
        if k <= 0:
            return
        self.table.add(keys[:k], np.arange(self.n, self.n + k, dtype=np.int32))
        self.starts[self.n : self.n + k] = self.used + offsets[:k]
        self.counts[self.n : self.n + k] = np.diff(offsets[: k + 1])
        self.ids[self.used : self.used + offsets[k]] = ids[: offsets[k]]
        self.n, self.used = self.n + k, self.used + int(offsets[k])


def taken(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Stretches of an array, one after another."""
    at = np.cumsum(counts) - counts
    return flat[np.arange(int(counts.sum())) + np.repeat(starts - at, counts)]


def _pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mixed((a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1))


class Vocabulary:
    """Merge ranks of a vocabulary file, which are the ids too."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(t): int(r) for t, r in (x.split() for x in lines if x.strip())}
        self.tokens = [b""] * (1 + max(self.ranks.values()))
        for t, r in self.ranks.items():
            self.tokens[r] = t
        self.of_byte = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        self.sizes = np.array([len(t) for t in self.tokens], np.int64)
        self.data = np.frombuffer(b"".join(self.tokens), np.uint8)
        self.starts = np.cumsum(self.sizes) - self.sizes
        a, b, c = zip(*((self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks))
        a, b, c = (np.array(x, np.int32) for x in (a, b, c))
        self.merges = Table(_pair_keys(a, b), c)
        self.byte_pairs = self.merge(np.repeat(self.of_byte, 256), np.tile(self.of_byte, 256)).reshape(256, 256)
        # the proof: of all strings of the vocabulary, those whose merges end in one token
        ids, offsets = self.merged(self.data, self.starts, self.starts + self.sizes)
        self.alone = np.flatnonzero((np.diff(offsets) == 1) & (self.sizes > 0))
        assert (ids[offsets[self.alone]] == self.alone).all()
        self.pieces = Pieces()
        self.whole = Table(self.hashes(self.data, self.starts[self.alone], (self.starts + self.sizes)[self.alone]), self.alone.astype(np.int32))

    @staticmethod
    def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """63-bit hashes by which strings are compared; of long ones by BLAKE2b, as polynomials collide on some texts made for it."""
        keys = span_hashes(BYTE_VALUES[1][data], starts, ends) | np.uint64(1)
        for i in np.flatnonzero(ends - starts > LONG):
            keys[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little") | 1
        return keys

    def merge(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.merges.get(_pair_keys(a, b))

    def merged(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of each span by merges alone (ids, offsets)."""
        sizes = ends - starts
        counts = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in ((0, 1), (1, 4), (4, 6), (6, 8), (8, 11), (11, 16), (16, LONG)):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                parts += self._lock_step(data, starts[rows], sizes[rows], high, rows, counts)
        out_at = {}
        for i in np.flatnonzero(sizes > LONG):
            ids = self.long_piece(data[starts[i] : ends[i]].tobytes())
            counts[i] = len(ids)
            out_at[i] = ids
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(counts, out=offsets[1:])
        out = np.empty(offsets[-1], np.int32)
        for rows, matrix, n in parts:
            inside = np.arange(matrix.shape[1]) < n[:, None]
            out[(offsets[rows][:, None] + np.arange(matrix.shape[1]))[inside]] = matrix[inside]
        for i, ids in out_at.items():
            out[offsets[i] : offsets[i + 1]] = ids
        return out, offsets

    def _lock_step(self, data, starts, sizes, width, rows, counts):
        cols = np.arange(width)
        raw = data[np.minimum(starts[:, None] + cols, len(data) - 1)]
        tok = self.of_byte[raw]
        rank = np.full((len(rows), width), NONE, np.int32)  # of a column with the next
        if width > 1:
            rank[:, :-1] = self.byte_pairs[raw[:, :-1], raw[:, 1:]]
        rank[cols >= sizes[:, None] - 1] = NONE
        n, parts = sizes.copy(), []
        while True:
            at = rank.argmin(1)
            line = np.arange(len(at))
            best = rank[line, at]
            done = best == NONE
            if done.any():
                counts[rows[done]] = n[done]
                parts.append((rows[done], tok[done], n[done]))
                go = ~done
                rows, tok, rank, n, at, best = rows[go], tok[go], rank[go], n[go], at[go], best[go]
                line = np.arange(len(at))
            if not len(rows):
                return parts
            source = np.minimum(cols + (cols > at[:, None]), width - 1)
            tok = np.take_along_axis(tok, source, 1)
            rank = np.take_along_axis(rank, source, 1)
            tok[line, at] = best
            n -= 1
            has = at > 0
            rank[line[has], at[has] - 1] = self.merge(tok[line[has], at[has] - 1], best[has])
            has = at < n - 1
            rank[line[has], at[has]] = self.merge(best[has], tok[line[has], at[has] + 1])
            rank[line[~has], at[~has]] = NONE
            rank[line, np.minimum(n, width) - 1] = NONE

    def long_piece(self, piece: bytes) -> list[int]:
        """Merges of one piece by a heap: n log n."""
        ranks, n = self.ranks, len(piece)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        end = list(range(1, n + 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        gone = bytearray(n + 1)
        while heap:
            _, i, to = heapq.heappop(heap)
            j = after[i] if not gone[i] else n
            if gone[i] or j >= n or end[j] != to:
                continue
            gone[j] = 1
            end[i] = to
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(piece[i : end[k]])) is not None:
                    heapq.heappush(heap, (r, i, end[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:to])) is not None:
                heapq.heappush(heap, (r, h, to))
        return [ranks[piece[i : end[i]]] for i in range(n) if not gone[i]]

    def encode(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pre-tokens: the id of those that are one token (else NONE), and for the rest the distinct piece each one is, as
        (id or NONE, piece or -1, (ids, offsets) of the pieces)."""
        keys = self.hashes(data, starts, ends)
        one = self.whole.get(keys)
        rest = np.flatnonzero(one == NONE)
        own, first, which = np.unique(keys[rest], return_index=True, return_inverse=True)
        piece = np.full(len(starts), -1, np.int64)
        piece[rest] = which
        known = self.pieces.table.get(own)
        old, new = np.flatnonzero(known != NONE), np.flatnonzero(known == NONE)
        ids, offsets = self.merged(data, starts[rest[first[new]]], ends[rest[first[new]]])
        counts, begin = np.zeros(len(own), np.int64), np.zeros(len(own), np.int64)
        counts[old], begin[old] = self.pieces.counts[known[old]], self.pieces.starts[known[old]] + len(ids)
        counts[new], begin[new] = np.diff(offsets), offsets[:-1]
        out = taken(np.concatenate((ids, self.pieces.ids[: self.pieces.used])), begin, counts)
        self.pieces.add(own[new], ids, offsets)
        at = np.zeros(len(own) + 1, np.int64)
        np.cumsum(counts, out=at[1:])
        return one, piece, (out, at)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each row of ids, and their offsets."""
        size = self.sizes[ids]
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(size, out=at[1:])
        source = np.arange(at[-1]) + np.repeat(self.starts[ids] - at[:-1], size)
        return self.data[source], at[offsets]


@functools.cache
def vocabulary(path: str = VOCABULARY) -> Vocabulary:
    return Vocabulary(path)
