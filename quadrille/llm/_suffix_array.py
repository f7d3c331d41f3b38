"""Suffix and common-prefix arrays of integer strings by external induced sorting with disk-backed priority queues.

A string is sorted by way of its S* suffixes (S-type with an L-type before them): the S* substrings are named in order, the string
of names is sorted by recursion, and two induction passes, L ascending and S descending, spread the order to all suffixes. A pass
takes tuples (symbol, rank of the suffix that follows, position, common prefix with the tuple of this symbol before it) off a
priority queue, one range of symbols after the other, puts them in order, and puts the tuples of the suffixes before them into the
queue. All that a range needs to know of the string (what comes before each position, its type, its run) lies in one stretch of a file
that is sorted by symbol, so nothing is looked up all over the string.

The string, its types, queues, orders and common prefixes are files of the shared folder (_external), read and written in
sequence; in memory are at most Scratch.most rows of a step, the suffixes of one range of symbols (a range is a single symbol where
that one is frequent), and one byte a distinct name. Common-prefix values are capped at CAP.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

from ._external import MEMORY_ROWS, Rows, Scratch, of_chunks, ordered, with_last

CAP = 255
#: Suffixes that a range of symbols should have, and the other symbols that a suffix may go through within its range before the range
#: is halved.
RANGE_TUPLES = 16_384
DEPTH = 32
#: Bits for the length of a run, or for a place in one, beside a symbol or a rank.
SHIFT = 28
FULL = (1 << SHIFT) - 1
#: Runs of a queue that are read one beside another before they are made one.
QUEUE_RUNS = 48


class RangeQueue:
    """A priority queue of rows by ranges of their first column; within one range rows come as they were put in."""

    COLUMNS = 4

    def __init__(self, bounds: np.ndarray, scratch: Scratch):
        self.bounds, self.scratch, self.most = bounds, scratch, max(1, scratch.most // 4)
        self.held: list[list[np.ndarray]] = [[] for _ in bounds]
        self.runs: list[tuple[Rows, np.ndarray]] = []
        self.size = self.spills = 0

    def put(self, rows: np.ndarray) -> None:
        at = np.searchsorted(self.bounds, rows[:, 0], side="right") - 1
        order = np.argsort(at, kind="stable")
        rows, at = rows[order], at[order]
        edge = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1], [True])))
        for a, z in zip(edge[:-1], edge[1:]):
            self.held[at[a]].append(rows[a:z])
        self.size += len(rows)
        if self.size > self.most:
            self.spill()

    def _run(self, parts: Iterable[list[np.ndarray]]) -> None:
        out, ends = Rows(self.scratch, self.COLUMNS), [0]
        for part in parts:
            for x in part:
                out.add(x)
            ends.append(out.n)
        self.runs.append((out.spill(), np.array(ends)))

    def spill(self) -> None:
        held, self.held, self.size = self.held, [[] for _ in self.bounds], 0
        self.spills += 1
        self._run(held)
        if len(self.runs) > QUEUE_RUNS:
            old, self.runs = self.runs, []
            self._run([r.slice(int(at[k]), int(at[k + 1])) for r, at in old if at[k + 1] > at[k]] for k in range(len(self.bounds)))
            for r, _ in old:
                r.free()

    def take(self, k: int) -> np.ndarray:
        parts = [r.slice(int(at[k]), int(at[k + 1])) for r, at in self.runs if at[k + 1] > at[k]] + self.held[k]
        self.size -= sum(len(x) for x in self.held[k])
        self.held[k] = []
        return np.concatenate(parts) if parts else np.zeros((0, self.COLUMNS), np.int64)

    def close(self) -> None:
        for r, _ in self.runs:
            r.free()


class Minima:
    """Minima over ranges of values that are all there."""

    BLOCK = 16

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.values = np.full(n + self.BLOCK, CAP, np.uint8)
        self.values[:n] = values
        level = self.values[: n // self.BLOCK * self.BLOCK].reshape(-1, self.BLOCK).min(1) if n >= self.BLOCK else np.zeros(0, np.uint8)
        self.levels = [level]
        k = 1
        while 1 << k <= len(level):  # of 2^k blocks, by the last one
            last = self.levels[-1]
            new = last.copy()
            new[1 << (k - 1) :] = np.minimum(last[1 << (k - 1) :], last[: len(last) - (1 << (k - 1))])
            self.levels.append(new)
            k += 1

    def least(self, a: np.ndarray, z: np.ndarray) -> np.ndarray:
        """Minima over [a, z), a < z."""
        out = np.full(len(a), CAP, np.uint8)
        b = self.BLOCK
        first, last = -(-a // b), z // b
        for edge, stop in ((a, np.minimum(first * b, z)), (np.maximum(np.maximum(last, first) * b, a), z)):
            at, rows = edge.copy(), np.flatnonzero(edge < stop)
            while len(rows):
                out[rows] = np.minimum(out[rows], self.values[at[rows]])
                at[rows] += 1
                rows = rows[at[rows] < stop[rows]]
        rows = np.flatnonzero(last > first)
        if len(rows):
            f, t = first[rows], last[rows]
            k = np.frexp((t - f).astype(np.float64))[1] - 1
            for j in np.unique(k):
                m = k == j
                level = self.levels[j]
                out[rows[m]] = np.minimum(out[rows[m]], np.minimum(level[t[m] - 1], level[f[m] + (1 << int(j)) - 1]))
        return out


# types and runs
def _marks(text: Rows, scratch: Scratch) -> list[Rows]:
    """Of each position: symbol << 29 | S-type << 28 | run, where the run of an S-type counts down, so that marks compare as suffixes do
    as far as their runs go. A list of tables, from the last part of the string to the first."""
    out = []
    follow = (-1, 0, 0)  # symbol, type and run of what comes after
    for chunk in text.backward():
        t = chunk[::-1, 0]
        edge = np.flatnonzero(np.append(t[1:] != t[:-1], True)) + 1  # where the runs end
        run_end = edge[np.searchsorted(edge, np.arange(len(t)), side="right")]
        run = run_end - np.arange(len(t))
        after = np.append(t, follow[0])[run_end]
        small = t < after
        tail = run_end == len(t)
        if follow[0] < 0:
            small[-1] = True  # the last suffix
        elif t[-1] == follow[0]:
            run[tail] += follow[2]
            small[tail] = bool(follow[1])
        run = np.minimum(run, FULL)
        part = Rows(scratch, 1)
        part.add((t << SHIFT + 1 | small.astype(np.int64) << SHIFT | np.where(small, FULL - run, run))[:, None])
        out.append(part.spill() if text.n > scratch.most else part)
        follow = (int(t[0]), int(small[0]), int(run[0]))
    return out


def _symbol(mark: np.ndarray) -> np.ndarray:
    return mark >> SHIFT + 1


def _small(mark: np.ndarray) -> np.ndarray:
    return mark >> SHIFT & 1


def _run_of(mark: np.ndarray) -> np.ndarray:
    low = mark & FULL
    return np.where(_small(mark) == 1, FULL - low, low)


def _context(marks: Rows) -> Iterator[np.ndarray]:
    """(symbol, position, mark of the position before or -1, mark, places of the run up to here) of each position."""
    n, back = 0, 0
    for chunk, last in with_last(marks.chunks()):
        m = chunk[:, 0]
        before = np.concatenate(([-1 if last is None else last[0]], m[:-1]))
        symbol = _symbol(m)
        new = symbol != np.where(before < 0, -1, _symbol(before))
        at = np.arange(len(m))
        start = np.maximum.accumulate(np.where(new, at, -1))
        run = np.where(start >= 0, at - start + 1, at + 1 + back)
        back = int(run[-1])
        yield np.stack((symbol, n + at, before, m, run), 1)
        n += len(m)


class Ranges:
    """The context in order of symbols, and where its ranges begin."""

    def __init__(self, marks: Rows, scratch: Scratch):
        self.rows = Rows(scratch, 5)
        low, begin, stars, large = [], [], [], []
        seen = [0, 0, 0]  # rows, S* and L suffixes before this chunk
        part = -1
        for chunk, last in with_last(ordered(scratch, _context(marks), 5, 1)):
            symbol, before, mark = chunk[:, 0], chunk[:, 2], chunk[:, 3]
            star = (_small(mark) == 1) & (before >= 0) & (_small(before) == 0)
            is_large = _small(mark) == 0
            head = np.flatnonzero(np.concatenate(([last is None or last[0] != symbol[0]], symbol[1:] != symbol[:-1])))
            which = (head + seen[0]) // RANGE_TUPLES
            new = head[np.concatenate(([which[0] != part], which[1:] != which[:-1]))] if len(head) else head
            if len(head):
                part = int(which[-1])
            s, g = np.concatenate(([0], np.cumsum(star))), np.concatenate(([0], np.cumsum(is_large)))
            low += symbol[new].tolist()
            begin += (new + seen[0]).tolist()
            stars += (s[new] + seen[1]).tolist()
            large += (g[new] + seen[2]).tolist()
            seen = [seen[0] + len(chunk), seen[1] + int(s[-1]), seen[2] + int(g[-1])]
            self.rows.add(chunk)
        self.low, self.begin = np.array([*low, -1]), np.array([*begin, seen[0]])
        self.stars, self.large = np.array([*stars, seen[1]]), np.array([*large, seen[2]])


class _Feed:
    """Rows of a stream, so many at a time."""

    def __init__(self, chunks: Iterator[np.ndarray], columns: int):
        self.chunks, self.columns = chunks, columns
        self.rest = np.zeros((0, columns), np.int64)

    def take(self, n: int) -> np.ndarray:
        parts = [self.rest]
        have = len(self.rest)
        while have < n:
            parts.append(next(self.chunks))
            have += len(parts[-1])
        rows = np.concatenate(parts) if len(parts) > 1 else self.rest
        self.rest = rows[n:]
        return rows[:n]


def _induce(n: int, ranges: Ranges, seeds: Iterator[np.ndarray], symbols: int, up: bool, scratch: Scratch) -> Rows:
    """(position, common prefix with the one before, whether it was induced) of all seeds and targets in order.

    up: the L pass, from all S* suffixes; else the S pass over flipped symbols, from all L suffixes in falling order and the last
    suffix. A target is induced from the position after it, which is a seed or a target of no greater symbol.
    """
    flip = (lambda s: s) if up else (lambda s: symbols - 1 - s)
    parts = len(ranges.low) - 1
    turns = range(parts) if up else range(parts - 1, -1, -1)
    upper = [*ranges.low[1:-1].tolist(), symbols]
    bounds = np.array([ranges.low[k] if up else symbols - upper[k] for k in turns], np.int64)
    queue, feed, out = RangeQueue(bounds, scratch), _Feed(seeds, 2), Rows(scratch, 3)
    later: list[tuple[int, int, list]] = []

    def one(k: int, low: int, high: int, taken: np.ndarray) -> None:
        c = ranges.rows.slice(int(ranges.begin[k]), int(ranges.begin[k + 1]))
        sorted_symbols = flip(c[:, 0]) if up else flip(c[::-1, 0])
        c = c[np.argsort(c[:, 1], kind="stable")]
        place, symbol, back, run = c[:, 1], flip(c[:, 0]), c[:, 4], _run_of(c[:, 3])
        first = c[:, 2] < 0
        prev = np.where(first, -1, flip(_symbol(c[:, 2])))
        is_target = (_small(c[:, 3]) == (0 if up else 1)) & (place != (-1 if up else n - 1))
        prev_target = ~first & (_small(c[:, 2]) == (0 if up else 1))
        at = lambda p: np.searchsorted(place, p)
        names = sorted_symbols[np.concatenate(([True], sorted_symbols[1:] != sorted_symbols[:-1]))]
        count = int(ranges.stars[k + 1] - ranges.stars[k]) if up else int(ranges.large[k + 1] - ranges.large[k])
        if not up and ranges.low[k] == 0:
            count += 1  # the last suffix, alone with its symbol, comes after all others
        seed = feed.take(count)
        seed_at = at(seed[:, 0])
        seed_symbol, seed_lcp = symbol[seed_at], seed[:, 1]
        seed_minima = Minima(seed_lcp)

        def expanded(p: np.ndarray, after: np.ndarray, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Targets that end a run of their symbol, given the columns of what follows: every place of the run, with its columns."""
            r = at(p)
            b = back[r]
            rep = np.repeat(np.arange(len(p)), b)
            j = np.arange(len(rep)) - np.repeat(np.cumsum(b) - b, b)
            return p[rep] - j, np.concatenate(((symbol[r][rep] << SHIFT | j + 1)[:, None], after[rep]), 1), origin[rep]

        def settle(low: int, high: int, rows: np.ndarray) -> None:
            """Orders everything whose symbol is in [low, high).

            A suffix is compared by columns: its symbol and the length of its run (the shorter comes first), then the same of what
            follows, up to a suffix whose rank is known from an earlier range or that is a seed.
            """
            base = out.n
            rows = rows[np.argsort(rows[:, 0], kind="stable")]
            gaps = Minima(rows[:, 3])  # common prefixes of what follows tuples of one symbol
            s0, s1 = np.searchsorted(seed_symbol, (low, high))
            own = np.arange(s0, s1)
            inside = lambda s: base + 2 * np.searchsorted(names, s)
            # first the targets before a known suffix or before a seed of the range, then those before them that stay in it
            front = [expanded(rows[:, 2], (rows[:, 1] << SHIFT)[:, None], np.arange(len(rows)))] if len(rows) else []
            r = seed_at[own]
            inner = prev_target[r] & (prev[r] < high)
            if inner.any():
                front.append(expanded(seed[own[inner], 0] - 1, np.stack((inside(seed_symbol[own[inner]]) + 1 << SHIFT, own[inner]), 1), np.full(int(inner.sum()), -1)))
            levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            depth = 0
            while front:
                levels += front
                nxt = []
                for p, key, origin in front:
                    r = at(p)
                    ok = prev_target[r] & (prev[r] < high) & (prev[r] > symbol[r])
                    if ok.any():
                        head = key[ok, 0]
                        nxt.append(expanded(p[ok] - 1, np.concatenate(((inside(head >> SHIFT) << SHIFT | head & FULL)[:, None], key[ok, 1:]), 1), origin[ok]))
                depth += 1
                if nxt and depth > DEPTH:
                    mid = (low + high) // 2
                    # what the lower half finds for the upper one comes after what was known, as its ranks are greater
                    more: list[np.ndarray] = []
                    later.append((mid, high, more))
                    settle(low, mid, rows[rows[:, 0] < mid])
                    later.pop()
                    settle(mid, high, np.concatenate([rows[rows[:, 0] >= mid], *more]))
                    return
                front = nxt
            if not levels:
                emit(high, np.zeros(0, np.int64), np.zeros(0, np.int64), own)
                return
            width = max(key.shape[1] for _, key, _ in levels)
            key = np.concatenate([np.pad(key, ((0, 0), (0, width - key.shape[1])), constant_values=-1) for _, key, _ in levels])
            p, origin = np.concatenate([p for p, _, _ in levels]), np.concatenate([o for _, _, o in levels])
            sort = np.lexsort(key.T[1::-1])
            if width > 2:
                k2 = key[sort, :2]
                eq = (k2[1:] == k2[:-1]).all(1)
                same = np.append(eq, False) | np.append(False, eq)
                if same.any():
                    sub = sort[same]
                    sort[same] = sub[np.lexsort(key[sub].T[::-1])]
            p, key, origin = p[sort], key[sort], origin[sort]
            lcp = np.zeros(len(p), np.int64)
            if len(p) > 1:
                lcp[1:] = prefixes(p, key, origin, base, gaps)
            emit(high, p, np.minimum(lcp, CAP), own)

        def prefixes(p: np.ndarray, key: np.ndarray, origin: np.ndarray, base: int, gaps: Minima) -> np.ndarray:
            """Common prefix of each sorted suffix with the one before it."""
            a, b = key[:-1], key[1:]
            got = np.where(a[:, 0] >> SHIFT == b[:, 0] >> SHIFT, np.minimum(a[:, 0], b[:, 0]) & FULL, 0)
            rows = np.flatnonzero(a[:, 0] == b[:, 0])
            j = 1
            while len(rows):  # these agree in all columns before j, over got symbols
                x, y = a[rows, j], b[rows, j]
                known = y < base << SHIFT
                r = rows[known]
                got[r] += gaps.least(origin[r] + 1, origin[r + 1] + 1)
                name_x, name_y = (x >> SHIFT) - base, (y >> SHIFT) - base
                inner = (x >= base << SHIFT) & (name_x // 2 == name_y // 2)
                is_x, is_y = name_x % 2 == 1, name_y % 2 == 1
                two = inner & is_x & is_y
                if two.any():
                    got[rows[two]] += seed_minima.least(a[rows[two], j + 1] + 1, b[rows[two], j + 1] + 1)
                # a target and a seed of one symbol, or two runs of other lengths: common is the shorter run
                mix = inner & ~is_x & is_y
                if mix.any():
                    r = rows[mix]
                    got[r] += np.minimum(run[at(p[r] + got[r])], run[at(p[r + 1] + got[r])])
                runs = inner & ~is_x & ~is_y
                got[rows[runs]] += np.minimum(x[runs], y[runs]) & FULL
                rows = rows[runs & (x == y)]
                j += 1
            return got

        def emit(high: int, p: np.ndarray, lcp: np.ndarray, own: np.ndarray) -> None:
            """Appends targets and seeds of a range, symbol by symbol, targets first; puts what comes before them into the queue."""
            base = out.n
            r = at(p)
            sym = np.concatenate((symbol[r] * 2, seed_symbol[own] * 2 + 1))
            sort = np.argsort(sym, kind="stable")
            allr, alll = np.concatenate((r, seed_at[own]))[sort], np.concatenate((lcp, seed_lcp[own]))[sort]
            sym = sym[sort]
            if not len(sym):
                return
            new = np.concatenate(([True], sym[1:] != sym[:-1]))
            alll[new] = 0
            turn = np.flatnonzero(new[1:] & (sym[1:] // 2 == sym[:-1] // 2)) + 1
            alll[turn] = np.minimum(np.minimum(run[allr[turn - 1]], run[allr[turn]]), CAP)
            out.add(np.stack((place[allr], alll, is_target[allr].astype(np.int64)), 1))
            ok = np.flatnonzero(prev_target[allr] & (prev[allr] >= high))
            if not len(ok):
                return
            ok = ok[np.argsort(prev[allr[ok]], kind="stable")]
            q = allr[ok]
            # between ranks of one symbol; suffixes of other batches begin with other symbols, so nothing is common with them
            gap = np.zeros(len(ok), np.int64)
            same = np.flatnonzero(prev[q[1:]] == prev[q[:-1]]) + 1
            gap[same] = Minima(alll).least(ok[same - 1] + 1, ok[same] + 1)
            tuples = np.stack((prev[q], base + ok, place[q] - 1, gap), 1)
            for a, z, more in reversed(later):
                here = tuples[:, 0] < z
                if here.any():
                    more.append(tuples[here])
                tuples = tuples[~here]
            if len(tuples):
                queue.put(tuples)

        settle(low, high, taken)

    for turn, k in enumerate(turns):
        low = int(bounds[turn])
        one(k, low, int(bounds[turn + 1]) if turn + 1 < parts else symbols, queue.take(turn))
    queue.close()
    return out


def _stars(marks: Rows, n: int) -> Iterator[np.ndarray]:
    """(number, position, end) of the S* substrings, each of which ends where the next one begins."""
    held, number, at = None, 0, 0
    for chunk, last in with_last(marks.chunks()):
        m = chunk[:, 0]
        before = np.concatenate(([m[0] if last is None else last[0]], m[:-1]))
        star = np.flatnonzero((_small(m) == 1) & (_small(before) == 0)) + at
        at += len(m)
        if held is not None:
            star = np.concatenate((held, star))
        if len(star) > 1:
            yield np.stack((number + np.arange(len(star) - 1), star[:-1], star[1:]), 1)
            number += len(star) - 1
        held = star[-1:] if len(star) else held
    if held is not None and len(held):
        yield np.array([[number, held[0], n - 1]])


def _named(marks: Rows, n: int, scratch: Scratch) -> tuple[Rows, int, np.ndarray]:
    """(place in the order, number, position) of the S* substrings, equal ones at one place, in order; how many names there are; and the
    common prefix of each name with the one before, in symbols."""
    # open: (rank, number, position, end) by position; ranks are places in the order, so that later splits need not move the others
    open_ = of_chunks(scratch, (np.insert(c, 0, 0, axis=1) for c in _stars(marks, n)), 4)
    final, heads, depth = Rows(scratch, 3), Rows(scratch, 2), 0
    while open_.n:

        def keyed() -> Iterator[np.ndarray]:
            for c in open_.chunks():
                at = c[:, 2] + depth
                cols = [np.where(at + j <= c[:, 3], marks.gather(np.minimum(at + j, n - 1))[:, 0], -1) for j in range(4)]
                yield np.stack((c[:, 0], *cols, c[:, 1], c[:, 2], c[:, 3]), 1)

        still = Rows(scratch, 4)
        held = np.zeros((0, 8), np.int64)  # the last row waits for the one after it
        last, rank, seen = None, -1, 0  # last row that was settled, its new rank, and how many of its old rank came before

        def settle(rows: np.ndarray, follow: np.ndarray | None) -> None:
            nonlocal last, rank, seen
            before = np.concatenate((rows[:1] - 1 if last is None else last[None], rows[:-1]))
            tie = rows[:, 0] == before[:, 0]
            eq = np.cumprod(rows[:, 1:5] == before[:, 1:5], axis=1).sum(1)
            same = tie & (eq == 4)
            at = np.arange(len(rows))
            start = np.maximum.accumulate(np.where(~tie, at, -1))
            inside = np.where(start >= 0, at - start, at + seen)  # place among those of the old rank
            new = np.maximum.accumulate(np.where(same, -1, rows[:, 0] + inside))
            new = np.where(new >= 0, new, rank)
            split = np.flatnonzero(tie & ~same)
            if len(split):
                k = 1 + eq[split]
                x, y = before[split, k], rows[split, k]
                common = depth + eq[split] + np.where(_symbol(x) == _symbol(y), np.minimum(_run_of(x), _run_of(y)), 0)
                heads.add(np.stack((new[split], np.minimum(common, CAP)), 1))
            ahead = np.append(same[1:], follow is not None and bool((follow[:5] == rows[-1, :5]).all()))
            done = rows[:, 6] + depth + 4 > rows[:, 7]
            go = (same | ahead) & ~done
            final.add(np.stack((new[~go], rows[~go, 5], rows[~go, 6]), 1))
            still.add(np.stack((new[go], rows[go, 5], rows[go, 6], rows[go, 7]), 1))
            last, rank, seen = rows[-1].copy(), int(new[-1]), int(inside[-1]) + 1

        for c in ordered(scratch, keyed(), 8, 5):
            rows = np.concatenate((held, c))
            if len(rows) > 1:
                settle(rows[:-1], rows[-1])
            held = rows[-1:]
        if len(held):
            settle(held, None)
        open_.free()
        open_ = of_chunks(scratch, ordered(scratch, ((c[:, [2, 0, 1, 3]]) for c in still.chunks()), 4, 1), 4)
        still.free()
        back = Rows(scratch, 4)
        for c in open_.chunks():
            back.add(c[:, [1, 2, 0, 3]])
        open_.free()
        open_ = back
        depth += 4
    open_.free()
    out = of_chunks(scratch, ordered(scratch, final.chunks(), 3, 2), 3)
    final.free()
    lcp = [c[:, 1].astype(np.uint8) for c in ordered(scratch, heads.chunks(), 2, 1)]
    heads.free()
    lcp = np.concatenate([np.zeros(1, np.uint8), *lcp])  # every name but the first has a head
    return out, len(lcp), lcp


def _names(places: Rows) -> Iterator[np.ndarray]:
    """(name, number, position) of rows by place."""
    name = -1
    for c, last in with_last(places.chunks()):
        new = np.concatenate(([last is None or c[0, 0] != last[0]], c[1:, 0] != c[:-1, 0]))
        own = name + np.cumsum(new)
        name = int(own[-1])
        yield np.stack((own, c[:, 1], c[:, 2]), 1)


def _star_order(marks: Rows, n: int, scratch: Scratch) -> Rows:
    """(position, common prefix with the one before) of the S* suffixes in order."""
    places, count, lcp = _named(marks, n, scratch)
    m = places.n
    seeds = Rows(scratch, 2)
    if count == m:
        k = 0
        for c in places.chunks():
            seeds.add(np.stack((c[:, 2], lcp[k : k + len(c)]), 1))
            k += len(c)
        places.free()
        return seeds
    # names by number, with their positions
    stars = of_chunks(scratch, ordered(scratch, (c[:, [1, 0, 2]] for c in _names(places)), 3, 1), 3)
    places.free()
    text = of_chunks(scratch, (c[:, 1:2] for c in stars.chunks()), 1)
    least = Minima(lcp)

    def asked() -> Iterator[np.ndarray]:
        """(number, k, which) of all that the k-th pair of neighbours in the order needs to know: x, and where the two differ."""
        k = 0
        for c, last in with_last(suffixes(text, count, scratch)):
            x = np.concatenate(([c[0, 0] if last is None else last[0]], c[:-1, 0]))
            h = c[:, 1]
            at = k + np.arange(len(c))
            for which, number in enumerate((c[:, 0], np.minimum(x + h, m - 1), np.minimum(c[:, 0] + h, m - 1), x)):
                yield np.stack((number, at, np.full(len(c), which), h), 1)
            k += len(c)

    def told() -> Iterator[np.ndarray]:
        for c in ordered(scratch, asked(), 4, 1):
            found = stars.gather(c[:, 0])
            yield np.stack((4 * c[:, 1] + c[:, 2], c[:, 2], found[:, 1], found[:, 2], c[:, 3]), 1)

    rest = np.zeros((0, 5), np.int64)
    for c in ordered(scratch, told(), 5, 1):
        rows = np.concatenate((rest, c))
        whole = len(rows) // 4 * 4
        rest, rows = rows[whole:], rows[:whole].reshape(-1, 4, 5)
        if not len(rows):
            continue
        a, b = rows[:, 1, 2], rows[:, 2, 2]
        value = rows[:, 1, 3] - rows[:, 3, 3]
        differ = a < b
        value[differ] += least.least(a[differ] + 1, b[differ] + 1)
        value = np.where(rows[:, 0, 4] >= CAP, CAP, np.minimum(value, CAP))
        value[rows[:, 0, 0] == 0] = 0
        seeds.add(np.stack((rows[:, 0, 3], value), 1))
    stars.free()
    return seeds


def suffixes(text: Rows, symbols: int, scratch: Scratch) -> Iterator[np.ndarray]:
    """(position, common prefix with the one before, capped) of all suffixes in order. text: one column, symbols below `symbols`, of
    which the last is 0 and occurs only there; it is freed."""
    n = text.n
    if n == 1:
        text.free()
        yield np.zeros((1, 2), np.int64)
        return
    parts = _marks(text, scratch)
    text.free()
    marks = Rows(scratch, 1)
    for part in reversed(parts):
        for c in part.chunks():
            marks.add(c)
        part.free()
    ranges = Ranges(marks, scratch)
    seeds = _star_order(marks, n, scratch)
    marks.free()
    up = _induce(n, ranges, seeds.chunks(), symbols, True, scratch)
    seeds.free()

    large = Rows(scratch, 2)
    least = CAP  # since the last L suffix
    for c in up.chunks():
        at = np.flatnonzero(c[:, 2] == 1)
        if not len(at):
            least = min(least, int(c[:, 1].min()))
            continue
        # the minimum over what lies between, the suffix itself with it
        lows = np.minimum.reduceat(c[: at[-1] + 1, 1], np.concatenate(([0], at[:-1] + 1)))
        lows[0] = min(lows[0], least)
        large.add(np.stack((c[at, 0], lows), 1))
        tail = c[at[-1] + 1 :, 1]
        least = int(tail.min()) if len(tail) else CAP
    up.free()

    def falling() -> Iterator[np.ndarray]:
        carry = 0
        for c in large.backward():
            yield np.stack((c[:, 0], np.concatenate(([carry], c[:-1, 1]))), 1)
            carry = int(c[-1, 1])
        yield np.array([[n - 1, 0]])

    down = _induce(n, ranges, falling(), symbols, False, scratch)
    large.free()
    ranges.rows.free()
    carry = 0
    for c in down.backward():
        yield np.stack((c[:, 0], np.concatenate(([carry], c[:-1, 1]))), 1)
        carry = int(c[-1, 1])
    down.free()


def suffix_array(text: np.ndarray, symbols: int, system, folder: str, most: int = MEMORY_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Suffix and common-prefix array, as arrays, of a string that is one."""
    scratch = Scratch(system, folder, most)
    rows = Rows(scratch, 1)
    rows.add(np.asarray(text, np.int64)[:, None])
    parts = list(suffixes(rows, symbols, scratch))
    scratch.close()
    out = np.concatenate(parts)
    return out[:, 0], out[:, 1].astype(np.uint8)
