import os
import random

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from quadrille.llm import _external as external
from quadrille.llm import _suffix_array as arrays
from quadrille.llm import chunk_dedup, near_dedup, suffix_dedup
from quadrille.llm._base import joined, local_path

from .tables import HARD, PASSAGE, documents, empty, hard, prose


def by_id(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


# suffix arrays
def brute(t):
    order = sorted(range(len(t)), key=lambda i: t[i:])
    lcp = [0]
    for a, b in zip(order, order[1:]):
        k = 0
        while max(a, b) + k < len(t) and t[a + k] == t[b + k]:
            k += 1
        lcp.append(min(k, arrays.CAP))
    return order, lcp


@pytest.mark.parametrize("seed", range(8))
def test_suffix_array(tmp_path, monkeypatch, seed):
    r = np.random.default_rng(seed)
    for _ in range(40):
        monkeypatch.setattr(arrays, "RANGE_TUPLES", int(r.choice([2, 8, 16384])))
        monkeypatch.setattr(arrays, "DEPTH", int(r.choice([1, 2, 32])))
        t = r.integers(1, int(r.choice([1, 2, 3, 30])) + 1, int(r.integers(1, 90))).tolist()
        if r.random() < 0.5:
            t = t + t[: len(t) // 2] + [1] * int(r.integers(0, 30)) + t
        t.append(0)
        order, lcp = arrays.suffix_array(np.array(t), max(t) + 1, fs.LocalFileSystem(), str(tmp_path), int(r.choice([3, 20, 10**6])))
        assert (order.tolist(), lcp.tolist()) == brute(t)
    assert os.listdir(tmp_path) == []  # runs that were spilled are gone


def repeated_windows(docs, n):
    """Brute force: for each (doc, place), whether an equal window of n words comes before it."""
    first, out = {}, {}
    for d, t in docs:
        w = t.split()
        for i in range(len(w) - n + 1):
            key = tuple(w[i : i + n])
            if key in first:
                out.setdefault(d, []).append((i, first[key]))
            else:
                first[key] = (d, i)
    return out


def without_windows(docs, n):
    found, out = repeated_windows(docs, n), []
    for d, t in docs:
        gone = set()
        for i, (e, j) in found.get(d, []):
            gone |= set(range(max(i, j + n) if e == d else i, i + n))
        out.append((d, [w for k, w in enumerate(t.split()) if k not in gone]))
    return out


def test_passages_against_brute_force(spark):
    r = random.Random(5)
    shared = [prose(f"s{k}", r.randint(45, 90)) for k in range(8)]
    texts = []
    for d in range(60):
        parts = [prose(f"{d}.{k}", r.randint(5, 60)) for k in range(3)]
        if r.random() < 0.7:
            parts.insert(r.randint(0, 3), r.choice(shared))
        if r.random() < 0.2:
            parts.append(" ".join([r.choice(["tick", "tock"])] * r.randint(40, 160)))
        texts.append((d, " ".join(parts)))
    got = {d: t.split() for d, t in by_id(suffix_dedup.dedup(documents(spark, texts)))}
    assert got == dict(without_windows(texts, suffix_dedup.WORDS))


def test_passages_of_hard_cases(spark):
    got = by_id(suffix_dedup.dedup(hard(spark)))
    assert len(got) == len(HARD)
    text = dict(got)
    assert PASSAGE in text[10] and PASSAGE not in text[11] and text[11].startswith(prose(12, 40)) and text[11].endswith(prose(13, 90))
    assert text[2] == "" and text[1] == prose(1, 120)
    assert [t for d, t in got if d in (4, 5, 6, 7, 8, 12, 15, 16)] == [t for d, t in sorted(HARD, key=repr) if d in (4, 5, 6, 7, 8, 12, 15, 16)]
    assert suffix_dedup.dedup(empty(spark)).count() == 0
    out = suffix_dedup.dedup(hard(spark))
    assert out.columns == hard(spark).columns and out.where("doc_id = 11 AND n_chars <> length(text)").count() == 0


def test_shards_larger_than_memory(spark):
    """A shard of which a step may hold few rows finds the same, and leaves no files."""
    texts = [(d, prose(d, 30) + " " + prose(f"p{d % 7}", 80)) for d in range(40)]
    whole = by_id(suffix_dedup.dedup(documents(spark, texts)))
    assert sum(len(t.split()) for _, t in whole) == 40 * 30 + 7 * 80
    spans, folder = suffix_dedup.repeats(documents(spark, texts), most=50)
    assert spans.count() == 33 and os.listdir(local_path(folder)) == []
    assert by_id(suffix_dedup.dedup(documents(spark, texts), most=50)) == whole


def test_one_passage_in_every_document(spark):
    """Thousands of holders of one segment: the first keeps it."""
    passage = prose("hot", 60)
    texts = [(d, passage if d % 2 else f"{prose(d, 3)} {passage}") for d in range(2000)]
    got = dict(by_id(suffix_dedup.dedup(documents(spark, texts), most=400)))
    assert {d: t.split() for d, t in got.items()} == dict(without_windows(texts, suffix_dedup.WORDS)) and got[0] == texts[0][1]


def test_queues_go_to_disk(tmp_path, monkeypatch):
    """A string of fifteen times what a step may hold: queues spill, and the order is right."""
    spills = []
    spill = arrays.RangeQueue.spill
    monkeypatch.setattr(arrays.RangeQueue, "spill", lambda self: (spills.append(self.size), spill(self)))
    monkeypatch.setattr(arrays, "RANGE_TUPLES", 512)
    r = np.random.default_rng(7)
    part = r.integers(1, 2**33, 20_000)
    t = np.concatenate([part, r.integers(1, 2**33, 20_000), part, [0]])
    scratch = external.Scratch(fs.LocalFileSystem(), str(tmp_path), 4096)
    text = external.Rows(scratch, 1)
    text.add(t[:, None])
    got = np.concatenate(list(arrays.suffixes(text, 2**33, scratch)))
    order, lcp = got[:, 0], got[:, 1]
    assert sorted(order) == list(range(len(t))) and len(spills) > 10 and max(spills) <= 4096 and scratch.written > 100 * len(t)
    a, b, h = order[:-1], order[1:], lcp[1:]
    sure = h < arrays.CAP
    assert (t[a[sure] + h[sure]] < t[b[sure] + h[sure]]).all()
    for x, y, n in list(zip(a, b, h))[::50]:
        assert (t[x : x + n] == t[y : y + n]).all()
    assert (~sure).sum() == 20_000 - arrays.CAP + 1 and os.listdir(tmp_path) == []


# chunks
def test_chunks_partition_and_resist_shifts():
    t = prose(3, 3000)
    data, offsets = joined(pa.array([t, "prefix " + t, "", None]))
    doc, a, z = chunk_dedup.chunks(data, offsets)
    for d, text in enumerate([t, "prefix " + t]):
        mine = [(x, y) for k, x, y in zip(doc, a, z) if k == d]
        assert b"".join(bytes(data[x:y]) for x, y in mine) == text.encode()
    one, two = ({bytes(data[x:y]) for k, x, y in zip(doc, a, z) if k == d} for d in (0, 1))
    assert len(one & two) > 0.95 * len(one)
    assert set(doc) == {0, 1}


def test_chunk_dedup(spark):
    got = by_id(chunk_dedup.dedup(hard(spark)))
    assert len(got) == len(HARD)
    text = dict(got)
    assert text[1] == prose(1, 120) and text[2] == "" and PASSAGE in text[10] and PASSAGE not in text[11]
    for d in (4, 5, 6, 7, 8, 15, 16):
        assert text[d] == dict(HARD)[d]
    assert chunk_dedup.dedup(empty(spark)).count() == 0
    assert chunk_dedup.dedup(hard(spark)).columns == hard(spark).columns


def test_chunk_dedup_against_brute_force(spark):
    r = random.Random(2)
    shared = [prose(f"c{k}", 80) for k in range(5)]
    texts = [(d, prose(d, r.randint(0, 50)) + " " + r.choice(shared) + " " + prose(-d, 40)) for d in range(30)]
    seen, want = set(), {}
    for d, t in texts:
        data, offsets = joined(pa.array([t]))
        _, a, z = chunk_dedup.chunks(data, offsets)
        parts = [bytes(data[x:y]) for x, y in zip(a, z)]
        old = []
        for p in parts:
            old.append(p in seen)
            seen.add(p)
        out, k = b"", 0
        while k < len(parts):
            e = k
            while e < len(parts) and old[e]:
                e += 1
            if sum(map(len, parts[k:e])) < chunk_dedup.RUN_BYTES:
                out += b"".join(parts[k:e])
            if e < len(parts):
                out += parts[e]
            k = e + 1
        want[d] = out.decode()
    assert dict(by_id(chunk_dedup.dedup(documents(spark, texts)))) == want


def test_chunks_that_polynomials_confuse(spark):
    """Two texts made so that every polynomial hash modulo 2^64 is equal on them are no copies."""
    t = "a"
    while len(t) < chunk_dedup.MAX_CHUNK:
        t += t.translate(str.maketrans("ab", "ba"))
    other = t.translate(str.maketrans("ab", "ba"))
    got = dict(by_id(chunk_dedup.dedup(documents(spark, [(1, t), (2, other), (3, prose(1, 50))]))))
    assert got[1] + got[2] == t + other or got[2] != ""
    data, offsets = joined(pa.array([t, other]))
    assert chunk_dedup.span_hashes(chunk_dedup.BYTE_VALUES[0][data], offsets[:-1], offsets[1:] - 1).tolist()[0] == chunk_dedup.span_hashes(chunk_dedup.BYTE_VALUES[0][data], offsets[:-1], offsets[1:] - 1).tolist()[1]


def test_a_chunk_that_every_document_has(spark):
    """The first document keeps a common passage, all others lose it, however many they are."""
    common = prose("everywhere", 60)
    texts = [(d, common + " " + prose(d, 5)) for d in range(3000)]
    got = dict(by_id(chunk_dedup.dedup(documents(spark, texts))))
    assert got[0] == texts[0][1] and sum(map(len, got.values())) < 0.5 * sum(len(t) for _, t in texts)


# near copies
def brute_groups(texts):
    sig = near_dedup.signatures(*joined(pa.array([t for _, t in texts])))
    root = {d: d for d, _ in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (a, _) in enumerate(texts):
        for j in np.flatnonzero((sig[i + 1 :] == sig[i]).sum(1) >= near_dedup.MATCHES) + i + 1:
            x, y = sorted((find(a), find(texts[j][0])))
            root[y] = x
    out = {}
    for d, _ in texts:
        out.setdefault(find(d), []).append(d)
    return {k: sorted(v) for k, v in out.items() if len(v) > 1}


def test_near_groups_against_brute_force(spark):
    r = random.Random(8)
    texts = []
    for g in range(25):
        words = prose(g, r.randint(1, 150)).split()
        for _ in range(r.randint(1, 12)):
            w = list(words)
            for _ in range(int(len(w) * r.choice([0, 0.02, 0.1, 0.3]))):
                w[r.randrange(len(w))] = f"edit{r.random()}"
            texts.append((len(texts), " ".join(w)))
    got = {r.keep_doc_id: list(r.doc_ids) for r in near_dedup.near_groups(documents(spark, texts)).collect()}
    assert got == brute_groups(texts)


def test_long_chains_are_one_group(spark):
    """Each text is near the next, but not near those far away."""
    words = prose(1, 400).split()
    texts = [(k, " ".join(words[6 * k : 6 * k + 60])) for k in range(40)]
    got = {r.keep_doc_id: list(r.doc_ids) for r in near_dedup.near_groups(documents(spark, texts)).collect()}
    assert got == brute_groups(texts) and len(got) >= 1


def test_linked_is_the_closure():
    r = np.random.default_rng(4)
    sig = r.integers(0, 2, (60, near_dedup.COORDINATES)).astype(np.uint32)
    for need in (35, 38, 41):
        a, b = near_dedup.linked(sig, need)
        both = [(i, j) for i in range(60) for j in range(i) if (sig[i] == sig[j]).sum() >= need]

        def parts(edges):
            root = list(range(60))

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for x, y in edges:
                root[find(x)] = find(y)
            return {frozenset(i for i in range(60) if find(i) == find(j)) for j in range(60)}

        assert parts(zip(a.tolist(), b.tolist())) == parts(both)


def test_near_hard_cases(spark):
    groups = {r.keep_doc_id: list(r.doc_ids) for r in near_dedup.near_groups(hard(spark)).collect()}
    assert groups[1] == [1, 2, 3] and 10 not in groups and 16 not in groups
    kept = near_dedup.keep_one(spark, hard(spark), "")
    ids = sorted((r.doc_id for r in kept.collect()), key=repr)
    assert ids.count(None) == 2 and 1 in ids and 2 not in ids and 3 not in ids and {4, 5, 6, 7, 8, 10, 11, 12, 13, 14, 15, 16} <= set(ids)
    assert kept.columns == hard(spark).columns
    assert near_dedup.keep_one(spark, empty(spark), "").count() == 0 and near_dedup.near_groups(empty(spark)).count() == 0


def test_empty_texts_are_copies_and_repeated_rows_one(spark):
    docs = documents(spark, [(1, ""), (2, ""), (3, "!!"), (4, "!!"), (5, "one two"), (5, "one two")])
    assert sorted(r.doc_id for r in near_dedup.keep_one(spark, docs, "").collect()) == [1, 3, 5]


def test_pairs_are_checked_by_their_shingles(spark):
    """Texts of true similarity 0.3 to 0.4 collide often enough by chance; none of them is a pair."""
    w = prose("stem", 30).split()
    texts = [(k, " ".join(w[:14] + prose(f"tail{k}", 12).split())) for k in range(120)]
    sets = [{tuple(x[i : i + 3]) for i in range(len(x) - 2)} for x in (t.split() for _, t in texts)]
    least = near_dedup.MATCHES / near_dedup.COORDINATES
    assert max(len(a & b) / len(a | b) for k, a in enumerate(sets) for b in sets[:k]) < least
    assert brute_groups(texts)  # by signatures alone
    assert near_dedup.near_groups(documents(spark, texts)).count() == 0
    assert near_dedup.keep_one(spark, documents(spark, texts), "").count() == len(texts)


def test_pairs_behind_a_failed_pair_are_found(spark):
    """A text of chance collisions that is met first doesn't hide true copies behind it."""
    stem = prose("stem", 14)
    texts = []
    for k in range(60):
        tail = prose(f"tail{k}", 12).split()
        texts += [(k, " ".join([stem, *tail])), (100 + k, " ".join([stem, *tail[:-1], "other"]))]
    got = {r.keep_doc_id: list(r.doc_ids) for r in near_dedup.near_groups(documents(spark, texts)).collect()}
    sig = dict(zip((d for d, _ in texts), near_dedup.signatures(*joined(pa.array([t for _, t in texts])))))
    want = {k: [k, 100 + k] for k in range(60) if (sig[k] == sig[100 + k]).sum() >= near_dedup.MATCHES}
    assert got == want and len(want) > 50


def test_a_doc_id_of_two_texts_loses_neither(spark):
    a, b = prose(31, 60), prose(32, 60)
    docs = documents(spark, [(3, a), (5, a), (5, b), (7, b)])
    assert by_id(near_dedup.keep_one(spark, docs, "")) == [(3, a), (5, b)]
