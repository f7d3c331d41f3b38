import base64
import random

import numpy as np
import pytest
import tiktoken

from quadrille.llm import byte_bpe, token_counts
from quadrille.llm._bpe import VOCABULARY, vocabulary

from .tables import HARD, empty, hard

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def reference():
    with open(VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(seed, n):
    r = random.Random(seed)
    bits = ["a", "b", " ", "  ", "\n", "'", "'s", "'re", "ll", "é", "日", "1", "²", "½", "!", "\t", "\x1c", " ", "😀", "the", " of"]
    return ["".join(r.choice(bits) for _ in range(r.randint(0, 90))) for _ in range(n)]


def test_whole_tokens_are_proved():
    v = vocabulary()
    assert len(v.alone) > 50_000
    ids, at = v.merged(v.data, v.starts, v.starts + v.sizes)
    assert all(ids[at[i]] == i and at[i + 1] - at[i] == 1 for i in v.alone[::97])


def test_heap_and_lock_step_agree():
    v = vocabulary()
    for t in texts(3, 200):
        raw = t.replace(" ", "").encode()[:32]
        if raw:
            ids, _ = v.merged(np.frombuffer(raw, np.uint8), np.array([0]), np.array([len(raw)]))
            assert ids.tolist() == v.long_piece(raw)


@pytest.mark.parametrize("leaf", [1, 5, 64, 8192])
def test_tree_is_exact(reference, leaf):
    xs = texts(leaf, 300)
    got = byte_bpe.encode_trees(vocabulary(), [x.encode() for x in xs], leaf)
    assert [g.tolist() for g in got] == [reference.encode_ordinary(x) for x in xs]


def test_counts(spark, reference):
    got = sorted(((r.doc_id, r.n_tokens) for r in token_counts.token_counts(hard(spark)).collect()), key=repr)
    assert got == sorted(((d, None if t is None else len(reference.encode_ordinary(t))) for d, t in HARD), key=repr)
    assert token_counts.token_counts(empty(spark)).count() == 0


def test_shortcut_takes_part(spark):
    rows = [r for r in token_counts.token_counts(hard(spark)).collect() if r.n_tokens]
    assert all(0 <= r.n_whole <= r.n_pretokens <= r.n_tokens for r in rows) and any(r.n_whole for r in rows)


def test_encode_and_decode(spark, reference):
    rows = byte_bpe.decode(byte_bpe.encode(hard(spark))).collect()
    assert sorted(((r.doc_id, r.text) for r in rows), key=repr) == sorted(HARD, key=repr)
    for r in rows:
        assert r.tokens == (None if r.text is None else reference.encode_ordinary(r.text))
    assert byte_bpe.decode(byte_bpe.encode(empty(spark))).count() == 0


def test_decode_tree():
    v = vocabulary()
    ids = np.random.default_rng(1).integers(0, 50_000, 3000)
    assert byte_bpe.decode_tree(v, ids, 7) == b"".join(v.tokens[i] for i in ids)
