"""Texts that sums of powers modulo 2^64 take for equal: Thue-Morse words and their complements."""

import hashlib

import numpy as np
import pytest

from tidemark.llm import lm_score, ngram_join, packing, suffix_dedup
from tidemark.llm.common import equal_spans, hash_spans


def pair(n, letters="ab"):
    x = "".join(letters[i.bit_count() & 1] for i in range(n))
    return x, x.translate(str.maketrans(letters, letters[::-1]))


def table(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


SIZES = [1024, 2048, 8192]


@pytest.mark.parametrize("n", SIZES)
def test_words(spark, n):
    x, y = pair(n)
    got = {r.doc_id: r.component_id for r in ngram_join.join(table(spark, [f"a b c d {x}", f"a b c d {y}", f"A b c d {x}"])).collect()}
    assert got == {0: 0, 1: 1, 2: 0}
    score = {r.doc_id: r.log_score for r in lm_score.score(table(spark, [f"{x} {x}", y])).collect()}
    assert score[1] == pytest.approx(np.log(1 / 3)) and score[0] == pytest.approx(np.log(2 / 3) + np.log(0.4 * 2 / 3))


@pytest.mark.parametrize("n", SIZES)
def test_tokens(n):
    x, y = pair(n)
    enc = packing.WordEncoder(packing.default_tokenizer())
    for text, ids in zip((f"{x} {y}", y), enc.encode([f"{x} {y}".encode(), y.encode()])):
        assert ids.tolist() == enc.whole.encode(text, add_special_tokens=False).ids


def test_tokens_when_hashes_meet(monkeypatch):
    monkeypatch.setattr(packing, "hash_spans", lambda raw, a, b: (b - a).astype(np.uint64) // np.uint64(2))
    enc = packing.WordEncoder(packing.default_tokenizer())
    for text in ("one two six ten cat catalogue", "ten four'll be a’b strange, é", ""):
        for _ in range(2):
            assert enc.encode([text.encode()])[0].tolist() == enc.whole.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("hot", [20_000, 0])
def test_long_strings(spark, hot):
    """Runs and windows of 1,024 bytes and more."""
    x, y = pair(4096)
    texts, t = [x, y, x, "z" * 3000, "z" * 2000], 1100
    seen, want = set(), {}
    for d, s in enumerate(texts):
        gone = bytearray(len(s))
        for i in range(len(s) - t + 1):
            if s[i : i + t] in seen:
                gone[i : i + t] = b"\1" * t
            seen.add(s[i : i + t])
        want[d] = hashlib.sha256(bytes(c for c, g in zip(s.encode(), gone) if not g)).hexdigest()
    got = suffix_dedup.dedup(table(spark, texts), threshold=t, hot=hot)
    assert {r.doc_id: r.kept_sha256 for r in got.collect()} == want


def test_spans():
    rng = np.random.default_rng(0)
    raw = rng.integers(97, 99, 3000).astype(np.uint8)
    a = rng.integers(0, 3000, 4000)
    b = np.minimum(3000, a + rng.integers(0, 400, 4000))
    names = {}
    for x, y, h in zip(a, b, hash_spans(raw, a, b).tolist()):
        assert names.setdefault(h, raw[x:y].tobytes()) == raw[x:y].tobytes()
    assert len(set(names.values())) == len(names)
    n = np.minimum(b - a, 3000 - a[::-1])
    assert equal_spans(raw, a, n, raw, a[::-1]).tolist() == [raw[x : x + k].tobytes() == raw[y : y + k].tobytes() for x, y, k in zip(a, a[::-1], n)]
