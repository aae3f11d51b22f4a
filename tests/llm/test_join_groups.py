"""Groups of the shingle join: chains of lists, ids that are null or repeated, large groups in cells."""

import random

import numpy as np
import pytest

from tidemark.llm import ngram_join
from tidemark.llm.counting import NULL_ID


def sets_of(rows):
    out = []
    for _, t in rows:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets, up = sets_of(rows), list(range(len(rows)))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                up[top(i)] = top(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[top(i)] = min(least.get(top(i), 1 << 62), NULL_ID if d is None else d)
    named = lambda x: None if x == NULL_ID else x
    return sorted(((d, len(sets[i]), named(least[top(i)])) for i, (d, _) in enumerate(rows)), key=repr)


def edited(rng, words, most):
    w = list(words)
    for _ in range(rng.randint(0, most)):
        k = rng.randrange(len(w))
        w[k : k + rng.randint(0, 2)] = [f"e{rng.randint(0, 900)}"] * rng.randint(0, 2)
    return w


@pytest.mark.parametrize("more", [{}, {"large": 6}, {"large": 25}, {"heavy": 3000}])
def test_null_and_repeated_ids_and_large_groups(spark, more):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = [(rng.choice([None, k % 40, 100 + k]), " ".join(edited(rng, base, 9))) for k in range(90)]
    # one boilerplate that texts of many sizes share, without any links
    plate = [f"p{k}" for k in range(60)]
    rows += [(300 + k, " ".join(plate + [f"q{k}_{i}" for i in range(14 + 3 * k)])) for k in range(30)]
    # near copies on both sides of a size step
    rows += [(400 + k, " ".join(f"z{i}" for i in range(100 + k))) for k in range(12)]
    rows += [(None, None), (None, ""), (5, " "), (5, "one two"), (6, "One  two"), (None, rows[0][1])]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, n int, cls string")
    assert sorted(map(tuple, ngram_join.join(df, **more).collect()), key=repr) == brute(rows)


def test_chains_keep_linked_sets_together():
    rng = np.random.default_rng(4)
    for _ in range(60):
        m = int(rng.integers(2, 60))
        key, n = rng.integers(0, 4, m).astype(np.uint64), rng.integers(1, 60, m)
        place = np.minimum(rng.integers(0, 30, m), n - 1)
        most, owner = 175 * (n - place) // 75 - n, np.arange(m)
        o, tied = ngram_join.thinned(key, n, most, owner)
        a, b = ngram_join.chains(key[o], n[o], most[o], owner[o])
        up = list(range(m))

        def top(i):
            while up[i] != i:
                i = up[i]
            return i

        for x, y in [*zip(*tied), *zip(a, b)]:
            up[top(int(x))] = top(int(y))
        for x in range(m):
            for y in range(x):
                if key[x] == key[y] and min(n[x], n[y]) * 100 >= 75 * max(n[x], n[y]) and n[x] <= most[y] and n[y] <= most[x]:
                    assert top(x) == top(y)
    # a list of very many entries goes on as one for each size and bound
    o, _ = ngram_join.thinned(np.zeros(5000, np.uint64), np.full(5000, 9), np.full(5000, 10), np.arange(5000))
    assert len(o) == 1


def test_roots():
    from tidemark.llm.common import roots

    rng = np.random.default_rng(3)
    for m in (0, 1, 5, 60):
        a, b = rng.integers(0, 40, m), rng.integers(0, 40, m)
        least = {int(x): int(x) for x in [*a, *b]}
        for _ in range(50):
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        assert dict(zip(*(v.tolist() for v in roots(a, b)))) == {x: y for x, y in least.items() if x != y}
    x = np.arange(5000)
    assert set(roots(x[:-1], x[1:])[1].tolist()) == {0}
