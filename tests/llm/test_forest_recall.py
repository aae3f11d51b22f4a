"""Recall of the forest together with the share of rows that it scores."""

import numpy as np
import pytest

from tidemark.llm import prefix_forest


def vectors(kind, n, d=64):
    rng = np.random.default_rng(6)
    if kind == "random":
        return rng.standard_normal((n, d))
    centres = rng.standard_normal((n // 80, d))
    return centres[rng.integers(0, len(centres), n)] + 0.5 * rng.standard_normal((n, d))


def measured(kind, n, queries, trees=prefix_forest.TREES, **more):
    """Recall of the 20 nearest, and share of the vectors scored, over blocks of the default size."""
    x = vectors(kind, n)
    x /= np.linalg.norm(x, axis=1)[:, None]
    asked = np.arange(0, n, max(20, n // queries // 20 * 20))
    block = np.random.default_rng(1).integers(0, -(-n // prefix_forest.BLOCK_ROWS), n)
    found, scored = [[] for _ in asked], 0
    for b in range(block.max() + 1):
        own = np.flatnonzero(block == b)
        for k, (ids, s, c) in enumerate(prefix_forest.Forest(own, x[own], trees=trees, **more).search(asked, x[asked])):
            found[k] += zip((-s).tolist(), ids.tolist())
            scored += c
    hits = 0
    for q, got in zip(asked, found):
        s = x @ x[q]
        s[q] = -9
        hits += len({i for _, i in sorted(got)[:20]} & set(np.argpartition(-s, 20)[:20].tolist()))
    return hits / (20 * len(asked)), scored / (len(asked) * n)


@pytest.mark.parametrize("kind,n,most", [("random", 2000, 0.6), ("random", 16_000, 0.25), ("clusters", 2000, 0.6), ("clusters", 16_000, 0.2)])
def test_recall_and_candidates(kind, n, most):
    recall, share = measured(kind, n, 60)
    assert recall >= 0.9 and share <= most


def test_fewer_trees_do_for_clusters():
    recall, share = measured("clusters", 16_000, 60, trees=48, share=0.1, least=100)
    assert recall >= 0.9 and share <= 0.2


def test_blocks_meet_in_steps(spark):
    x = vectors("random", 900, 8)
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in prefix_forest.search(df, block_rows=40, least=900, trees=4).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.candidates))
    assert len(got) == 45
    for q, own in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        assert [i for _, i, _ in sorted(own)] == np.lexsort((np.arange(900), -s))[:20].tolist()
        assert {c for _, _, c in own} == {900}
