"""The classifier: prior, content, odd rows, carried columns; against a plain second computation of its features."""

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import quality
from tidemark.llm.counting import Words
from tidemark.llm.common import span_view


def plain(text):
    """Shares of words and pairs by bucket, one word at a time."""
    hashed = lambda x, n: int(Words(*span_view(pa.array([x.encode()], pa.binary()))).chained(n)[0]) % quality.BUCKETS
    words = text.split()
    out = np.zeros(2 * quality.BUCKETS)
    for k in (1, 2):
        for i in range(len(words) - k + 1):
            out[(k - 1) * quality.BUCKETS + hashed(" ".join(words[i : i + k]), k)] += 1 / len(words)
    return np.sqrt(out)


def test_content_features():
    texts = ["the cat sat on the mat", "", "one", "Über der the The cat", "x " * 50]
    got = quality.content(pa.array([t.encode() for t in texts], pa.binary()))
    for t, g in zip(texts, got):
        assert np.allclose(g, plain(t))
    raw = b"a bb a\nc"
    f = quality.features(raw)
    k = len(quality.KINDS)
    counts = Counter(raw)
    assert math.isclose(f[k + 1], -sum(c / 8 * math.log2(c / 8) for c in counts.values())) and math.isclose(f[k + 4], 3 / 4)


@pytest.mark.parametrize("share", [0.3, 0.6, 0.85])
def test_prior_from_unlabelled_rows(share):
    rng = np.random.default_rng(5)
    positive, n = rng.normal(1, 1, (1500, 4)), 4000
    web = np.concatenate([rng.normal(1, 1, (int(n * share), 4)), rng.normal(-1.5, 1, (n - int(n * share), 4))])
    assert abs(quality.estimate_prior(positive, web) - share) < 0.06


def test_odd_rows(spark):
    """Null and repeated ids, repeated labels, ties, a very long text, and columns whose names clash."""
    good = "the quiet river runs past old houses and people walk along it in the evening. "
    rows = [(k, good * (1 + k % 4)) for k in range(60)] + [(100 + k, "@@ ## $$ 1234 || " * 9) for k in range(20)]
    rows += [(None, good), (None, "## ##"), (7, good * 3), (7, "## ##"), (200, None), (201, ""), (202, good * 20_000)]
    df = spark.createDataFrame([(d, t, 1, "z", k) for k, (d, t) in enumerate(rows)], "doc_id long, text string, y int, x string, place int")
    labels = [(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(20)] + [(0, 1), (0, 0), (None, 1), (3, None)]
    got = quality.classify(df, spark.createDataFrame(labels, "doc_id long, quality int"), carry=("place",)).collect()
    assert sorted(r.carried_place for r in got) == list(range(len(rows)))
    by = {r.carried_place: r for r in got}
    for k, (d, _) in enumerate(rows):
        assert by[k].doc_id == d and 0 <= by[k].score <= 1 and by[k].predicted == (by[k].score >= 0.5)
        assert by[k].held_out == (d is not None and zlib.crc32(str(d).encode()) % 3 == 1)
    same = {}
    for k, (_, t) in enumerate(rows):
        assert same.setdefault(t or "", by[k].score) == by[k].score  # a score is of the text alone
    assert np.mean([by[k].predicted for k in range(60)]) > 0.9 and np.mean([by[60 + k].predicted for k in range(20)]) < 0.2


def test_held_out_labels_are_never_read(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({(r.doc_id, r.score) for r in quality.classify(docs, x).collect()} for x in (labels, turned))
    assert a == b
