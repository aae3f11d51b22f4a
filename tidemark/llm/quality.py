"""A quality classifier learned from trusted positives and unlabelled text.

The risk that training minimises is the non-negative unbiased one: ``p R+(positives) + max(0,
R-(unlabelled) - p R-(positives))`` under logistic loss, with p the class prior; where the second term
falls below zero the step goes the other way. Unlabelled text is a sample of all documents, and gives the class
prior too (``estimate_prior``), whether negatives are labelled or not.

Features are figures of whole texts (kinds of characters, words, lines, repetition, compressibility) and their
content: words, and pairs of neighbours, hashed to ``BUCKETS`` shares of a text each. All go
through one small hidden layer. Labels, language, source and id are never features. They are computed
once for each document, in one pass over the texts; the model is fitted on bounded samples
(``sample_rows`` of each kind, those with the smallest id hashes) and scores every document.

Defined results: null and empty texts have features 0 and a score like any other. Without positives to
learn from every score is 1. Repeated labels of a document count once, the larger one. Repeated rows are
scored each.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, span_view, utf8
from .counting import Words

SAMPLE_ROWS = 10_000
HIDDEN = 24
STEPS = 300
SEED = 7

#: Kinds of characters, by byte.
KINDS = [
    b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\n\r", b"\t\x0b\x0c", b".", b",", b";:", b"!", b"?", b"|",
    b"#$%&*", b"@", b"<>{}[]()", b"/\\_=+~^`", b"-", b"'\"", bytes(range(9)) + bytes(range(14, 32)) + b"\x7f", bytes(range(128, 256)),
]
_KIND = np.zeros((256, len(KINDS)))
for _k, _bytes in enumerate(KINDS):
    _KIND[list(_bytes), _k] = 1
FIGURES = len(KINDS) + 12
#: Buckets of hashed words, and as many of hashed pairs.
BUCKETS = 64
WIDTH = FIGURES + 2 * BUCKETS
#: Content varies with the subject more than with quality: a bucket counts for so much less than a figure.
CONTENT_SCALE = 6.0


def features(text: bytes) -> np.ndarray:
    """Figures of one whole text."""
    out = np.zeros(FIGURES)
    if not text:
        return out
    n = len(text)
    hist = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    out[: len(KINDS)] = np.sqrt(hist @ _KIND / n)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x]
    k = len(KINDS)
    p = hist[hist > 0] / n
    out[k], out[k + 1] = np.log1p(n), -(p * np.log2(p)).sum()
    if words:
        seen = Counter(words)
        lengths = sum(map(len, words)) / len(words)
        out[k + 2 : k + 8] = np.log1p(len(words)), lengths, len(seen) / len(words), max(seen.values()) / len(words), np.log1p(len(words) / len(seen)), sum(c for c in seen.values() if c > 1) / len(words)
    if lines:
        out[k + 8 : k + 11] = len(set(lines)) / len(lines), np.log1p(len(words) / len(lines)), np.log1p(len(lines))
    out[k + 11] = min(2.0, len(zlib.compress(text, 1)) / n)
    return out


def content(texts: pa.Array) -> np.ndarray:
    """Of each text, the roots of its words' and pairs' shares that fall into each bucket."""
    raw, at = span_view(texts)
    words, docs = Words(raw, at), len(texts)
    n = np.maximum(np.diff(words.first), 1)[:, None]
    out = []
    for k in (1, 2):
        h = words.chained(k)
        own = words.text[: len(h)]
        whole = words.text[k - 1 :] == own if len(h) else np.zeros(0, bool)
        place = own[whole] * BUCKETS + (h[whole] % np.uint64(BUCKETS)).astype(np.int64)
        out.append(np.sqrt(np.bincount(place, minlength=docs * BUCKETS).reshape(docs, BUCKETS) / n))
    return np.hstack(out)


def featurize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, x`` for each row, and the columns that ``carry`` names, as ``carried_<name>``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                x = np.hstack([np.stack([features(t) for t in part.column(1).to_pylist()]), content(part.column(1))])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, WIDTH), pa.int32()), pa.array(x.ravel().astype(np.float32)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, *part.columns[2:]], names=["doc_id", "x", *names])

    names = [f"carried_{c}" for c in carry]
    ddl = "doc_id long, x array<float>" + "".join(f", `carried_{c}` {df.schema[c].dataType.simpleString()}" for c in carry)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"), *[F.col(c).alias(n) for c, n in zip(carry, names)]).mapInArrow(run, ddl)


class Net:
    """One hidden layer; the output is the log-odds of quality."""

    def __init__(self, x: np.ndarray, seed: int = SEED, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        self.scale[FIGURES:] *= CONTENT_SCALE
        self.p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
        self.m, self.v, self.t = [np.zeros_like(a) for a in self.p], [np.zeros_like(a) for a in self.p], 0

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def odds(self, z: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.tanh(z @ self.p[0] + self.p[1])
        return h @ self.p[2] + self.p[3], h

    def step(self, z: np.ndarray, h: np.ndarray, d: np.ndarray, rate: float = 0.01, decay: float = 1e-4) -> None:
        """One step of Adam along the gradient d of the risk by each row's log-odds."""
        back = np.outer(d, self.p[2]) * (1 - h * h)
        grads = [z.T @ back + decay * self.p[0], back.sum(0), h.T @ d + decay * self.p[2], np.array([d.sum()])]
        self.t += 1
        for i, g in enumerate(grads):
            self.m[i] = 0.9 * self.m[i] + 0.1 * g
            self.v[i] = 0.999 * self.v[i] + 0.001 * g * g
            self.p[i] = self.p[i] - rate * (self.m[i] / (1 - 0.9**self.t)) / (np.sqrt(self.v[i] / (1 - 0.999**self.t)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.odds(self.scaled(x))[0])


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(a, -40, 40)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = STEPS, seed: int = SEED) -> Net:
    """Minimises the non-negative risk over full batches, so that a fit can be repeated exactly."""
    both = np.concatenate([positive, unlabelled])
    net = Net(both, seed)
    z, n = net.scaled(both), len(positive)
    for k in range(steps):
        g, h = net.odds(z)
        s = _sigmoid(g)
        loss_minus = np.logaddexp(0, g)  # of calling a row negative when it's positive by its odds
        negative_part = loss_minus[n:].mean() - prior * loss_minus[:n].mean()
        d_plus, d_minus = np.zeros(len(g)), np.zeros(len(g))
        d_plus[:n] = prior * (s[:n] - 1) / n
        d_minus[:n], d_minus[n:] = -prior * s[:n] / n, s[n:] / (len(g) - n)
        d = d_plus + d_minus if negative_part >= 0 else -d_minus
        net.step(z, h, d, rate=0.01 if k < steps * 2 // 3 else 0.002)
    return net


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, seed: int = SEED, rounds: int = 2) -> float:
    """The positives' share of the unlabelled rows.

    Above a score that most positives reach stand few others, so the unlabelled rows there, over the positives there, are
    that share. Scores are of models fitted on the other half of the rows: first of labelled against unlabelled, then,
    ``rounds`` times, of the risk with the share found so far.
    """
    rng = np.random.default_rng(seed)
    own, other = rng.permutation(len(positive)) % 2, rng.permutation(len(unlabelled)) % 2
    if len(positive) < 2 or len(unlabelled) < 2:
        return 1.0
    prior = None
    for _ in range(1 + rounds):
        ratios = []
        for side in (0, 1):
            p, u = positive[own == side], unlabelled[other == side]
            net = _against(p, u, seed) if prior is None else fit(p, u, min(0.99, max(0.05, prior)), 200, seed)
            p, u = net.score(positive[own != side]), net.score(unlabelled[other != side])
            ratios += [(u >= t).mean() / (p >= t).mean() for t in np.quantile(p, (0.05, 0.1, 0.15, 0.2))]
        prior = float(min(1.0, np.mean(ratios)))
    return prior


def _against(positive: np.ndarray, unlabelled: np.ndarray, seed: int) -> Net:
    """How probable a label is."""
    both = np.concatenate([positive, unlabelled])
    net, y = Net(both, seed), np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    z = net.scaled(both)
    for _ in range(150):
        g, h = net.odds(z)
        net.step(z, h, (_sigmoid(g) - y) / len(y))
    return net


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample_rows: int = SAMPLE_ROWS, seed: int = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of df, and the columns that ``carry`` names, as ``carried_<name>``."""
    x = cut_lineage(featurize(df, id_col, text_col, carry))
    more = [f"carried_{c}" for c in carry]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(~held_out() & F.col("doc_id").isNotNull() & F.col("y").isNotNull())
    known = known.groupBy("doc_id").agg(F.max("y").alias("y"))
    by_hash = [F.xxhash64("doc_id", F.lit(seed)), "doc_id"]
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}

    def smallest(rows: DataFrame, count: int) -> np.ndarray:
        """The rows with the smallest hashes. A bound on the hash goes first, so that each task brings only its share of them."""
        if count > 2 * sample_rows:
            rows = rows.where(F.xxhash64("doc_id", F.lit(seed)) < int(-(1 << 63) + (1 << 64) * 1.5 * sample_rows / count))
        return _matrix(rows.orderBy(*by_hash).limit(sample_rows))

    positive = smallest(x.join(known.where("y = 1"), "doc_id", "left_semi"), counts.get(1, 0))
    unlabelled = smallest(x, x.count())
    if not len(positive):
        scored = x.select("doc_id", F.lit(1.0).alias("score"), *more)
    else:
        prior = estimate_prior(positive, unlabelled, seed)
        net = fit(positive, unlabelled, min(0.99, max(0.05, prior)), seed=seed)
        scored = _scored(x, net, more)
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), *more)


def _matrix(rows: DataFrame) -> np.ndarray:
    """A bounded sample's features, in the driver."""
    got = [r["x"] for r in rows.select("x").collect()]
    return np.array(got, np.float64).reshape(-1, WIDTH)


def _scored(x: DataFrame, net: Net, more: list[str]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(net.score(flat.astype(np.float64))), *batch.columns[2:]], names=["doc_id", "score", *more])

    kinds = "".join(f", `{c}` {x.schema[c].dataType.simpleString()}" for c in more)
    return x.select("doc_id", "x", *more).mapInArrow(run, "doc_id long, score double" + kinds)
