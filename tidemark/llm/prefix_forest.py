"""Approximate nearest neighbours by inner product: a forest of hash prefixes over blocks of vectors.

Vectors are dealt over blocks of bounded size, a task each. In a block, each tree gives every vector a long string of
hash bits and keeps the strings sorted; a prefix is then a slice of the array. A query goes down each tree to its longest matching
prefix, and comes up in all trees together, one bit a time, until the slices hold
``least`` entries and ``share`` times as many as the block has vectors; what they hold is scored exactly. Inner products
are turned into angles first: vectors are divided by the block's largest norm and get one more component
that makes them unit vectors.

The queries are a stated set against all rows, in blocks: each visits every block, and keeps its best few of each.
These meet in two steps, so that no task gathers more than the square root of the number of blocks a query. Equal vectors of a block are
one entry of the trees, so that a vector with very many copies doesn't use up the candidates.

Recall against brute force and the share of rows that are scored (``candidates``) depend on the data; the README has both, for
random directions, where near vectors are hardly nearer than others, and for clusters.

Defined results: vectors that are null, zero, or hold a null or non-finite component take no part. Only
vectors of one length meet. Rows with the query's own id are no candidates. With fewer candidates than
asked for all are returned; an empty table returns nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NEAREST = 20
TREES = 512
BITS = 24
SHARE = 0.2
LEAST = 1400
BLOCK_ROWS = 16_384
EVERY = 20
SEED = 7
BATCH = 256


class Forest:
    def __init__(self, ids: np.ndarray, vectors: np.ndarray, nearest: int = NEAREST, trees: int = TREES, bits: int = BITS, share: float = SHARE, least: int = LEAST, seed: int = SEED):
        flat = np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel()
        order = np.lexsort((ids, np.unique(flat, return_inverse=True)[1]))
        flat, ids = flat[order], ids[order]
        new = np.ones(len(ids), bool)
        new[1:] = flat[1:] != flat[:-1]
        first = np.flatnonzero(new)
        self.x = vectors[order][first]
        # of equal vectors only the smallest ids can be among a query's nearest; one may be the query itself
        rank = np.arange(len(ids)) - np.repeat(first, np.diff(np.append(first, len(ids))))
        kept = rank <= nearest
        self.owner, self.ids = (np.cumsum(new) - 1)[kept], ids[kept]
        self.begin = np.searchsorted(self.owner, np.arange(len(first) + 1))
        self.nearest, self.trees, self.bits = nearest, trees, bits
        n, d = self.x.shape
        self.wanted = least + share * n
        norm = np.sqrt((self.x * self.x).sum(1))
        top = norm.max()
        lifted = np.hstack([self.x / top, np.sqrt(np.maximum(0, 1 - (norm / top) ** 2))[:, None]])
        self.coarse = (self.x / top).astype(np.float32)
        self.planes = np.random.default_rng([seed, d]).standard_normal((d + 1, trees * bits))
        codes = self._codes(lifted)
        self.order, self.sorted = np.empty(codes.shape, np.int32), codes
        for t in range(trees):
            self.order[t] = np.argsort(codes[t], kind="stable")
            self.sorted[t] = codes[t][self.order[t]]

    def _codes(self, x: np.ndarray) -> np.ndarray:
        """A string of bits, as a number, for each tree and vector."""
        out = np.empty((self.trees, len(x)), np.int32)
        weights = (1 << np.arange(self.bits, dtype=np.int32))[::-1]
        for t in range(self.trees):
            out[t] = (x @ self.planes[:, t * self.bits : (t + 1) * self.bits] > 0) @ weights
        return out

    def _at(self, codes: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query the slice of the query's prefix of so many bits."""
        a, b = np.empty(codes.shape, np.int64), np.empty(codes.shape, np.int64)
        shift = self.bits - depth
        for t in range(self.trees):
            head = codes[t] >> shift << shift
            a[t], b[t] = np.searchsorted(self.sorted[t], head), np.searchsorted(self.sorted[t], head + ((1 << shift) - 1).astype(np.int32), "right")
        return a, b

    def _slices(self, q: np.ndarray, wanted: float) -> tuple[np.ndarray, np.ndarray]:
        """For each tree and query its slice when all trees together hold enough.

        Slices only grow on the way up from the longest match, so the last step up is found by bisection.
        """
        codes = self._codes(np.hstack([q, np.zeros((len(q), 1))]))
        low, high = np.zeros(len(q), np.int32), np.full(len(q), self.bits + 1, np.int32)  # enough at low, or the root; too few at high
        while (high - low > 1).any():
            middle = (low + high) // 2
            a, b = self._at(codes, middle)
            enough = (b - a).sum(0) >= wanted
            low, high = np.where(enough, middle, low), np.where(enough, high, middle)
        a, b = self._at(codes, low)
        x, y = self._at(codes, np.minimum(high, self.bits))
        y = np.where(high > self.bits, x, y)  # below the longest strings there is nothing
        # the last step up is taken by tree after tree, as far as it must
        was = y - x
        more = b - a - was
        up = was.sum(0) + np.cumsum(more, 0) - more < wanted
        return np.where(up, a, x), np.where(up, b, y)

    def _held(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The vectors that a slice of each tree holds."""
        mask = np.zeros(len(self.x), bool)
        n = hi - lo
        ends = np.cumsum(n)
        at = np.repeat(lo + np.arange(self.trees) * len(self.x) - (ends - n), n) + np.arange(ends[-1])
        mask[self.order.ravel()[at]] = True
        return np.flatnonzero(mask)

    def search(self, query_ids: np.ndarray, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        """For each query its nearest candidates' ids and scores, nearest first, and how many vectors were scored."""
        lo, hi = self._slices(q, self.wanted)
        size = np.sqrt((q * q).sum(1))
        for i, own in enumerate(query_ids.tolist()):
            found, wanted = self._held(lo[:, i], hi[:, i]), self.wanted
            while len(found) <= self.nearest < len(self.x):  # all trees hold the same few: further up
                wanted *= 2
                found = self._held(*(x[:, 0] for x in self._slices(q[i : i + 1], wanted)))
            scored = len(found)
            rough = self.coarse[found] @ (q[i] / size[i]).astype(np.float32)
            k = self.nearest + 1
            if len(found) > k:  # a margin for the coarse scores' rounding, then exact ones, summed alike for all
                cut = np.partition(rough, len(rough) - k)[len(rough) - k]
                found = found[rough >= cut - 1e-5]
            score = (self.x[found] * q[i]).sum(1)
            n = self.begin[found + 1] - self.begin[found]
            at = np.repeat(self.begin[found] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            ids, score = self.ids[at], np.repeat(score, n)
            other = ids != own
            ids, score = ids[other], score[other]
            best = np.lexsort((ids, -score))[: self.nearest]
            yield ids[best], score[best], scored


def usable(vector: Column) -> Column:
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def _keys(spark: SparkSession, blocks: int) -> list[int]:
    """A number for each block whose hash deals it to a partition of its own."""
    found = spark.range(30 * blocks + 100).groupBy(F.pmod(F.hash("id"), F.lit(blocks)).alias("p")).agg(F.min("id").alias("k")).collect()
    keys = {r["p"]: r["k"] for r in found}
    return [keys.get(b, -1 - b) for b in range(blocks)]


def search(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", queries: DataFrame | None = None, every: int = EVERY, nearest: int = NEAREST, trees: int = TREES, bits: int = BITS, share: float = SHARE, least: int = LEAST, block_rows: int = BLOCK_ROWS, seed: int = SEED) -> DataFrame:
    """``query_id, rank, vec_id, score, candidates``; the last tells how many vectors were scored for the query.

    Queries are the rows whose id ``every`` divides, unless a table of them is given.
    """
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    asked = rows.where(F.col("vec_id") % every == 0) if queries is None else queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.coalesce(usable(F.col("v")), F.lit(False)))
    blocks = max(1, -(-rows.count() // block_rows))
    keys = F.array(*[F.lit(int(k)).cast("long") for k in _keys(df.sparkSession, blocks)])
    stored = rows.select(F.element_at(keys, F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int") + 1).alias("block"), F.size("v").alias("dim"), F.lit(0).alias("query"), "vec_id", "v")
    sent = asked.select(F.explode(keys).alias("block"), F.size("v").alias("dim"), F.lit(1).alias("query"), "vec_id", "v")
    dealt = stored.unionByName(sent).repartition(blocks, "block").sortWithinPartitions("block", "dim", "query")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, ids, vectors, forest = None, [], [], None
        for batch in batches:
            for lot in _lots(batch):
                if lot[0] != key:
                    key, ids, vectors, forest = lot[0], [], [], None
                if not lot[1]:
                    ids.append(lot[2])
                    vectors.append(lot[3])
                    continue
                if forest is None and ids:
                    forest, ids, vectors = Forest(np.concatenate(ids), np.concatenate(vectors), nearest, trees, bits, share, least, seed), [], []
                if forest is None:
                    continue
                for at in range(0, len(lot[2]), BATCH):
                    qi, q = lot[2][at : at + BATCH], lot[3][at : at + BATCH]
                    got = list(forest.search(qi, q))
                    n = [len(i) for i, _, _ in got]
                    scored = np.zeros(sum(n), np.int64)
                    scored[(np.cumsum(n) - n)[np.array(n) > 0]] = [k for i, _, k in got if len(i)]  # told once
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(scored), key[0])), pa.array(np.repeat(qi, n)), pa.array(np.concatenate([i for i, _, _ in got])), pa.array(np.concatenate([s for _, s, _ in got])), pa.array(scored)], names=["block", "query_id", "vec_id", "score", "scored"])

    best = dealt.mapInArrow(run, "block long, query_id long, vec_id long, score double, scored long")
    # only the best few of each block meet, some blocks at a time
    near = F.struct((-F.col("score")).alias("s"), "vec_id", "score")
    step = F.slice(F.array_sort(F.collect_list(near)), 1, nearest).alias("b")
    lots = int(np.ceil(np.sqrt(blocks)))
    if lots > 1:
        best = best.groupBy("query_id", F.pmod(F.xxhash64("block"), F.lit(lots)).alias("lot")).agg(step, F.sum("scored").alias("scored"))
        best = best.select("query_id", "scored", F.posexplode("b").alias("at", "b")).select("query_id", F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"), F.when(F.col("at") == 0, F.col("scored")).otherwise(0).alias("scored"))
    best = best.groupBy("query_id").agg(step, F.sum("scored").alias("candidates"))
    best = best.select("query_id", "candidates", F.posexplode("b").alias("rank", "b"))
    return best.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"), "candidates")


def _lots(batch: pa.RecordBatch) -> Iterator[tuple]:
    """Stretches of a batch with one block, dimension and kind: key, is query, ids, vectors."""
    block, dim, query, ids = (batch.column(i).to_numpy() for i in range(4))
    if not len(ids):
        return
    change = np.flatnonzero((np.diff(block) != 0) | (np.diff(dim) != 0) | (np.diff(query) != 0)) + 1
    for a, b in zip([0, *change], [*change, len(ids)]):
        flat = batch.column(4).slice(a, b - a).flatten().to_numpy()
        yield (int(block[a]), int(dim[a])), bool(query[a]), ids[a:b], flat.reshape(b - a, int(dim[a]))
