"""Counts of hashed keys over a whole corpus, brought back to where the keys came from.

Documents are dealt over parts by id. Each part sends its distinct keys, with how often it has them, to
buckets by key range; a bucket sums them over all parts and answers each part in the order it was asked.
Keys are ``bits`` wide and travel as differences of sorted values. Both exchanges are bounded by their
numbers of parts and buckets, which follow ``spark.sql.shuffle.partitions``; a frequent key is one row
for each part, so no task gathers its occurrences. Counts travel as 32 bits; the few that these don't
hold go along as 64 bits, so that each is answered as it is.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hash_spans, mix64, pack_columns, pack_sorted, shuffle_parts, span_view, unpack_columns, unpack_sorted, utf8

_DDL = "to int, source int, keys binary, counts binary"
_TYPES = [pa.int32(), pa.int32(), pa.binary(), pa.binary()]
NULL_ID = -(1 << 63)

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_GAP = np.zeros(256, bool)
_GAP[[0x20, *range(0x09, 0x0E)]] = True
CHUNK = 1_000_000
#: Stands for a count of 32 bits or more, which is given by itself.
WIDE = (1 << 32) - 1


class Words:
    """Hashes of the words ``[^\\x20\\x09-\\x0D]+`` of texts that lie end to end, A-Z lower-cased."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        starts = np.zeros(len(raw) + 1, bool)
        starts[at] = True
        hashes, places, a = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], 0
        while a < len(raw):  # up to where a text or a gap begins, as no word goes on there
            b = min(len(raw), a + CHUNK)
            while b < len(raw):
                near = raw[b : b + 4096]
                cut = np.flatnonzero(starts[b : b + len(near)] | _GAP[near])
                if len(cut):
                    b += int(cut[0])
                    break
                b = min(len(raw), b + 4096)
            h, p = self._hash(raw[a:b], starts[a : b + 1])
            hashes.append(h)
            places.append(p + a)
            a = b
        self.hash, place = np.concatenate(hashes), np.concatenate(places)
        self.text = np.searchsorted(at, place, "right") - 1
        self.first = np.searchsorted(place, at)  # of each text; and the number of words at the end

    @staticmethod
    def _hash(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(raw)
        raw = _LOWER[raw]
        inside = ~_GAP[raw]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1] | starts[1:n]
        ends = inside.copy()
        ends[:-1] &= ~inside[1:] | begins[1:]
        a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        return hash_spans(raw, a, b), a

    def chained(self, n: int) -> np.ndarray:
        """A hash of n neighbours for each place where n - 1 words follow."""
        k = np.uint64(0x9FB21C651E98DF25)
        h = self.hash[: max(0, len(self.hash) - n + 1)].copy()
        for i in range(1, n):
            h = h * k + self.hash[i : len(self.hash) - n + 1 + i]
        return mix64(h + np.uint64(n * 0x632BE59BD9B4E019 & (1 << 64) - 1))


class Part:
    """The documents of one part, by id and then by text."""

    def __init__(self, docs: pa.Table):
        docs = docs.combine_chunks()
        ids = docs.column("doc_id").fill_null(NULL_ID).to_numpy()
        col = docs.column("t")
        raw, at = span_view(col.chunk(0) if col.num_chunks else pa.array([], pa.binary()))
        order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):
            order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], raw[at[i] : at[i + 1]].tobytes())), np.int64)
        size = np.diff(at)[order]
        self.id = ids[order]
        self.at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        self.raw = raw[np.repeat(at[:-1][order] - self.at[:-1], size) + np.arange(self.at[-1])]

    @property
    def words(self) -> Words:
        return Words(self.raw, self.at)


def pack_counts(counts: np.ndarray) -> bytes:
    """How many wide counts there are, these, and all counts in 32 bits."""
    wide = counts[counts >= WIDE].astype(np.int64)
    return np.uint32(len(wide)).tobytes() + wide.tobytes() + pack_columns(np.minimum(counts, WIDE).astype(np.uint32))


def unpack_counts(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    counts = unpack_columns(raw[4 + 8 * n :], (np.uint32,))[0].astype(np.int64)
    counts[counts == WIDE] = np.frombuffer(raw[4:], np.int64, n)
    return counts


def dealt(df: DataFrame, id_col: str, text_col: str, parts: int) -> DataFrame:
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"))
    return docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).select("part", "doc_id", "t")


def with_counts(df: DataFrame, keys_of: Callable, use: Callable, ddl: str, id_col: str = "doc_id", text_col: str = "text", bits: int = 56) -> DataFrame:
    """For each part: ``keys_of(Part)`` gives its keys, repeated as they occur; ``use(Part, look_up)`` makes the result.

    ``look_up(keys)`` gives the corpus count of each of these keys.
    """
    buckets = shuffle_parts(df.sparkSession)
    docs = dealt(df, id_col, text_col, 2 * buckets)
    shift = np.uint64(64 - bits)

    def distinct(part: Part) -> tuple[np.ndarray, np.ndarray]:
        return np.unique(keys_of(part) >> shift, return_counts=True)

    def bucket_edges(keys: np.ndarray) -> np.ndarray:
        edges = np.array([(b << bits) // buckets for b in range(1, buckets)], np.uint64)
        return np.concatenate(([0], np.searchsorted(keys, edges), [len(keys)]))

    def begin(docs: pa.Table) -> pa.Table:
        source = docs.column("part")[0].as_py()
        keys, counts = distinct(Part(docs))
        cuts = bucket_edges(keys)
        rows = [(b, source, pack_sorted(keys[x:y]), pack_counts(counts[x:y])) for b, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])) if y > x]
        return _table(rows)

    def total(table: pa.Table) -> pa.Table:
        bucket = table.column("to")[0].as_py()
        sources = table.column("source").to_pylist()
        keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
        counts = [unpack_counts(c) for c in table.column("counts").to_pylist()]
        every, place = np.unique(np.concatenate(keys), return_inverse=True)
        summed = np.bincount(place, np.concatenate(counts)).astype(np.int64)  # sums of doubles, exact up to 2^53
        cuts = np.cumsum([0, *map(len, keys)])
        return _table([(s, bucket, b"", pack_counts(summed[place[x:y]])) for s, x, y in zip(sources, cuts[:-1], cuts[1:])])

    def finish(key: tuple, answers: pa.Table, docs: pa.Table) -> pa.Table:
        part = Part(docs)
        keys, _ = distinct(part)
        got = dict(zip(answers.column("source").to_pylist(), answers.column("counts").to_pylist()))
        counts = [unpack_counts(got[b]) for b in sorted(got)]
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        if len(counts) != len(keys):
            raise ValueError("a part changed between its two readings")
        return use(part, lambda k: counts[np.searchsorted(keys, k >> shift)] if len(keys) else np.zeros(len(k), np.int64))

    x = docs.groupBy("part").applyInArrow(begin, _DDL).groupBy("to").applyInArrow(total, _DDL)
    return x.groupBy("to").cogroup(docs.groupBy("part")).applyInArrow(finish, ddl)


def _table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array([r[i] for r in rows], t) for i, t in enumerate(_TYPES)], names=["to", "source", "keys", "counts"])
