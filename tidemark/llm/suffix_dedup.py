"""Exact removal of repeated long byte strings over all documents.

A byte goes if a string of ``threshold`` bytes that covers it also starts earlier: in a document with a
smaller id, or in the same one further left. All strings are judged on the input.

The core, ``repeats``, works on a set of byte strings: it forms their Burrows-Wheeler transform and
expands intervals breadth first by backward extension, so that common prefixes are found by increasing
length; it stops at the threshold. What no interval has parted by then shares ``threshold`` bytes.

To bring equal strings together, each window of ``threshold`` bytes gets the least hash of the ``mer``-byte
strings within it, which depends on its content alone. Runs of windows with one such key travel by key.
A key that is met once, without a repetition inside its run, holds no repeats. Of runs that are equal as
a whole the first is kept and the others are marked, within a task before the shuffle and then over all,
so that a passage of many copies doesn't gather in one task. For keys with several different runs, the
bytes are fetched from the documents and the core decides. A key with more than ``hot`` different runs is
dealt anew, each window by its own hash: then a key's runs are all alike and the rule for equal runs
settles them without gathering them.

Defined results: a null text is empty; texts under ``threshold`` bytes keep all. Rows with one id count as
documents in the order of their texts. Null ids come first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import concat_columns, hash_spans, lanes, mix64, pack_columns, shuffle_parts, span_view, split_by, utf8

THRESHOLD = 100
MER = 40
HOT = 20_000
#: Bytes that the core takes at once, and windows that are hashed at once.
BLOCK = 4_000_000
CHUNK = 1_000_000
NULL_ID = -(1 << 63)

_BASE = 0xF1357AEA2E62A9C5
_TABLE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        n = 1 << n.bit_length()
        up, down = np.ones(n, np.uint64), np.ones(n, np.uint64)
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(pow(_BASE, -1, 1 << 64))
        _POWERS[:] = [np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)]
    return _POWERS[0], _POWERS[1]


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours, by doubling."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[: len(x) - done], x[done:])
        done *= 2
    return np.minimum(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


def runs(raw: np.ndarray, at: np.ndarray, threshold: int = THRESHOLD, mer: int = MER) -> dict[str, np.ndarray]:
    """Runs of windows with one key, of the texts that lie end to end in raw from the places in at.

    key, content (a hash of the bytes that the run covers), text (number), start (within the text), windows,
    and inner: whether the key's string is met twice in the run.
    """
    none = {k: np.zeros(0, t) for k, t in (("key", np.uint64), ("content", np.uint64), ("text", np.int64), ("start", np.int64), ("windows", np.int64), ("inner", np.uint8))}
    n = len(raw)
    if n < threshold:
        return none
    up, down = _powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * up[:n], out=total[1:])
    mers = mix64((total[mer:] - total[:-mer]) * down[: n - mer + 1])
    least = _sliding_min(mers, threshold - mer + 1)
    size = np.diff(at)
    valid = np.zeros(len(least) + 1, np.int32)
    long = np.flatnonzero(size >= threshold)
    valid[at[long]] += 1
    np.add.at(valid, at[long] + size[long] - threshold + 1, -1)
    valid = np.cumsum(valid[:-1]) > 0
    begins = valid.copy()
    begins[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    begins[np.intersect1d(at[long], np.arange(len(begins)))] = True
    first = np.flatnonzero(begins)
    if not len(first):
        return none
    ends = valid.copy()
    ends[:-1] &= begins[1:] | ~valid[1:]
    last = np.flatnonzero(ends)
    key = least[first]
    # a second place of the key's string within what the run covers
    width = threshold - mer + 1
    place = np.flatnonzero(mers[: len(mers)] == _widest(least, width, len(mers)))
    follows = np.flatnonzero((mers[place[1:]] == mers[place[:-1]]) & (np.diff(place) <= width))
    inner = np.zeros(len(first), np.uint8)
    if len(follows):
        for w in (np.minimum(place[follows], len(least) - 1), np.maximum(place[follows + 1] - width + 1, 0)):
            r = np.searchsorted(first, w, "right") - 1
            for shift in (-1, 0, 1):
                q = np.clip(r + shift, 0, len(first) - 1)
                inner[q[key[q] == mers[place[follows]]]] = 1
    text = np.searchsorted(at, first, "right") - 1
    content = hash_spans(raw, first, last + threshold)
    return {"key": key, "content": content, "text": text, "start": first - at[text], "windows": last - first + 1, "inner": inner}


def _widest(least: np.ndarray, width: int, n: int) -> np.ndarray:
    """For each string, the largest key of the windows that hold it."""
    pad = np.zeros(n + width - 1, np.uint64)
    pad[width - 1 : width - 1 + len(least)] = least
    return ~_sliding_min(~pad, width)


def suffix_order(s: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of s by their first ``depth`` symbols at least, ties by place; symbols are below 512."""
    n = len(s)
    have = 7
    pad = np.zeros(n + have, np.int64)
    pad[:n] = s
    rank = np.zeros(n, np.int64)
    for i in range(have):
        rank = (rank << 9) | pad[i : i + n]
    while True:
        order = np.argsort(rank, kind="stable")
        if have >= depth:
            return order
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], sorted_rank[1:] != sorted_rank[:-1])))
        second = np.zeros(n, np.int64)
        second[: n - have] = new[have:]
        rank = new * (n + 2) + second
        have *= 2


def part_intervals(s: np.ndarray, order: np.ndarray, depth: int) -> np.ndarray:
    """Where, in suffix order, neighbours share fewer than ``depth`` symbols.

    An interval of a string w gives, by backward extension, the interval of c w for each symbol c that
    stands before it. Breadth first, the ends of the intervals of length-l strings are just the places
    whose common prefix is l - 1 symbols long, if not parted already; an interval whose end is known
    leads to nothing new and isn't followed.
    """
    n = len(s)
    before = s[order - 1]  # the transform; the first suffix is preceded by the last symbol
    symbols = int(s.max()) + 1
    counts = np.bincount(s, minlength=symbols)
    below = np.concatenate(([0], np.cumsum(counts)[:-1]))
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, np.int64)  # where the suffix that begins one symbol earlier stands, up to equal ones
    step[by_symbol] = np.arange(n)
    parted = np.zeros(n + 1, bool)
    parted[0] = parted[n] = True
    lo, hi = np.array([0]), np.array([n])
    for length in range(depth):
        if not len(lo):
            break
        size = hi - lo
        at = np.repeat(lo - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
        which = np.repeat(np.arange(len(lo)), size)
        c = before[at].astype(np.int64)
        tag = which * symbols + c
        o = np.argsort(tag, kind="stable") if length < 3 or size.max() > 1 else np.arange(len(tag))
        tag, target = tag[o], step[at[o]]
        head = np.flatnonzero(np.concatenate(([True], tag[1:] != tag[:-1])))
        tail = np.concatenate((head[1:], [len(tag)])) - 1
        new_lo, new_hi = target[head], target[tail] + 1
        fresh = ~parted[new_hi]
        new_lo, new_hi = new_lo[fresh], new_hi[fresh]
        new_hi, one = np.unique(new_hi, return_index=True)
        parted[new_hi] = True
        lo, hi = new_lo[one], new_hi
    return parted[:n]


def repeats(texts: list[bytes], threshold: int = THRESHOLD) -> list[np.ndarray]:
    """For each text, which of its windows also start earlier: in a text before it, or further left."""
    sizes = np.array([len(t) for t in texts], np.int64)
    at = np.concatenate(([0], np.cumsum(sizes + 1)))
    s = np.zeros(int(at[-1]), np.int64)
    keep = np.ones(len(s), bool)
    keep[at[1:] - 1] = False
    s[keep] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + 1
    later = np.zeros(len(s), bool)
    if len(s) > threshold:
        order = suffix_order(s, threshold)
        group = np.cumsum(part_intervals(s, order, threshold))
        earliest = np.full(group[-1] + 1, len(s))
        np.minimum.at(earliest, group, order)
        later[order] = order > earliest[group]
    return [later[a : a + max(0, n - threshold + 1)] for a, n in zip(at[:-1].tolist(), sizes.tolist())]


# How the steps below pack rows for the shuffle. A document is known by the part that holds it and its
# place there; parts deal documents by id, so that (id, place) orders all documents.
_CANDIDATE = (np.uint64, np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32, np.uint8)  # key, content, id, part, place, start, windows, inner
_MARK = (np.uint32, np.uint32, np.uint32)  # place, start, windows
_REQUEST = (np.uint64, np.int64, np.uint32, np.uint32, np.uint32)  # key, id, place, start, windows
_FRAME = (np.uint64, np.int64, np.uint32, np.uint32, np.uint32, np.uint32)  # key, id, part, place, start, bytes
_MARKS, _FETCH, _SPLIT, _FRAMES, _WINDOWS, _TEXTS = range(6)
_ROWS = pa.schema([("to", pa.int32()), ("kind", pa.int32()), ("payload", pa.binary()), ("extra", pa.binary())])
_ROW_DDL = "to int, kind int, payload binary, extra binary"


def _rows(found: list[tuple[int, int, bytes, bytes]]) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(_ROWS.types)], schema=_ROWS)


def _blobs(table: pa.Table, kind: int, column: str = "payload") -> list[bytes]:
    return table.filter(pc.equal(table.column("kind"), kind)).column(column).to_pylist()


class _Part:
    """The documents of one part in order: by id, then by text."""

    def __init__(self, docs: pa.Table):
        docs = docs.combine_chunks()
        self.ids = docs.column("doc_id")
        ids = self.ids.fill_null(NULL_ID).to_numpy()
        col = docs.column("t")
        raw, at = span_view(col.chunk(0) if col.num_chunks else pa.array([], pa.binary()))
        self.order = np.argsort(ids, kind="stable")
        if len(np.unique(ids)) < len(ids):
            text = lambda i: raw[at[i] : at[i + 1]].tobytes()
            self.order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], text(i))), np.int64)
        self.id = ids[self.order]
        size = np.diff(at)[self.order]
        self.at = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
        self.raw = raw[np.repeat(at[:-1][self.order] - self.at[:-1], size) + np.arange(self.at[-1])] if (np.diff(self.order) != 1).any() else raw

    def stretches(self, threshold: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Bytes, places in them, documents and first windows, some CHUNK at a time; a long text goes in overlapping stretches."""
        i, n = 0, len(self.at) - 1
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.at, self.at[i] + CHUNK, "right")) - 1)
            a, b = int(self.at[i]), int(self.at[j])
            if j == i + 1 and b - a > 2 * CHUNK:
                for s in range(a, b - threshold + 1, CHUNK):
                    e = min(b, s + CHUNK + threshold - 1)
                    yield self.raw[s:e], np.array([0, e - s]), np.array([i]), np.array([s - a])
            else:
                yield self.raw[a:b], self.at[i : j + 1] - a, np.arange(i, j), np.zeros(j - i, np.int64)
            i = j


def _settle(key, content, doc, place, start) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by key, content and document; where a key begins in it; where an equal run begins."""
    o = np.lexsort((start, place, doc, content, key))
    k, c = key[o], content[o]
    new_key = np.concatenate(([True], k[1:] != k[:-1])) if len(o) else np.zeros(0, bool)
    new_run = new_key | np.concatenate(([True], c[1:] != c[:-1])) if len(o) else np.zeros(0, bool)
    return o, new_key, new_run


def _candidates(part: int, doc, rows: dict[str, np.ndarray], buckets: int, kind: int) -> list[tuple[int, int, bytes, bytes]]:
    """Sends the first of equal runs to the key's bucket; the others are marked already."""
    o, _, new = _settle(rows["key"], rows["content"], doc, rows["place"], rows["start"])
    out, again = [], o[~new]
    if len(again):
        out.append((-1 - part, _MARKS, pack_columns(*(rows[c][again].astype(np.uint32) for c in ("place", "start", "windows"))), b""))
    o = o[new]
    for bucket, at in split_by((rows["key"][o] % np.uint64(buckets)).astype(np.int64)):
        q = o[at]
        out.append((bucket, kind, pack_columns(rows["key"][q], rows["content"][q], doc[q].astype(np.int64), np.full(len(q), part, np.uint32), *(rows[c][q].astype(np.uint32) for c in ("place", "start", "windows")), rows["inner"][q].astype(np.uint8)), b""))
    return out


def _window_hashes(raw: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of every window, eight bytes a step; the last step overlaps the one before it."""
    n = len(raw) - size + 1
    view = lanes(raw)
    steps = [*range(0, size - 7, 8), size - 8] if size >= 8 else [0]
    out = []
    for seed in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        h = np.full(n, seed, np.uint64)
        for k in steps:
            h = mix64(h ^ (view[k : k + n] if size >= 8 else view[:n] & np.uint64((1 << 8 * size) - 1)))
        out.append(h)
    return out[0], out[1]


def _reduce(table: pa.Table, hot: int, block: int, threshold: int) -> list[tuple[int, int, bytes, bytes]]:
    """Candidates of one bucket: marks for all but the first of equal runs, and requests where a key has more to settle."""
    key, content, doc, part, place, start, windows, inner = concat_columns(_blobs(table, _WINDOWS), _CANDIDATE)
    o, new_key, new_run = _settle(key, content, doc, place, start)
    out = []
    again = o[~new_run]
    for p, at in split_by(part[again]):
        out.append((p, _MARKS, pack_columns(place[again[at]], start[again[at]], windows[again[at]]), b""))
    group = np.cumsum(new_key)[new_run] - 1 if len(o) else np.zeros(0, int)
    o = o[new_run]
    if len(o):
        n = np.bincount(group)
        size = np.bincount(group, windows[o].astype(np.float64) + threshold - 1)
        wanted = (n > 1) | (np.bincount(group, inner[o]) > 0)
        large = wanted & ((n > hot) | (size > block))
        for kind, which in ((_FETCH, wanted & ~large), (_SPLIT, large)):
            q = o[which[group]]
            for p, at in split_by(part[q]):
                r = q[at]
                out.append((p, kind, pack_columns(key[r], doc[r], place[r], start[r], windows[r]), b""))
    return out


def _fetch(part: int, asked: pa.Table, docs: pa.Table, buckets: int, threshold: int) -> list[tuple[int, int, bytes, bytes]]:
    """The bytes of the runs that were asked for, to their key's bucket; of hot keys, each window by its own hash."""
    out = [(-1 - part, _MARKS, b, b"") for b in _blobs(asked, _MARKS)]
    fetch, split = _blobs(asked, _FETCH), _blobs(asked, _SPLIT)
    if not fetch and not split:
        return out
    here = _Part(docs)
    key, doc, place, start, windows = concat_columns(fetch, _REQUEST)
    for bucket, at in split_by((key % np.uint64(buckets)).astype(np.int64)):
        a = here.at[place[at]] + start[at]
        size = windows[at].astype(np.int64) + threshold - 1
        text = b"".join([here.raw[x : x + n].tobytes() for x, n in zip(a.tolist(), size.tolist())])
        out.append((bucket, _FRAMES, pack_columns(key[at], doc[at], np.full(len(at), part, np.uint32), place[at], start[at], size.astype(np.uint32)), text))
    key, doc, place, start, windows = concat_columns(split, _REQUEST)
    rows, held = [], 0
    for k, (d, p, s, n) in enumerate(zip(doc.tolist(), place.tolist(), start.tolist(), windows.tolist())):
        a = here.at[p] + s
        x, y = _window_hashes(here.raw[a : a + n + threshold - 1], threshold)
        rows.append((x, y, np.full(n, d), np.full(n, p), np.arange(s, s + n)))
        held += n
        if held > CHUNK or k == len(doc) - 1:
            x, y, d, p, s = (np.concatenate(c) for c in zip(*rows))
            one = np.ones(len(x), np.int64)
            out += _candidates(part, d, {"key": x, "content": y, "place": p, "start": s, "windows": one, "inner": one * 0}, buckets, _WINDOWS)
            rows, held = [], 0
    return out


def _core(table: pa.Table, block: int, threshold: int) -> list[tuple[int, int, bytes, bytes]]:
    """Runs the core over the frames of one bucket, some keys at a time."""
    texts_of = _blobs(table, _FRAMES, "extra")
    key, doc, part, place, start, size = concat_columns(_blobs(table, _FRAMES), _FRAME)
    text = b"".join(texts_of)
    at = np.concatenate(([0], np.cumsum(size.astype(np.int64))))
    o = np.lexsort((start, place, doc, key))
    marks: list[tuple[np.ndarray, ...]] = []
    i = 0
    while i < len(o):
        j, held = i, 0
        while j < len(o) and (held < block or key[o[j]] == key[o[j - 1]]):
            held += int(size[o[j]])
            j += 1
        own = o[i:j]
        for f, later in zip(own.tolist(), repeats([text[at[f] : at[f + 1]] for f in own.tolist()], threshold)):
            if later.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], later.view(np.int8), [0]))))
                a, b = edge[::2], edge[1::2]
                marks.append((np.full(len(a), part[f]), np.full(len(a), place[f]), start[f] + a, b - a))
        i = j
    out = []
    if marks:
        p, *rest = (np.concatenate(c).astype(np.uint32) for c in zip(*marks))
        for q, at in split_by(p):
            out.append((q, _MARKS, pack_columns(*(c[at] for c in rest)), b""))
    return out


def dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: int = THRESHOLD, mer: int = MER, hot: int = HOT, block: int = BLOCK, with_kept: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, the bytes that are left, ``kept``.

    ``carry`` names columns of the input that come along, as they are, as ``carried_<name>``.
    """
    spark = df.sparkSession
    buckets = shuffle_parts(spark)
    parts = 2 * buckets  # each part sends a packed row to each bucket
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t"), *[F.col(c).alias(f"carried_{c}") for c in carry])
    docs = docs.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int")).select("part", *docs.columns)
    ddl = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_kept
    ddl += "".join(f", `carried_{c}` {df.schema[c].dataType.simpleString()}" for c in carry)

    def begin(docs: pa.Table) -> pa.Table:
        part, here = docs.column("part")[0].as_py(), _Part(docs)
        found = []
        for raw, at, which, shift in here.stretches(threshold):
            r = runs(raw, at, threshold, mer)
            r["place"], r["start"] = which[r["text"]], r["start"] + shift[r["text"]]
            found.append(r)
        if not found:
            return _rows([])
        rows = {k: np.concatenate([r[k] for r in found]) for k in found[0]}
        return _rows(_candidates(part, here.id[rows["place"]], rows, buckets, _WINDOWS))

    def passed(table: pa.Table) -> list | None:
        """Marks go on to their part, untouched."""
        to = table.column("to")[0].as_py()
        return [(-1 - to, _MARKS, b, b"") for b in _blobs(table, _MARKS)] if to < 0 else None

    def reduce(table: pa.Table) -> pa.Table:
        done = passed(table)
        return _rows(_reduce(table, hot, block, threshold) if done is None else done)

    def fetch(key: tuple, asked: pa.Table, docs: pa.Table) -> pa.Table:
        return _rows(_fetch(key[0].as_py(), asked, docs, buckets, threshold) if asked.num_rows else [])

    def core(table: pa.Table) -> pa.Table:
        done = passed(table)
        return _rows(_core(table, block, threshold) + [r for r in _reduce(table, 1 << 62, 1 << 62, threshold) if r[1] == _MARKS] if done is None else done)

    def finish(key: tuple, marks: pa.Table, docs: pa.Table) -> pa.Table:
        here = _Part(docs)
        cover = np.zeros(len(here.raw) + 1, np.int32)
        if marks.num_rows:
            place, start, windows = concat_columns(_blobs(marks, _MARKS), _MARK)
            a = here.at[place] + start
            np.add.at(cover, a, 1)
            np.add.at(cover, a + windows + threshold - 1, -1)
        gone = np.cumsum(cover[:-1]) > 0
        rise = gone.copy()
        rise[1:] &= ~gone[:-1]
        edge = here.at[:-1]
        edge = edge[(edge < len(gone))]
        rise[edge] |= gone[edge]
        n_gone, n_rise = (np.concatenate(([0], np.cumsum(x)))[here.at] for x in (gone, rise))
        kept = [here.raw[a:b][~gone[a:b]].tobytes() for a, b in zip(here.at[:-1].tolist(), here.at[1:].tolist())]
        cols = [here.ids.take(pa.array(here.order)), pa.array(np.diff(here.at)), pa.array(np.diff(n_gone).astype(np.int64)), pa.array(np.diff(n_rise).astype(np.int64)), pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string())]
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if with_kept:
            cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
        for c in carry:
            cols, names = [*cols, docs.column(f"carried_{c}").take(pa.array(here.order))], [*names, f"carried_{c}"]
        return pa.table(cols, names=names)

    x = docs.groupBy("part").applyInArrow(begin, _ROW_DDL)
    x = x.groupBy("to").applyInArrow(reduce, _ROW_DDL)
    x = x.groupBy("to").cogroup(docs.groupBy("part")).applyInArrow(fetch, _ROW_DDL)
    x = x.groupBy("to").applyInArrow(core, _ROW_DDL)
    return x.groupBy("to").cogroup(docs.groupBy("part")).applyInArrow(finish, ddl)
