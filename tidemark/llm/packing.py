"""Best-fit packing of tokenized documents into sequences.

``pieces`` tokenizes whole texts; an end id follows each document; what is longer than a sequence is cut
into full sequences and a rest. ``pack`` deals the pieces by their ids over shards of bounded size, so that
reruns agree however the input is partitioned, and packs each shard by best-fit decreasing: a segment tree over remaining capacities finds the tightest open sequence
in logarithmic time for each piece.

The tokenizer lower-cases, splits at fixed character classes and encodes each word by itself, so a word's
ids are kept in a bounded cache, and only new words are encoded; a hash finds a word there, and its bytes
are compared. That path takes what is within Latin-1; any other stretch between white space is encoded by
the tokenizer itself. Both give the tokenizer's own ids.

Defined results: a null or empty text is the end id alone. Repeated rows are packed as rows of their own.
An empty table packs into no sequences.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut_lineage, equal_spans, hash_spans, utf8

LENGTH = 4096
END_ID = 1
#: Pieces that one task packs. The last sequences of a shard are all that a split costs.
SHARD_PIECES = 50_000
CACHED_WORDS = 1_000_000
CHUNK = 2_000_000

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3


def _classes() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for b in range(256):
        c = chr(b)
        kind = unicodedata.category(c)[0]
        out[b] = _SPACE if c.isspace() and not 0x1C <= b <= 0x1F else _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    return out


CLASSES = _classes()
LOWER = bytes(ord(chr(b).lower()) if len(chr(b).lower()) == 1 and ord(chr(b).lower()) < 256 else b for b in range(256))
_STRETCHES = re.compile(r"[^ \n\t\r]+")


def _latin(text: str) -> bytes:
    """The text in Latin-1, if it takes the fast path; else a ValueError (UnicodeEncodeError is one)."""
    raw = text.encode("latin-1")
    if b"<|" in raw or len(raw.translate(None, b"\x1c\x1d\x1e\x1f")) != len(raw):
        raise ValueError
    return raw


def _is_odd(text: str) -> bool:
    try:
        _latin(text)
    except ValueError:
        return True
    return False


class WordEncoder:
    """Encodes byte strings of UTF-8 like the tokenizer in a file, with a bounded cache of words."""

    def __init__(self, path: str, cached_words: int = CACHED_WORDS):
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)
        self.words.normalizer = normalizers.Sequence([])
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.whole.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for k, i in vocab.items() if k.endswith("</w>")]] = True
        self.cached_words = cached_words
        self.clear()

    def clear(self) -> None:
        self.known, self.at, self.n, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, np.uint32)
        self.text, self.text_at = np.zeros(0, np.uint8), np.zeros(0, np.int64)  # the words themselves, as a hash may be shared

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain, held = [], 0
        mixed: dict[int, list] = {}
        for i, raw in enumerate(texts):
            text = raw.decode("utf-8", "replace")
            try:
                plain.append((i, _latin(text)))
            except ValueError:
                # white space parts words for the tokenizer too: what it must see as a whole are the stretches between
                mixed[i] = []
                for odd, own in groupby(_STRETCHES.findall(text), _is_odd):
                    if odd:
                        mixed[i] += own
                    else:
                        out.append(None)
                        mixed[i].append(len(out) - 1)
                        plain.append((len(out) - 1, _latin(" ".join(own))))
            held += len(raw)
            if held >= CHUNK:
                self._plain(plain, out)
                plain, held = [], 0
        self._plain(plain, out)
        odd = list({x for own in mixed.values() for x in own if isinstance(x, str)})
        ids = dict(zip(odd, (np.array(e.ids, np.uint32) for e in self.whole.encode_batch(odd, add_special_tokens=False)))) if odd else {}
        for i, own in mixed.items():
            out[i] = np.concatenate([ids[x] if isinstance(x, str) else out[x] for x in own]) if own else np.zeros(0, np.uint32)
        return out[: len(texts)]

    def _plain(self, texts: list[tuple[int, bytes]], out: list) -> None:
        """Puts the ids of Latin-1 texts in their places; a long text goes in parts that end at white space."""
        if not texts:
            return
        if len(texts) == 1 and len(texts[0][1]) > 2 * CHUNK:
            i, raw = texts[0]
            parts, at = [], 0
            while at < len(raw):
                cut = max(raw.rfind(b" ", at, at + CHUNK), raw.rfind(b"\n", at, at + CHUNK)) + 1 or len(raw)
                cut = cut if len(raw) - at > CHUNK and cut > at else len(raw)
                parts.append(raw[at:cut])
                at = cut
            if len(parts) > 1:
                out[i] = np.concatenate([self._ids([p])[0] for p in parts])
                return
        if len(texts) > 1 and max(len(x) for _, x in texts) > 2 * CHUNK:
            for x in texts:
                self._plain([x], out)
            return
        for (i, _), ids in zip(texts, self._ids([x for _, x in texts])):
            out[i] = ids

    def _ids(self, texts: list[bytes]) -> list[np.ndarray]:
        buf = b" ".join(texts).translate(LOWER) + b" "
        raw = np.frombuffer(buf, np.uint8)
        kind = CLASSES[raw]
        was = np.empty_like(kind)
        was[0], was[1:] = _SPACE, kind[:-1]
        start = (kind != _SPACE) & ((kind != was) | (kind == _NUMBER))
        self._contractions(raw, kind, start)
        edge = np.flatnonzero(start | ((kind == _SPACE) & (was != _SPACE)))
        first = np.flatnonzero(start[edge])
        a, b = edge[first], edge[first + 1] if len(first) else edge[:0]
        keys, example, place = np.unique(hash_spans(raw, a, b), return_index=True, return_inverse=True)
        word = self._look_up(keys, buf, a[example], b[example])[place]
        n, at, pool = self.n[word], self.at[word], self.pool
        wrong = np.flatnonzero((self.size[word] != b - a) | ~equal_spans(raw, a, np.minimum(b - a, self.size[word]), self.text, self.text_at[word]))
        if len(wrong):  # words that share a hash with another one
            own = [e.ids for e in self.words.encode_batch([buf[x:y].decode("latin-1") for x, y in zip(a[wrong].tolist(), b[wrong].tolist())], add_special_tokens=False)]
            n[wrong] = [len(e) for e in own]
            at[wrong] = len(pool) + np.cumsum(n[wrong]) - n[wrong]
            pool = np.concatenate([pool, np.array([i for e in own for i in e], np.uint32)])
        stop = np.cumsum(n)
        ids = pool[np.repeat(at - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
        edges = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cuts = np.concatenate(([0], stop))[np.searchsorted(a, edges)]
        return [ids[x:y] for x, y in zip(cuts[:-1], cuts[1:])]

    def _contractions(self, raw: np.ndarray, kind: np.ndarray, start: np.ndarray) -> None:
        """A lone apostrophe takes s, t, m, d, re, ve or ll from the letters after it."""
        at = np.flatnonzero((raw[:-1] == ord("'")) & start[:-1] & (kind[1:] == _LETTER))
        if not len(at):
            return
        x, y = raw[at + 1], raw[np.minimum(at + 2, len(raw) - 1)]
        one = np.isin(x, np.frombuffer(b"stmd", np.uint8))
        two = ((y == ord("e")) & ((x == ord("r")) | (x == ord("v")))) | ((x == ord("l")) & (y == ord("l")))
        at, taken = at[one | two], np.where(one, 2, 3)[one | two]
        start[at + 1] = False
        rest = at + taken
        start[rest[kind[rest] == _LETTER]] = True

    def _look_up(self, keys: np.ndarray, buf: bytes, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Places in the cache of words given by hash and by where they stand in buf."""
        if len(self.known) + len(keys) > self.cached_words:
            self.clear()
        at = np.searchsorted(self.known, keys)
        new = np.ones(len(keys), bool)
        inside = at < len(self.known)
        new[inside] = self.known[at[inside]] != keys[inside]
        if new.any():
            words = [buf[x:y].decode("latin-1") for x, y in zip(a[new].tolist(), b[new].tolist())]
            ids = np.array(self.words.encode(" ".join(words), add_special_tokens=False).ids, np.uint32)
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) != len(words):
                each = [e.ids for e in self.words.encode_batch(words, add_special_tokens=False)]
                ids, stop = np.array([i for e in each for i in e], np.uint32), np.cumsum([len(e) for e in each])
            begin = np.concatenate(([0], stop[:-1]))
            self.known = np.insert(self.known, at[new], keys[new])
            self.n = np.insert(self.n, at[new], stop - begin)
            self.at = np.insert(self.at, at[new], begin + len(self.pool))
            size = (b - a)[new]
            self.size = np.insert(self.size, at[new], size)
            self.text_at = np.insert(self.text_at, at[new], np.cumsum(size) - size + len(self.text))
            self.text = np.concatenate((self.text, np.frombuffer(b"".join(buf[x:y] for x, y in zip(a[new].tolist(), b[new].tolist())), np.uint8)))
            self.pool = np.concatenate((self.pool, ids))
            at = np.searchsorted(self.known, keys)
        return at


@lru_cache(2)
def encoder(path: str) -> WordEncoder:
    """One for each Python worker, which keeps it from task to task."""
    return WordEncoder(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, length: int = LENGTH, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``. The tokenizer's file lies at one path on all machines."""
    path = tokenizer or default_tokenizer()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for batch in batches:
            for s in range(0, batch.num_rows, 1000):
                part = batch.slice(s, 1000)
                cols: list[list] = [[] for _ in names]
                for doc, ids in zip(part.column(0).to_pylist(), enc.encode(part.column(1).to_pylist())):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), length)):
                        x = ids[at : at + length]
                        row = (doc, k, at, len(x), zlib.crc32(x.tobytes()), x)
                        for c, v in zip(cols, row):
                            c.append(v)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([pa.array(c if k < 5 else [x.astype(np.int32) for x in c], t) for k, (c, t) in enumerate(zip(cols, kinds))], names=names)

    return df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Capacities:
    """Open bins by remaining capacity. A segment tree counts them, so the tightest that fits is log n steps away."""

    def __init__(self, most: int):
        self.width = 1 << most.bit_length()
        self.count = [0] * (2 * self.width)
        self.bins: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, room: int, which: int) -> None:
        self.bins[room].append(which)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.width
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The least room of at least size, and a bin that has it; the bin is no longer open here."""
        i, count = size + self.width, self.count
        while not count[i]:
            while i & 1:
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.width
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit_decreasing(sizes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, and the number of bins. Sizes are from 1 to most."""
    which, offset, n = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
    room = Capacities(most)
    for i in np.argsort(-np.asarray(sizes), kind="stable").tolist():
        size = int(sizes[i])
        if (found := room.take(size)) is None:
            left, k, n = most, n, n + 1
        else:
            left, k = found
        which[i], offset[i] = k, most - left
        if left > size:
            room.add(left - size, k)
    return which, offset, n


def pack(cut: DataFrame, length: int = LENGTH, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces. Pieces are cut before, once, as they are counted and then read."""
    cut = cut_lineage(cut)
    shards = max(1, -(-cut.count() // shard_pieces))
    own = F.coalesce(F.col("doc_id"), F.monotonically_increasing_id())  # rows without an id are many pieces, not one
    dealt = cut.withColumn("_shard", F.pmod(F.xxhash64(own, "piece", "ids_crc32"), F.lit(shards)))
    names = [*cut.columns, "sequence_id", "offset"]

    def run(group: pa.Table) -> pa.Table:
        group = group.combine_chunks().sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        which, offset, _ = best_fit_decreasing(group.column("length").to_numpy(), length)
        first = (group.column("_shard")[0].as_py() << 32) if group.num_rows else 0
        return group.drop_columns(["_shard"]).append_column("sequence_id", pa.array(which + first)).append_column("offset", pa.array(offset)).select(names)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields)
    return dealt.groupBy("_shard").applyInArrow(run, f"{kinds}, sequence_id long, offset long")
