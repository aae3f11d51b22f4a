"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_CLASS = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_parts(spark: SparkSession) -> int:
    """How many partitions the session deals a shuffle over; the deployer sizes it to the input."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def utf8(text: str | Column) -> Column:
    """A text as its UTF-8 bytes; null counts as empty."""
    c = F.col(text) if isinstance(text, str) else text
    return F.coalesce(c.cast("string").cast("binary"), F.lit(b""))


def span_view(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a binary or string column and its n + 1 offsets, without a copy; nulls are empty."""
    col = col.cast(pa.large_binary())
    if col.null_count:
        col = pc.fill_null(col, b"")
    n = len(col)
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share.

    Only where the session names none, and runs on this machine alone, is a folder of this machine used.
    """
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    global _own_folder
    if _own_folder is None:
        import tempfile

        _own_folder = tempfile.mkdtemp(prefix="shared-")
    return _own_folder


_own_folder: str | None = None


def cut_lineage(df: DataFrame) -> DataFrame:
    """checkpoint() into the shared folder."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint()


def roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes that pairs join, all but the least of each component, and that least one."""
    nodes, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = code[: len(a)], code[len(a) :]
    label = np.arange(len(nodes))
    while (apart := label[x] != label[y]).any():
        x, y = x[apart], y[apart]
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder in whatever store holds it."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def pack_sorted(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys as the byte planes of their differences. The upper planes are small numbers, which entropy coding shrinks."""
    d = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(d.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_sorted(raw: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of uint64 values (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_KEPT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Spans of more bytes are hashed one by one.
LONG_SPAN = 256


def lanes(raw: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place, as one little-endian number; zeros follow the end."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    return np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))


def hash_spans(raw: np.ndarray, a: np.ndarray, b: np.ndarray, seed: int = 0) -> np.ndarray:
    """A hash of each span raw[a:b], eight bytes a step. Every step mixes all 64 bits, so that no two patterns cancel as they may in sums of powers."""
    n = b - a
    view = lanes(raw)
    h = mix64(n.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
    live = np.flatnonzero((n > 0) & (n <= LONG_SPAN))
    at = 0
    while len(live):
        left = n[live] - at
        h[live] = mix64(h[live] ^ (view[a[live] + at] & _KEPT[np.minimum(left, 8)]))
        live, at = live[left > 8], at + 8
    for i in np.flatnonzero(n > LONG_SPAN).tolist():
        h[i] = int.from_bytes(hashlib.blake2b(raw[a[i] : b[i]], digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little")
    return h


def equal_spans(raw: np.ndarray, a: np.ndarray, n: np.ndarray, other: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether raw[a : a + n] and other[b : b + n] are the same bytes, for each place."""
    x, y = lanes(raw), lanes(other)
    out = np.ones(len(a), bool)
    live, at = np.flatnonzero(n > 0), 0
    while len(live):
        left = n[live] - at
        same = (x[a[live] + at] ^ y[b[live] + at]) & _KEPT[np.minimum(left, 8)] == 0
        out[live[~same]] = False
        live, at = live[same & (left > 8)], at + 8
    return out


def pack_columns(*columns: np.ndarray) -> bytes:
    """Arrays of one length as their byte planes, one after another."""
    return b"".join(np.ascontiguousarray(np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T).tobytes() for c in columns)


def unpack_columns(raw: bytes, kinds: tuple) -> list[np.ndarray]:
    kinds = [np.dtype(k) for k in kinds]
    n = len(raw) // sum(k.itemsize for k in kinds)
    out, at = [], 0
    for k in kinds:
        planes = np.frombuffer(raw, np.uint8, n * k.itemsize, at).reshape(k.itemsize, n)
        out.append(np.ascontiguousarray(planes.T).view(k).ravel())
        at += n * k.itemsize
    return out


def concat_columns(blobs: list[bytes], kinds: tuple) -> list[np.ndarray]:
    """The rows of several packed blobs, column by column."""
    parts = [unpack_columns(b, kinds) for b in blobs]
    return [np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(kinds)]


def split_by(labels: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Each label with the places that have it."""
    order = np.argsort(labels, kind="stable")
    cuts = np.flatnonzero(np.concatenate(([True], labels[order][1:] != labels[order][:-1]))) if len(labels) else np.zeros(0, int)
    return [(int(labels[order[a]]), order[a:b]) for a, b in zip(cuts, [*cuts[1:], len(labels)])]


def let_go(spark: SparkSession) -> None:
    """Has the driver's JVM look for shuffles that nothing refers to any more, so that their files go.

    Spark removes a shuffle's files only then. They would stay on the executors' disks until the driver's heap fills up
    by itself: without these calls op4_ngram_join left 3.8 times its input there instead of 2.9.
    """
    import gc

    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``id, component`` (the smallest id that its edges ``a, b`` lead to) for every id that has an edge.

    Large and small stars in turn, until the edges stay as they are. Each step groups by node with partial
    minima and joins these back, so that a node with very many edges is split like any skewed join.
    """
    e = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    was = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        e = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u")
        e = cut_lineage(e.select(F.col("u"), F.col("m").alias("v")).unionByName(e.select(F.col("v").alias("u"), F.col("m").alias("v"))).where("u <> v").distinct())
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == was:
            break
        was = now
    else:
        raise RuntimeError("components did not settle")
    let_go(edges.sparkSession)
    least = e.groupBy("u").agg(F.min("v").alias("v"))
    return least.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(least.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
