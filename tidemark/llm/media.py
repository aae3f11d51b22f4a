"""Media columns: Matroska files written to, and read from, binary columns.

``write_mkv`` stores a byte string as 8-bit PCM samples in a Matroska file: EBML header, segment
information, one audio track, clusters of laced SimpleBlocks, and cues. ``packets`` parses any such
file (also ones with unknown-size clusters, BlockGroups and all four kinds of lacing) into a packet
table; ``read_payload`` reads the stored samples back through that table.

Defined results: a null text is the empty text; its payload is 64 zero bytes. Broken files raise
``ValueError``. Equal texts give equal files.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import utf8

# Element ids of the Matroska specification (RFC 9559).
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83
FLAG_LACING, CODEC_ID, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x86, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0x00, 0x02, 0x04, 0x06
#: Elements that may only stand directly in a segment; one of them ends a cluster of unknown size.
TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

UNIT = 64
RATE = 8000
FRAME = 512
LACED = 8
BLOCKS_PER_CLUSTER = 16


def vint(n: int, width: int = 0) -> bytes:
    """An EBML size: a marker bit after width - 1 zero bits, then the value; all ones is reserved."""
    while not width or n >= (1 << (7 * width)) - 1:
        width += 1
    return (n | 1 << (7 * width)).to_bytes(width, "big")


def element(eid: int, body: bytes) -> bytes:
    return eid.to_bytes((eid.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def uint(eid: int, n: int) -> bytes:
    return element(eid, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def lace(frames: list[bytes]) -> tuple[int, bytes]:
    """The lacing flag and the body of a block: none for one frame, fixed for equal sizes, else EBML lacing."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    sizes = [len(f) for f in frames]
    head = bytes([len(frames) - 1])
    if len(set(sizes)) == 1:
        return FIXED_LACING, head + b"".join(frames)
    head += vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        d, width = b - a, 1
        while abs(d) > (1 << (7 * width - 1)) - 1:
            width += 1
        head += vint(d + (1 << (7 * width - 1)) - 1, width)
    return EBML_LACING, head + b"".join(frames)


HEADER = element(
    EBML,
    uint(EBML_VERSION, 1) + uint(EBML_READ_VERSION, 1) + uint(EBML_MAX_ID, 4) + uint(EBML_MAX_SIZE, 8)
    + element(DOC_TYPE, b"matroska") + uint(DOC_TYPE_VERSION, 4) + uint(DOC_TYPE_READ_VERSION, 2),
)
FRONT = element(
    INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"tidemark") + element(WRITING_APP, b"tidemark")
) + element(
    TRACKS,
    element(
        TRACK_ENTRY,
        uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(FLAG_LACING, 1)
        + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8)),
    ),
)


def pad(data: bytes) -> bytes:
    """Zero bytes are appended up to a positive multiple of UNIT."""
    return data + bytes(-len(data) % UNIT if data else UNIT)


def write_mkv(payload: bytes) -> bytes:
    """One 8-bit mono track; the payload's bytes are its samples."""
    body, cues, at = [FRONT], [], len(FRONT)
    span = FRAME * LACED * BLOCKS_PER_CLUSTER
    for start in range(0, len(payload), span):
        t0 = start * 1000 // RATE
        blocks = [uint(TIMESTAMP, t0)]
        for b in range(start, min(start + span, len(payload)), FRAME * LACED):
            flag, laced = lace([payload[i : i + FRAME] for i in range(b, min(b + FRAME * LACED, len(payload)), FRAME)])
            blocks.append(element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", b * 1000 // RATE - t0, 0x80 | flag) + laced))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, t0) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        body.append(cluster)
        at += len(cluster)
    body.append(element(CUES, b"".join(cues)))
    return HEADER + element(SEGMENT, b"".join(body))


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    keyframe: bool
    start: int
    size: int


def _head(raw: bytes, at: int) -> tuple[int, int, int]:
    """Id and size of the element at a place (size -1: unknown), and where its body starts."""
    if at >= len(raw) or not raw[at]:
        raise ValueError(f"no element id at byte {at}")
    w = 9 - raw[at].bit_length()
    eid = int.from_bytes(raw[at : at + w], "big")
    size, body = _vint(raw, at + w)
    return eid, size, body


def _vint(raw: bytes, at: int) -> tuple[int, int]:
    if at >= len(raw) or not raw[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    w = 9 - raw[at].bit_length()
    if at + w > len(raw):
        raise ValueError("the file ends inside a number")
    n = int.from_bytes(raw[at : at + w], "big") ^ (1 << (7 * w))
    return (-1 if n == (1 << (7 * w)) - 1 else n), at + w


def _children(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of the elements within a body; a known size that passes the end is an error."""
    while at < end:
        eid, size, body = _head(raw, at)
        if size < 0:
            if eid not in (SEGMENT, CLUSTER):
                raise ValueError("only segments and clusters may have an unknown size")
            stop = end if eid == SEGMENT else _unknown_end(raw, body, end)
        else:
            stop = body + size
        if stop > end:
            raise ValueError("an element passes the end of its parent")
        yield eid, body, stop
        at = stop


def _unknown_end(raw: bytes, at: int, end: int) -> int:
    while at < end:
        eid, size, body = _head(raw, at)
        if eid in TOP_LEVEL:
            break
        at = body + size
    return at


def _frames(raw: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """Start and size of the frames that a block holds."""
    kind = flags & 0x06
    if kind == NO_LACING:
        return [(at, end - at)]
    n, at = raw[at] + 1, at + 1
    sizes: list[int] = []
    if kind == FIXED_LACING:
        if (end - at) % n:
            raise ValueError("fixed lacing of unequal frames")
        sizes = [(end - at) // n] * (n - 1)
    elif kind == XIPH_LACING:
        for _ in range(n - 1):
            size = 0
            while True:
                size, at = size + raw[at], at + 1
                if raw[at - 1] < 255:
                    break
            sizes.append(size)
    else:
        for k in range(n - 1):
            was = at
            x, at = _vint(raw, at)
            w = at - was
            if x < 0:
                x = (1 << (7 * w)) - 1
            sizes.append(x if k == 0 else sizes[-1] + x - ((1 << (7 * w - 1)) - 1))
    out = []
    for size in [*sizes, end - at - sum(sizes)]:
        if size < 0:
            raise ValueError("laced frames pass the end of their block")
        out.append((at, size))
        at += size
    return out


def _number(raw: bytes, at: int, end: int) -> int:
    return int.from_bytes(raw[at:end], "big")


def packets(raw: bytes) -> list[Packet]:
    """The packet table of a Matroska file, in stored order; starts are byte places in the file."""
    out, scale, durations = [], 1_000_000, {}
    top = list(_children(raw, 0, len(raw)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for eid, a, b in top:
        if eid != SEGMENT:
            continue
        for eid, a, b in _children(raw, a, b):
            if eid == INFO:
                scale = next((_number(raw, x, y) for k, x, y in _children(raw, a, b) if k == TIMESTAMP_SCALE), scale)
            elif eid == TRACKS:
                for k, x, y in _children(raw, a, b):
                    if k == TRACK_ENTRY:
                        got = {k: _number(raw, p, q) for k, p, q in _children(raw, x, y) if k in (TRACK_NUMBER, DEFAULT_DURATION)}
                        durations[got.get(TRACK_NUMBER)] = got.get(DEFAULT_DURATION, 0)
            elif eid == CLUSTER:
                t0 = 0
                for k, x, y in _children(raw, a, b):
                    if k == TIMESTAMP:
                        t0 = _number(raw, x, y)
                    elif k in (SIMPLE_BLOCK, BLOCK_GROUP):
                        simple = k == SIMPLE_BLOCK
                        if not simple:
                            x, y = next(((p, q) for k, p, q in _children(raw, x, y) if k == BLOCK), (0, 0))
                            if not y:
                                continue
                        track, at = _vint(raw, x)
                        shift, flags = struct.unpack_from(">hB", raw, at)
                        first, step = (t0 + shift) * scale, durations.get(track, 0)
                        out += [Packet(track, first + i * step, simple and bool(flags & 0x80), s, n) for i, (s, n) in enumerate(_frames(raw, at + 3, y, flags))]
    return out


def cues(raw: bytes) -> list[tuple[int, int, int]]:
    """Time, track and byte place of the cluster, for each cue."""
    out = []
    for eid, a, b in _children(raw, 0, len(raw)):
        if eid != SEGMENT:
            continue
        for k, x, y in _children(raw, a, b):
            if k != CUES:
                continue
            for k, p, q in _children(raw, x, y):
                if k == CUE_POINT:
                    time, found = 0, []
                    for k, s, e in _children(raw, p, q):
                        if k == CUE_TIME:
                            time = _number(raw, s, e)
                        elif k == CUE_TRACK_POSITIONS:
                            found.append({k: _number(raw, u, v) for k, u, v in _children(raw, s, e)})
                    out += [(time, f.get(CUE_TRACK, 0), a + f.get(CUE_CLUSTER_POSITION, 0)) for f in found]
    return out


def read_payload(raw: bytes, table: list[Packet] | None = None, track: int = 1) -> bytes:
    return b"".join([raw[p.start : p.start + p.size] for p in (packets(raw) if table is None else table) if p.track == track])


def feature(payload: bytes, table: list[Packet]) -> str:
    """Packets, duration in ms, sum and squares of the samples about 128, and their sign changes."""
    x = np.frombuffer(payload, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"packets={len(table)};ms={len(x) * 1000 // RATE};sum={int(x.sum())};squares={int((x * x).sum())};crossings={crossings};peak={int(np.abs(x).max(initial=0))}"


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a Matroska file: ``doc_id, n_bytes, media``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([write_mkv(pad(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), utf8(text_col).alias("t")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packet_table(df: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """A row for each packet of each file: track, timestamp, key frame, and its byte range in the file. Null files have none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = packets(raw) if raw is not None else []
                cols = [[doc] * len(found), list(range(len(found))), *zip(*found)] if found else [[] for _ in range(7)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()))], names=["doc_id", "packet", "track", "timestamp_ns", "keyframe", "start", "size"])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(media_col).alias("m")).mapInArrow(run, "doc_id long, packet int, track int, timestamp_ns long, keyframe boolean, start long, size long")


def digest(media: DataFrame) -> DataFrame:
    """What ``store`` wrote, read back through its packets: digests and a feature string per file."""
    kinds = {"doc_id": pa.int64(), "n_bytes": pa.int64(), "payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for raw in batch.column(2).to_pylist():
                found = packets(raw)
                data = read_payload(raw, found)
                rows.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(data, found)))
            cols = list(zip(*rows)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(cols, list(kinds.values())[2:]))], names=list(kinds))

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
