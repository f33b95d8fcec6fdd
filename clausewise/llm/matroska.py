"""Media columns as Matroska: write 8-bit PCM audio, read it back as packet tables.

`with_media` stores a payload as a Matroska audio track (8-bit samples, clusters, laced blocks,
cues); `packets` parses any Matroska column to one row a packet with track, timestamp and byte
range; `with_features` reassembles the stored samples from those byte ranges and computes
features. All three are Arrow functions without a shuffle, one file at a time.

Edge cases: a null payload gives null media; null or damaged media gives no packets and a
message in `error`; an empty payload gives a file without clusters.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clausewise.llm.common import byte_view, no_null, small_batches, steps

# Element ids of the public Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4D80, 0x5741
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0xE7, 0xA3, 0xA0, 0xA1
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
LACE_NONE, LACE_XIPH, LACE_FIXED, LACE_EBML = 0, 1, 2, 3

RATE = 8000
FRAME = 512  # samples of a packet: 64 ms
LACED = 8  # packets of a block
BLOCKS = 8  # blocks of a cluster
PAD = 64  # payloads are padded to a multiple of this

PACKET = "track long, timestamp_ns long, offset long, size long, keyframe boolean, lacing int, cluster long"


def _id(x: int) -> bytes:
    return x.to_bytes((x.bit_length() + 7) // 8, "big")


def vint(x: int, width: int = 0) -> bytes:
    """A variable-length EBML number in the fewest bytes, or in `width`."""
    width = width or next(w for w in range(1, 9) if x < (1 << 7 * w) - 1)
    return (x | 1 << 7 * width).to_bytes(width, "big")


def element(x: int, body: bytes) -> bytes:
    return _id(x) + vint(len(body)) + body


def _uint(x: int, value: int) -> bytes:
    return element(x, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _lace(sizes: list[int], turn: int) -> tuple[int, bytes]:
    """Lacing kind and header of a block's packets; unequal sizes use EBML and Xiph lacing in turn."""
    if len(sizes) == 1:
        return LACE_NONE, b""
    if len(set(sizes)) == 1:
        return LACE_FIXED, bytes([len(sizes) - 1])
    if turn % 2:
        return LACE_XIPH, bytes([len(sizes) - 1]) + b"".join(b"\xff" * (s // 255) + bytes([s % 255]) for s in sizes[:-1])
    out = bytes([len(sizes) - 1]) + vint(sizes[0])
    for a, b in zip(sizes, sizes[1:-1]):
        width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
        out += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return LACE_EBML, out


_HEAD = element(EBML, element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2))
_INFO = element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + element(MUXING_APP, b"clausewise") + element(WRITING_APP, b"clausewise"))
_TRACKS = element(
    TRACKS,
    element(
        TRACK_ENTRY,
        _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, 2) + _uint(FLAG_LACING, 1) + element(CODEC_ID, b"A_PCM/INT/LIT")
        + _uint(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE)
        + element(AUDIO, element(SAMPLING, struct.pack(">d", float(RATE))) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8)),
    ),
)


def mux(payload: bytes) -> bytes:
    """A Matroska file whose one audio track holds the payload's bytes as 8-bit samples."""
    out, cues, at = [_INFO, _TRACKS], [], len(_INFO) + len(_TRACKS)
    per_cluster, per_block = FRAME * LACED * BLOCKS, FRAME * LACED
    for c in range(0, len(payload), per_cluster):
        ms = c * 1000 // RATE
        body = [_uint(TIMESTAMP, ms)]
        for turn, b in enumerate(range(c, min(c + per_cluster, len(payload)), per_block)):
            part = payload[b : min(b + per_block, c + per_cluster)]
            sizes = [min(FRAME, len(part) - i) for i in range(0, len(part), FRAME)]
            kind, head = _lace(sizes, turn)
            body.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", b * 1000 // RATE - ms, 0x80 | kind << 1) + head + part))
        cluster = element(CLUSTER, b"".join(body))
        cues.append(element(CUE_POINT, _uint(CUE_TIME, ms) + element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        out.append(cluster)
        at += len(cluster)
    if cues:
        out.append(element(CUES, b"".join(cues)))
    return _HEAD + element(SEGMENT, b"".join(out))


class Damaged(ValueError):
    """A file that doesn't parse."""


def _number(data: bytes, at: int, keep_marker: bool) -> tuple[int | None, int]:
    """A variable-length number at `at` and where it ends; None: the size is unknown."""
    if at >= len(data) or not data[at]:
        raise Damaged(f"no number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise Damaged(f"the number at byte {at} is cut off")
    x = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return x, at + width
    x ^= 1 << 7 * width
    return (None if x == (1 << 7 * width) - 1 else x), at + width


def _children(data: bytes, at: int, end: int, stop: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int]]:
    """Id, start and end of the body of each element; one of unknown size ends before a `stop` element or the parent's end."""
    while at < end:
        name, at = _number(data, at, True)
        size, body = _number(data, at, False)
        if size is None:
            to = body
            while to < end:
                inner, after = _number(data, to, True)
                if inner in stop:
                    break
                n, b = _number(data, after, False)
                to = end if n is None else b + n
        else:
            to = body + size
        if to > end:
            raise Damaged(f"the element at byte {at} is longer than its parent")
        yield name, body, to
        at = to


def _frames(data: bytes, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """Offset and size of the packets of a block."""
    if kind == LACE_NONE:
        return [(at, end - at)]
    if at >= end:
        raise Damaged("a lacing header is missing")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == LACE_FIXED:
        if (end - at) % n:
            raise Damaged("fixed lacing doesn't divide the block")
        sizes = [(end - at) // n] * n
    elif kind == LACE_XIPH:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise Damaged("a Xiph lacing size is cut off")
                b, at = data[at], at + 1
                size += b
                if b < 255:
                    break
            sizes.append(size)
    else:
        for i in range(n - 1):
            before = at
            x, at = _number(data, at, False)
            if x is None:
                raise Damaged("a lacing size is unknown")
            sizes.append(x if not i else sizes[-1] + x - ((1 << 7 * (at - before) - 1) - 1))
    if kind != LACE_FIXED:
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Damaged("lacing sizes are longer than the block")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> list[tuple]:
    """The packet table of a file: (track, timestamp_ns, offset, size, keyframe, lacing, cluster), in stored order.

    Checks the cues against the clusters they point to. Raises Damaged.
    """
    top = list(_children(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise Damaged("no EBML header")
    rows: list[tuple] = []
    for name, seg, seg_end in top[1:]:
        if name != SEGMENT:
            continue
        scale, durations, clusters, cues = 1_000_000, {}, [], []
        for x, a, b in _children(data, seg, seg_end, frozenset({CLUSTER, CUES, TRACKS, INFO})):
            if x == INFO:
                for y, c, d in _children(data, a, b):
                    if y == TIMESTAMP_SCALE:
                        scale = int.from_bytes(data[c:d], "big")
            elif x == TRACKS:
                for y, c, d in _children(data, a, b):
                    if y == TRACK_ENTRY:
                        entry = {z: data[e:f] for z, e, f in _children(data, c, d)}
                        durations[int.from_bytes(entry.get(TRACK_NUMBER, b"\1"), "big")] = int.from_bytes(entry.get(DEFAULT_DURATION, b""), "big")
            elif x == CLUSTER:
                clusters.append((a, b))
            elif x == CUES:
                for _, c, d in _children(data, a, b):
                    for z, e, f in _children(data, c, d):
                        if z == CUE_POSITIONS:
                            cues += [seg + int.from_bytes(data[g:h], "big") for w, g, h in _children(data, e, f) if w == CUE_CLUSTER]
        if any(data[at : at + 4] != _id(CLUSTER) for at in cues):
            raise Damaged("a cue points to no cluster")
        for k, (a, b) in enumerate(clusters):
            base, blocks = 0, []
            for x, c, d in _children(data, a, b):
                if x == TIMESTAMP:
                    base = int.from_bytes(data[c:d], "big")
                elif x == SIMPLE_BLOCK:
                    blocks.append((c, d, True))
                elif x == BLOCK_GROUP:
                    blocks += [(e, f, False) for y, e, f in _children(data, c, d) if y == BLOCK]
            for c, d, simple in blocks:
                track, at = _number(data, c, False)
                if at + 3 > d:
                    raise Damaged("a block's header is cut off")
                ticks, flags = struct.unpack(">hB", data[at : at + 3])
                kind = flags >> 1 & 3
                for i, (off, size) in enumerate(_frames(data, at + 3, d, kind)):
                    rows.append((track, (base + ticks) * scale + i * durations.get(track, 0), off, size, bool(simple and flags & 0x80), kind, k))
    return rows


def with_media(df: DataFrame, text: str = "text", out: str = "media") -> DataFrame:
    """Adds the Matroska file of each text's UTF-8 bytes, padded with bytes 0 to a positive multiple of 64."""
    small_batches(df.sparkSession)

    def run(batches):
        for batch in steps(batches, text):
            raw, off = byte_view(no_null(batch.column(text)))
            raw = raw.tobytes()
            made = []
            for a, b in zip(off[:-1].tolist(), off[1:].tolist()):
                made.append(mux(raw[a:b] + bytes(max(PAD, -(b - a) // PAD * -PAD) - (b - a))))
            keep = [n for n in batch.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), pa.array(made, pa.binary())], names=[*keep, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)
    return df.mapInArrow(run, f"{schema}, `{out}` binary")


def packets(df: DataFrame, key: str, media: str = "media") -> DataFrame:
    """One row a packet: key, track, timestamp, byte range, and the cluster it is in. Damaged files have one row with `error`."""

    def run(batches):
        for batch in steps(batches, media):
            found, error = [], []
            for data in batch.column(media).to_pylist():
                try:
                    found.append([dict(zip(PACKET_NAMES, r)) for r in demux(data)] if data is not None else [])
                    error.append(None)
                except Damaged as e:
                    found.append([])
                    error.append(str(e))
            kind = pa.list_(pa.struct([(n, t) for n, t in zip(PACKET_NAMES, PACKET_TYPES)]))
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(found, kind), pa.array(error, pa.string())], names=["key", "found", "error"])

    kind = dict(df.dtypes)[key]
    out = df.select(key, media).mapInArrow(run, f"key {kind}, found array<struct<{PACKET.replace(' long', ':long').replace(' boolean', ':boolean').replace(' int', ':int')}>>, error string")
    return out.select(F.col("key").alias(key), "error", F.explode_outer("found").alias("p")).where("p is not null or error is not null").select(key, "p.*", "error")


PACKET_NAMES = [x.split()[0] for x in PACKET.split(", ")]
PACKET_TYPES = [{"long": pa.int64(), "boolean": pa.bool_(), "int": pa.int32()}[x.split()[1]] for x in PACKET.split(", ")]


def _feature(rows: list[tuple], samples: np.ndarray) -> str:
    """packets:duration in ms:mean:root mean square around 128:sign changes, of the samples read back."""
    x = samples.astype(np.int64) - 128
    ms = (rows[-1][1] // 1_000_000 + rows[-1][3] * 1000 // RATE) if rows else 0
    mean = x.sum() / max(1, len(x))
    rms = float(np.sqrt((x * x).sum() / max(1, len(x))))
    return f"{len(rows)}:{ms}:{mean:.4f}:{rms:.4f}:{int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))}"


def with_features(df: DataFrame, keep: list[str], media: str = "media") -> DataFrame:
    """Reads the stored bytes back through the packets' byte ranges: payload size, hash, tail checksum, features."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(batches):
        for batch in steps(batches, media):
            rows = []
            for data in batch.column(media).to_pylist():
                try:
                    table = demux(data) if data is not None else None
                except Damaged:
                    table = None
                if table is None:
                    rows.append((None, None, None, len(data) if data is not None else None, hashlib.sha256(data).hexdigest() if data is not None else None, None))
                    continue
                back = b"".join(data[r[2] : r[2] + r[3]] for r in table)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(data), hashlib.sha256(data).hexdigest(), _feature(table, np.frombuffer(back, np.uint8))))
            cols = list(zip(*rows))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), *(pa.array(c, t) for c, t in zip(cols, types))], names=[*keep, *names])

    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keep) + ", payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.select(*keep, media).mapInArrow(run, schema)


def media_digest(docs: DataFrame) -> DataFrame:
    """Contract of op2: every text stored, read back and described. A null text counts as empty."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("n_bytes", F.octet_length("text").cast("long"))
    stored = with_media(base).select("doc_id", "n_bytes", "media")
    return with_features(stored, ["doc_id", "n_bytes"])
