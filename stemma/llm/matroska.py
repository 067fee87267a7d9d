"""Media columns: Matroska files as packet tables.

`demux` reads a file's bytes: EBML elements of variable length (also of unknown size), clusters, simple blocks and
block groups with no, Xiph, fixed-size or EBML lacing, and cues. Each packet has its track, its timestamp in
nanoseconds, a key flag and its byte range in the file, so that later readers fetch single packets.
`mux` stores samples losslessly as an 8-bit PCM track, with laced blocks, clusters and cues.

`packet_table` gives a row for each packet; `read_media` a row for each file, with packets and cues as arrays and
digests of what the packets' ranges hold. One file is one row: memory is bounded by the longest one, and files are
read in batches of bounded bytes. `write_media` is written as a table before it is read back.

Of a track's content encodings, stripped headers and zlib are undone when a packet's bytes are taken (`payload`); a
range is always that of the stored bytes. Other encodings end a file's packets with an error.

A null or empty file has no packets and the error "empty"; a damaged or cut one has its packets up to the damage and
an error that says where. Repeated rows each get their result. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, strings, table, tuned, written

# Element IDs of the Matroska specification.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CONTENT_ENCODINGS, CONTENT_ENCODING, CONTENT_COMPRESSION, COMP_ALGO, COMP_SETTINGS, CONTENT_ENCRYPTION = 0x6D80, 0x6240, 0x5034, 0x4254, 0x4255, 0x5035
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: What ends a cluster of unknown size.
TOP = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, EBML}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

#: Samples to a second, to a frame; frames to a block, blocks to a cluster.
RATE, FRAME, LACED, BLOCKS = 8000, 512, 8, 8
UNIT = 64

PACKET = "struct<track:int,timestamp_ns:bigint,key:boolean,lacing:int,offset:bigint,size:bigint>"
CUE = "struct<time_ns:bigint,track:int,cluster_offset:bigint>"


class Damaged(ValueError):
    pass


def vint(n: int, width: int = 0) -> bytes:
    """n as an element's size, in as few bytes as hold it, or in `width`."""
    while not width or n >= (1 << 7 * width) - 1:
        width += 1
        if n < (1 << 7 * width) - 1:
            break
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(key: int, body: bytes) -> bytes:
    return key.to_bytes((key.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(key: int, n: int) -> bytes:
    return element(key, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def laced(frames: list[bytes], kind: int) -> bytes:
    """The body of a block behind its flags."""
    if kind == NO_LACING:
        return frames[0]
    sizes, head = [len(x) for x in frames], bytes([len(frames) - 1])
    if kind == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif kind == EBML_LACING:
        head += vint(sizes[0])
        for a, b in zip(sizes, sizes[1:-1], strict=False):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            head += vint(b - a + (1 << 7 * width - 1) - 1, width)
    return head + b"".join(frames)


def mux(samples: bytes) -> bytes:
    """A file with one track of 8-bit samples."""
    ms = lambda at: at * 1000 // RATE
    head = element(EBML, element(DOC_TYPE, b"matroska"))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(samples) * 1000 / RATE)))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 1_000_000_000 // RATE) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    for k in range(0, len(samples), FRAME * LACED * BLOCKS):
        begins, blocks = ms(k), []
        for n, i in enumerate(range(k, min(len(samples), k + FRAME * LACED * BLOCKS), FRAME * LACED)):
            frames = [samples[j : j + FRAME] for j in range(i, min(len(samples), i + FRAME * LACED), FRAME)]
            kind = NO_LACING if len(frames) == 1 else (XIPH, FIXED, EBML_LACING)[n % 3]
            if kind == FIXED and len(frames[-1]) != FRAME:
                kind = EBML_LACING
            blocks.append(element(SIMPLE_BLOCK, vint(1) + struct.pack(">hB", ms(i) - begins, 0x80 | kind_flag(kind)) + laced(frames, kind)))
        cluster = element(CLUSTER, number(TIMESTAMP, begins) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, begins) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    return head + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


def kind_flag(kind: int) -> int:
    """The lacing bits of a block's flags: 01 Xiph, 10 fixed size, 11 EBML."""
    return kind << 1


@dataclass
class Media:
    packets: list[tuple] = field(default_factory=list)
    cues: list[tuple] = field(default_factory=list)
    clusters: int = 0
    error: str | None = None
    #: Of a track: bytes stripped from the begin of each packet, or null for zlib.
    encodings: dict[int, bytes | None] = field(default_factory=dict)

    def payload(self, b: bytes, packet: tuple) -> bytes:
        """What a packet holds, its content encoding undone."""
        raw, prefix = b[packet[4] : packet[4] + packet[5]], self.encodings.get(packet[0], b"")
        return zlib.decompress(raw) if prefix is None else prefix + raw


def _vint(b: bytes, i: int, end: int, keep: bool = False) -> tuple[int, int, bool]:
    """Value, place behind it, whether all its bits are set (an unknown size)."""
    if i >= end or not b[i]:
        raise Damaged(f"no variable-length number at {i}")
    width = 9 - b[i].bit_length()
    if i + width > end:
        raise Damaged(f"cut at {i}")
    v = int.from_bytes(b[i : i + width], "big")
    low = v & (1 << 7 * width) - 1
    return (v if keep else low), i + width, low == (1 << 7 * width) - 1


def _elements(b: bytes, i: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """ID, begin and end of each element's body; one of unknown size reaches to the end or the next top element."""
    while i < end:
        key, i, _ = _vint(b, i, end, keep=True)
        if inside == CLUSTER and key in TOP:
            return
        size, i, unknown = _vint(b, i, end)
        stop = end if unknown else i + size
        if unknown and key == CLUSTER:
            stop = _cluster_end(b, i, end)
        if stop > end:
            yield key, i, -end
            raise Damaged(f"element {key:X} at {i} is cut")
        yield key, i, stop
        i = stop


def _cluster_end(b: bytes, i: int, end: int) -> int:
    while i < end:
        key, j, _ = _vint(b, i, end, keep=True)
        if key in TOP:
            return i
        size, j, _ = _vint(b, j, end)
        i = j + size
    return min(i, end)


def _uint(b: bytes, i: int, end: int) -> int:
    return int.from_bytes(b[i:end], "big")


def _block(b: bytes, i: int, end: int, cluster: int, media: Media, scale: int, tracks: dict[int, int], key: bool | None) -> None:
    track, i, _ = _vint(b, i, end)
    if i + 3 > end:
        raise Damaged(f"block at {i} is cut")
    relative, flags = struct.unpack_from(">hB", b, i)
    i += 3
    lacing = flags >> 1 & 3
    if lacing == NO_LACING:
        sizes = [end - i]
    else:
        if i >= end:
            raise Damaged(f"lacing at {i} is cut")
        n, i = b[i] + 1, i + 1
        if lacing == FIXED:
            if (end - i) % n:
                raise Damaged(f"frames at {i} aren't of one size")
            sizes = [(end - i) // n] * n
        else:
            sizes = []
            for k in range(n - 1):
                if lacing == XIPH:
                    size = 0
                    while True:
                        if i >= end:
                            raise Damaged(f"lacing at {i} is cut")
                        size, i = size + b[i], i + 1
                        if b[i - 1] != 255:
                            break
                else:
                    began = i
                    size, i, _ = _vint(b, i, end)
                    if k:
                        size += sizes[-1] - ((1 << 7 * (i - began) - 1) - 1)
                sizes.append(size)
            sizes.append(end - i - sum(sizes))
            if min(sizes) < 0:
                raise Damaged(f"frames at {i} are longer than their block")
    began = (cluster + relative) * scale
    each = tracks.get(track, 0)
    for k, size in enumerate(sizes):
        media.packets.append((track, began + k * each, bool(flags & 0x80) if key is None else key, lacing, i, size))
        i += size


def _encoding(b: bytes, i: int, end: int) -> bytes | None:
    found = [(x, y) for k, x, y in _elements(b, i, end) if k == CONTENT_ENCODING]
    if len(found) != 1:
        raise Damaged(f"{len(found)} content encodings at {i}")
    inner = {k: (x, y) for k, x, y in _elements(b, *found[0])}
    if CONTENT_ENCRYPTION in inner or CONTENT_COMPRESSION not in inner:
        raise Damaged(f"encrypted content at {i}")
    held = {k: b[x:y] for k, x, y in _elements(b, *inner[CONTENT_COMPRESSION])}
    algorithm = int.from_bytes(held.get(COMP_ALGO, b""), "big")
    if algorithm not in (0, 3):
        raise Damaged(f"compression {algorithm} at {i}")
    return held.get(COMP_SETTINGS, b"") if algorithm else None


def demux(b: bytes | None) -> Media:
    media = Media()
    if not b:
        media.error = "empty"
        return media
    scale, tracks = 1_000_000, {}
    try:
        found = False
        for key, i, end in _elements(b, 0, len(b)):
            if key != SEGMENT:
                continue
            found, base = True, i
            for key1, i1, end1 in _elements(b, i, abs(end)):
                if key1 == INFO:
                    scale = next((_uint(b, x, y) for k, x, y in _elements(b, i1, abs(end1)) if k == TIMESTAMP_SCALE), scale)
                elif key1 == TRACKS:
                    for k, x, y in _elements(b, i1, abs(end1)):
                        if k == TRACK_ENTRY:
                            entry = {k2: _uint(b, x2, y2) for k2, x2, y2 in _elements(b, x, y) if k2 in (TRACK_NUMBER, DEFAULT_DURATION)}
                            tracks[entry.get(TRACK_NUMBER, 0)] = entry.get(DEFAULT_DURATION, 0)
                            for k2, x2, y2 in _elements(b, x, y):
                                if k2 == CONTENT_ENCODINGS:
                                    media.encodings[entry.get(TRACK_NUMBER, 0)] = _encoding(b, x2, y2)
                elif key1 == CLUSTER:
                    media.clusters += 1
                    at = 0
                    for k, x, y in _elements(b, i1, abs(end1), CLUSTER):
                        if k == TIMESTAMP:
                            at = _uint(b, x, y)
                        elif k == SIMPLE_BLOCK and y >= 0:
                            _block(b, x, y, at, media, scale, tracks, None)
                        elif k == BLOCK_GROUP and y >= 0:
                            inner = list(_elements(b, x, y))
                            for k2, x2, y2 in inner:
                                if k2 == BLOCK:
                                    _block(b, x2, y2, at, media, scale, tracks, all(e[0] != REFERENCE_BLOCK for e in inner))
                elif key1 == CUES:
                    for k, x, y in _elements(b, i1, abs(end1)):
                        if k == CUE_POINT:
                            point = list(_elements(b, x, y))
                            time = next((_uint(b, p, q) for e, p, q in point if e == CUE_TIME), 0)
                            for e, p, q in point:
                                if e == CUE_TRACK_POSITIONS:
                                    place = {e2: _uint(b, p2, q2) for e2, p2, q2 in _elements(b, p, q)}
                                    media.cues.append((time * scale, place.get(CUE_TRACK, 0), base + place.get(CUE_CLUSTER_POSITION, 0)))
        if not found:
            raise Damaged("no segment")
    except Damaged as e:
        media.error = str(e)
    return media


def feature(samples: bytes, media: Media) -> str:
    """Whole numbers only, so that equal samples have equal features everywhere."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64)
    used = np.flatnonzero(np.bincount(x, minlength=256)) if len(x) else np.empty(0, int)
    crossings = int(np.count_nonzero(np.diff(x >= 128))) if len(x) else 0
    last = max((p[1] for p in media.packets), default=0)
    return f"packets={len(media.packets)};clusters={media.clusters};cues={len(media.cues)};last_ns={last};sum={int(x.sum())};energy={int((x * x).sum())};peak={int(x.max()) if len(x) else 0};crossings={crossings};levels={len(used)}"


def padded(text: str) -> tuple[int, bytes]:
    raw = text.encode()
    return len(raw), raw + bytes(max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw))


def write_media(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text as a file of 8-bit samples."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(rows):
            ready = [padded(x) for x in strings(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([n for n, _ in ready], pa.int64()), pa.array([mux(p) for _, p in ready], pa.binary())], names=["doc_id", "n_bytes", "media"])

    tuned(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, media binary")


READ = f"packets array<{PACKET}>, cues array<{CUE}>, error string, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def read_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df without its media column, with packets, cues, error, digests of what the packets hold and features."""
    rest = [f for f in df.schema.fields if f.name != media]
    names = [f.name for f in rest]
    packet = pa.struct([("track", pa.int32()), ("timestamp_ns", pa.int64()), ("key", pa.bool_()), ("lacing", pa.int32()), ("offset", pa.int64()), ("size", pa.int64())])
    cue = pa.struct([("time_ns", pa.int64()), ("track", pa.int32()), ("cluster_offset", pa.int64())])
    added = ["packets", "cues", "error", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches(rows):
            out = []
            for raw in batch.column(len(names)).to_pylist():
                m, raw = demux(raw), raw or b""
                try:
                    held = b"".join(m.payload(raw, p) for p in m.packets)
                except zlib.error as e:
                    held, m.error = b"", f"damaged packet: {e}"
                out.append(([dict(zip(packet.names, p, strict=True)) for p in m.packets], [dict(zip(cue.names, c, strict=True)) for c in m.cues], m.error, len(held), hashlib.sha256(held).hexdigest(), zlib.crc32(held[-UNIT:]), len(raw), hashlib.sha256(raw).hexdigest(), feature(held, m)))
            kinds = [pa.list_(packet), pa.list_(cue), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *(pa.array([o[k] for o in out], kind) for k, kind in enumerate(kinds))], names=names + added)

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rest), READ])
    return df.select(*(F.col(f"`{n}`") for n in names), F.col(media)).mapInArrow(run, schema)


def packet_table(df: DataFrame, media: str = "media") -> DataFrame:
    """A row for each packet: df's other columns, packet number, track, timestamp, key, lacing, byte range."""
    rest = [c for c in df.columns if c != media]
    return read_media(df, media).select(*rest, F.posexplode("packets").alias("packet", "p")).select(*rest, "packet", "p.*")


def op7_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = read_media(written(write_media(table(spark, sf_dir, "documents")), "media"))
    return read.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", F.size("packets").alias("n_packets"), F.size("cues").alias("n_cues"))
