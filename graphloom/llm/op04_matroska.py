"""Media columns: Matroska files in binary columns.

`mux` stores bytes losslessly as one 8-bit PCM track; `demux` parses any Matroska bytes (variable-length EBML
elements, known and unknown sizes, Xiph, EBML and fixed lacing, cues) into tracks, packets and cue points.
`media_column`, `packet_table` and `media_digests` apply them to DataFrames, row by row, without a shuffle.

Defined results: a null text counts as empty; an empty text becomes one frame of padding; a very long text is one file of
many clusters, held in memory with its text; damaged media (cut or nested too deep, times beyond 64 bits, cues that
point at no cluster) give one row with an error text instead of a crash, null media none; equal texts give equal
bytes; repeated rows repeat; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import as_bytes, bounded_batches, table

FRAME = 576
RATE = 48_000
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16
MOST_DEPTH = 32

# Element ids of the Matroska specification (RFC 9559): fixed values.
EBML, SEGMENT, SEEK_HEAD, SEEK, SEEK_ID, SEEK_POSITION = 0x1A45DFA3, 0x18538067, 0x114D9B74, 0x4DBB, 0x53AB, 0x53AC
INFO, TIMESTAMP_SCALE, DURATION = 0x1549A966, 0x2AD7B1, 0x4489
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {EBML, SEGMENT, SEEK_HEAD, SEEK, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES}


def size_vint(n: int, length: int = 0) -> bytes:
    """n as a size; all ones is kept for unknown sizes."""
    while not length or n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_vint(len(body)) + body


def uint(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def _signed_vint(n: int) -> bytes:
    length = 1
    while not -((1 << 7 * length - 1) - 1) <= n <= (1 << 7 * length - 1) - 1:
        length += 1
    return size_vint(n + (1 << 7 * length - 1) - 1, length)


def block_body(frames: list[bytes], track: int, relative: int, lacing: str) -> bytes:
    """A SimpleBlock's body with the frames laced as asked: none, xiph, ebml or fixed."""
    flags = 0x80 | {"none": 0, "xiph": 2, "fixed": 4, "ebml": 6}[lacing]
    head = size_vint(track) + struct.pack(">hB", relative, flags)
    if lacing == "none":
        return head + frames[0]
    head += bytes([len(frames) - 1])
    sizes = [len(f) for f in frames]
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml":
        head += size_vint(sizes[0]) + b"".join(_signed_vint(b - a) for a, b in zip(sizes[:-2], sizes[1:-1], strict=True))
    return head + b"".join(frames)


def mux(payload: bytes, frame: int = FRAME, rate: int = RATE, per_block: int = FRAMES_PER_BLOCK, per_cluster: int = BLOCKS_PER_CLUSTER, lacing: str = "fixed") -> bytes:
    """Matroska bytes holding payload (a positive multiple of frame) as 8-bit mono PCM, one packet a frame."""
    n = len(payload) // frame
    if not n or n * frame != len(payload):
        raise ValueError("payload must be a positive multiple of the frame size")
    step = frame * 1000 // rate
    head = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(0x4282, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
    info = element(INFO, uint(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(n * step))) + element(0x4D80, b"graphloom") + element(0x5741, b"graphloom"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", float(rate))) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(0x9C, 1) + element(CODEC_ID, b"A_PCM/INT/LIT") + uint(DEFAULT_DURATION, step * 1_000_000) + audio))
    clusters, places = [], []
    for first in range(0, n, per_block * per_cluster):
        at, body = first * step, [uint(TIMESTAMP, first * step)]
        for b in range(first, min(n, first + per_block * per_cluster), per_block):
            frames = [payload[k * frame : (k + 1) * frame] for k in range(b, min(n, b + per_block))]
            body.append(element(SIMPLE_BLOCK, block_body(frames, 1, b * step - at, lacing if len(frames) > 1 else "none")))
        clusters.append(element(CLUSTER, b"".join(body)))
        places.append(at)

    def seek_head(parts: list[tuple[int, int]]) -> bytes:
        return element(SEEK_HEAD, b"".join(element(SEEK, element(SEEK_ID, i.to_bytes(4, "big")) + element(SEEK_POSITION, p.to_bytes(8, "big"))) for i, p in parts))

    at_info = len(seek_head([(INFO, 0), (TRACKS, 0), (CUES, 0)]))
    at = at_clusters = at_info + len(info) + len(tracks)
    points = []
    for when, c in zip(places, clusters, strict=True):
        points.append(element(CUE_POINT, uint(CUE_TIME, when) + element(CUE_TRACK_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER_POSITION, at))))
        at += len(c)
    body = seek_head([(INFO, at_info), (TRACKS, at_info + len(info)), (CUES, at)]) + info + tracks + b"".join(clusters) + element(CUES, b"".join(points))
    assert at_clusters == at_info + len(info) + len(tracks)
    return head + element(SEGMENT, body)


def read_vint(data: bytes, at: int, marker: bool) -> tuple[int, int, bool]:
    """(value, next place, all ones); marker: keep the length marker, as in ids."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"bad variable-length integer at {at}")
    length = 9 - data[at].bit_length()
    if at + length > len(data):
        raise ValueError(f"cut integer at {at}")
    raw = int.from_bytes(data[at : at + length], "big")
    bare = raw & ((1 << 7 * length) - 1)
    return raw if marker else bare, at + length, bare == (1 << 7 * length) - 1


def _laced(data: bytes, at: int, end: int, flags: int) -> list[tuple[int, int]]:
    """(offset, size) of a block's frames."""
    kind = flags >> 1 & 3
    if not kind:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if kind == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError("fixed lacing with uneven frames")
        return [(at + k * each, each) for k in range(count)]
    sizes: list[int] = []
    for k in range(count - 1):
        if kind == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            sizes.append(n + data[at])
            at += 1
        else:
            n, after, _ = read_vint(data, at, False)
            sizes.append(n if not k else sizes[-1] + n - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames exceed their block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def demux(data: bytes) -> dict:
    """tracks: number, codec, rate, ... ; packets: (track, timestamp ns, offset, size, key, cluster); cues: (ns, track, byte offset of the cluster, cluster).

    Whatever the bytes are, it returns or raises ValueError.
    """
    try:
        return _demux(data)
    except (IndexError, OverflowError, struct.error) as e:
        raise ValueError(f"damaged: {e}") from e


def _demux(data: bytes) -> dict:
    tracks: list[dict] = []
    packets: list[tuple] = []
    cues: list[tuple] = []
    clusters: dict[int, int] = {}
    state = {"scale": 1_000_000, "base": 0, "segment": 0, "duration": 0.0}
    numbers = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns", CHANNELS: "channels", BIT_DEPTH: "bits"}

    def block(at: int, end: int, key: bool | None) -> None:
        track, at, _ = read_vint(data, at, False)
        relative, flags = struct.unpack_from(">hB", data, at)
        frame_ns = next((t.get("frame_ns", 0) for t in tracks if t.get("number") == track), 0)
        start = (state["base"] + relative) * state["scale"]
        frames = _laced(data, at + 3, end, flags)
        if not -(1 << 63) <= start <= start + len(frames) * frame_ns < 1 << 63:
            raise ValueError(f"time beyond 64 bits at {at}")
        for k, (place, n) in enumerate(frames):
            packets.append((track, start + k * frame_ns, place, n, bool(flags & 0x80) if key is None else key, len(clusters) - 1))

    def walk(at: int, end: int, parent: int, depth: int = 0) -> int:
        if depth > MOST_DEPTH:
            raise ValueError(f"elements nested too deep at {at}")
        while at < end:
            ident, body, _ = read_vint(data, at, True)
            n, body, unknown = read_vint(data, body, False)
            if unknown and ident not in MASTERS:
                raise ValueError("unknown size of an element that holds no others")
            if parent == CLUSTER and ident in TOP:  # ends a cluster of unknown size
                return at
            stop = end if unknown else body + n
            if stop > end:
                raise ValueError(f"element at {at} exceeds its parent")
            if ident == SEGMENT:
                state["segment"] = body
            elif ident == CLUSTER:
                clusters[at] = len(clusters)
            elif ident == TRACK_ENTRY:
                tracks.append({})
            elif ident == CUE_POINT:
                cues.append([0, 0, 0])
            if ident in MASTERS:
                at = walk(body, stop, ident, depth + 1)
                at = at if unknown else stop
                continue
            if ident == SIMPLE_BLOCK:
                block(body, stop, None)
            elif ident == BLOCK:
                block(body, stop, True)
            elif ident == TIMESTAMP and parent == CLUSTER:
                state["base"] = int.from_bytes(data[body:stop], "big")
            elif ident == TIMESTAMP_SCALE:
                state["scale"] = int.from_bytes(data[body:stop], "big")
            elif ident in (DURATION, SAMPLING_FREQUENCY):
                value = struct.unpack(">d" if n == 8 else ">f", data[body:stop])[0] if n else 0.0
                if ident == DURATION:
                    state["duration"] = value
                else:
                    tracks[-1]["rate"] = value
            elif ident in numbers:
                tracks[-1][numbers[ident]] = int.from_bytes(data[body:stop], "big")
            elif ident == CODEC_ID:
                tracks[-1]["codec"] = data[body:stop].decode("ascii", "replace")
            elif ident == CUE_TIME:
                cues[-1][0] = int.from_bytes(data[body:stop], "big") * state["scale"]
            elif ident == CUE_TRACK:
                cues[-1][1] = int.from_bytes(data[body:stop], "big")
            elif ident == CUE_CLUSTER_POSITION:
                cues[-1][2] = int.from_bytes(data[body:stop], "big") + state["segment"]
            at = stop
        return at

    walk(0, len(data), 0)
    for when, _, at in cues:
        if at not in clusters or when >= 1 << 63:
            raise ValueError(f"a cue points at no cluster: {at}")
    return {"tracks": tracks, "packets": packets, "cues": [(*c, clusters[c[2]]) for c in cues], "clusters": len(clusters), "duration_ns": round(state["duration"] * state["scale"])}


def padded(text: bytes, frame: int = FRAME) -> bytes:
    return text + b"\xff" * (max(1, -(-len(text) // frame)) * frame - len(text))


def read_payload(data: bytes, parsed: dict) -> bytes:
    """The track's bytes in order of time, cut out by the packets' byte ranges."""
    return b"".join(data[at : at + n] for _, _, at, n, _, _ in sorted(parsed["packets"], key=lambda p: (p[1], p[2])))


def feature(payload: bytes, parsed: dict) -> str:
    """Sound features of the read-back samples (mean level, zero crossings) beside the container's counts."""
    samples = np.frombuffer(payload, np.uint8)
    above = samples >= 128
    crossings = int(np.count_nonzero(above[1:] != above[:-1]))
    track = parsed["tracks"][0]
    return f"{track['codec']};hz={track['rate']:.0f};packets={len(parsed['packets'])};clusters={parsed['clusters']};cues={len(parsed['cues'])};ms={parsed['duration_ns'] // 1_000_000};sum={int(samples.sum(dtype=np.int64))};crossings={crossings}"


def media_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, media: each text stored as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([mux(padded(t or b"")) for t in as_bytes(b.column(1))], pa.binary())], ["id", "media"])

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"id {kind}, media binary")


def packet_table(df: DataFrame, id_col: str = "id", media_col: str = "media") -> DataFrame:
    """One row a packet: id, track, timestamp_ns, byte_offset, size, key, cluster, cue_offset (of its cluster's cue, else null); one row with error for damaged media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "track", "timestamp_ns", "byte_offset", "size", "key", "cluster", "cue_offset", "error"]
        for b in batches:
            rows = []
            for ident, media in zip(b.column(0).to_pylist(), as_bytes(b.column(1)), strict=True):
                if media is None:
                    continue
                try:
                    parsed = demux(media)
                    cue = {c[3]: c[2] for c in parsed["cues"]}
                    rows += [(ident, p[0], p[1], p[2], p[3], p[4], p[5], cue.get(p[5]), None) for p in parsed["packets"]]
                except ValueError as e:
                    rows.append((ident, *[None] * 7, str(e)))
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    kind = df.select(F.col(id_col)).schema[0].dataType.simpleString()
    return df.select(F.col(id_col), F.col(media_col)).mapInArrow(run, f"id {kind}, track long, timestamp_ns long, byte_offset long, size long, key boolean, cluster long, cue_offset long, error string")


def _digest(text: bytes) -> tuple:
    media = mux(padded(text))
    parsed = demux(media)
    back = read_payload(media, parsed)
    return len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature(back, parsed)


def media_digests(df: DataFrame) -> DataFrame:
    """Stores, reads back and measures every text of (doc_id, text); media live only inside the task, a document at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for b in batches:
            columns = list(zip(*(_digest(t or b"") for t in as_bytes(b.column(1))), strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    bounded_batches(df.sparkSession)
    return df.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(table(spark, sf_dir, "documents"))
