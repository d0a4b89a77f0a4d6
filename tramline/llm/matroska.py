"""Matroska media: writing losslessly, and parsing into packet tables.

The parser reads EBML elements of variable length (unknown sizes included), tracks, clusters,
simple blocks and block groups with all four lacings, and cues. Each frame becomes one packet with
its track, timestamp and byte range in the file.

Malformed bytes raise ValueError; elements that are not known are skipped.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm.common import table

# Element identifiers and block flags of the Matroska format (fixed values).
EBML, SEGMENT = 0x1A45DFA3, 0x18538067
EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
INFO, TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x86
FLAG_LACING, DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x9C, 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACING, XIPH_LACING, FIXED_LACING, EBML_LACING = 0, 1, 2, 3
AUDIO_TRACK = 2

SAMPLE_RATE = 8000
#: One frame is this many samples: 128 ms at 8 kHz.
FRAME_BYTES = 1024
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 16
PAD = 64


# ---- writing ----


def _size(n: int) -> bytes:
    width = next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


def _float(ident: int, value: float) -> bytes:
    return _element(ident, np.array(value, ">f8").tobytes())


def _laced(frames: list[bytes]) -> tuple[int, bytes]:
    """Flags and body of a block: fixed lacing for equal frames, else EBML lacing."""
    if len(frames) == 1:
        return NO_LACING, frames[0]
    if len({len(f) for f in frames}) == 1:
        return FIXED_LACING, bytes([len(frames) - 1]) + b"".join(frames)
    head = _size(len(frames[0]))
    for before, now in zip(frames, frames[1:-1]):
        step = len(now) - len(before)
        width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
        head += ((1 << 7 * width) | (step + (1 << 7 * width - 1) - 1)).to_bytes(width, "big")
    return EBML_LACING, bytes([len(frames) - 1]) + head + b"".join(frames)


_HEADER = _element(
    EBML,
    _uint(EBML_VERSION, 1) + _uint(EBML_READ_VERSION, 1) + _uint(EBML_MAX_ID, 4) + _uint(EBML_MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_TYPE_VERSION, 4) + _uint(DOC_TYPE_READ_VERSION, 2),
)
_FRAME_MS = FRAME_BYTES * 1000 // SAMPLE_RATE


def write_media(payload: bytes) -> bytes:
    """A Matroska file with one track of unsigned 8-bit mono samples: the payload's bytes, one for one."""
    info = _element(INFO, _uint(TIMESTAMP_SCALE, 1_000_000) + _float(DURATION, len(payload) * 1000 / SAMPLE_RATE) + _element(MUXING_APP, b"tramline") + _element(WRITING_APP, b"tramline"))
    sound = _element(AUDIO, _float(SAMPLING_FREQUENCY, SAMPLE_RATE) + _uint(CHANNELS, 1) + _uint(BIT_DEPTH, 8))
    entry = _uint(TRACK_NUMBER, 1) + _uint(TRACK_UID, 1) + _uint(TRACK_TYPE, AUDIO_TRACK) + _uint(FLAG_LACING, 1) + _uint(DEFAULT_DURATION, _FRAME_MS * 1_000_000) + _element(CODEC_ID, b"A_PCM/INT/LIT") + sound
    parts = [info, _element(TRACKS, _element(TRACK_ENTRY, entry))]
    at, cues = sum(map(len, parts)), []
    per_block = FRAME_BYTES * FRAMES_PER_BLOCK
    per_cluster = per_block * BLOCKS_PER_CLUSTER
    for begin in range(0, len(payload), per_cluster):
        time = begin * 1000 // SAMPLE_RATE
        blocks = [_uint(TIMESTAMP, time)]
        for start in range(begin, min(begin + per_cluster, len(payload)), per_block):
            part = payload[start : min(start + per_block, begin + per_cluster)]
            flags, body = _laced([part[i : i + FRAME_BYTES] for i in range(0, len(part), FRAME_BYTES)])
            relative = start * 1000 // SAMPLE_RATE - time
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + relative.to_bytes(2, "big", signed=True) + bytes([0x80 | flags << 1]) + body))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER_POSITION, at))))
        at += len(cluster)
        parts.append(cluster)
    return _HEADER + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


# ---- parsing ----


def _vint(data: memoryview, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, whether all value bits are set) of the variable-length number at `at`."""
    if at >= len(data) or not data[at]:
        raise ValueError(f"no variable-length number at byte {at}")
    width = 9 - data[at].bit_length()
    if at + width > len(data):
        raise ValueError(f"the number at byte {at} is cut short")
    raw = int.from_bytes(data[at : at + width], "big")
    value = raw & ((1 << 7 * width) - 1)
    return raw if keep_marker else value, at + width, value == (1 << 7 * width) - 1


_TOP_LEVEL = {CLUSTER, CUES, INFO, TRACKS, SEGMENT, EBML, 0x1254C367, 0x1043A770, 0x1941A469, 0x114D9B74}


def elements(data: memoryview, at: int, end: int, inside: int = 0) -> Iterator[tuple[int, int, int]]:
    """(identifier, body start, body end) of the elements between two positions.

    An element of unknown size ends at the parent's end or, for a cluster, where the next top-level
    element begins.
    """
    while at < end:
        ident, body, _ = _vint(data, at, keep_marker=True)
        size, body, unknown = _vint(data, body)
        if unknown:
            stop = end
            if ident == CLUSTER:
                stop = body
                while stop < end:
                    child, inner, _ = _vint(data, stop, keep_marker=True)
                    if child in _TOP_LEVEL:
                        break
                    length, inner, _ = _vint(data, inner)
                    stop = inner + length
        else:
            stop = body + size
        if stop > end:
            raise ValueError(f"the element at byte {at} runs past its parent")
        yield ident, body, stop
        at = stop


def _number(data: memoryview, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def _real(data: memoryview, start: int, end: int) -> float:
    return float(np.frombuffer(data[start:end], ">f4" if end - start == 4 else ">f8")[0]) if end > start else 0.0


def _frame_sizes(data: memoryview, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    """(start of the first frame, sizes) of a block's body."""
    if lacing == NO_LACING:
        return at, [end - at]
    if at >= end:
        raise ValueError("a laced block without a frame count")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED_LACING:
        if (end - at) % count:
            raise ValueError("fixed lacing of unequal frames")
        return at, [(end - at) // count] * count
    for i in range(count - 1):
        if lacing == XIPH_LACING:
            size = 0
            while True:
                if at >= end:
                    raise ValueError("a cut lace")
                byte, at = data[at], at + 1
                size += byte
                if byte < 255:
                    break
        elif i == 0:
            size, at, _ = _vint(data, at)
        else:
            before = at
            raw, at, _ = _vint(data, at)
            size = sizes[-1] + raw - ((1 << 7 * (at - before) - 1) - 1)
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames larger than their block")
    return at, sizes


@dataclass
class Media:
    """A parsed file. packets: (track, cluster, block, lace, timestamp_ns, start, length, keyframe)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    packets: list[tuple] = field(default_factory=list)
    clusters: list[tuple[int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int]] = field(default_factory=list)


def parse_media(raw: bytes) -> Media:
    """The tracks, packets, clusters (position in the segment, time) and cues (time, track, position) of a file."""
    data, media, base = memoryview(raw), Media(), 0
    top = list(elements(data, 0, len(data)))
    if not top or top[0][0] != EBML:
        raise ValueError("no EBML header")
    for ident, start, end in top:
        if ident != SEGMENT:
            continue
        base = start
        held = []
        for child, s, e in elements(data, start, end):
            if child == INFO:
                for x, a, b in elements(data, s, e):
                    if x == TIMESTAMP_SCALE:
                        media.scale = _number(data, a, b)
                    elif x == DURATION:
                        media.duration = _real(data, a, b)
            elif child == TRACKS:
                for x, a, b in elements(data, s, e):
                    if x == TRACK_ENTRY:
                        track = _track(data, a, b)
                        media.tracks[track["number"]] = track
            elif child == CLUSTER:
                held.append((s, e))
            elif child == CUES:
                media.cues += _cues(data, s, e)
        for s, e in held:
            _cluster(data, s, e, base, media)
    return media


def _track(data: memoryview, start: int, end: int) -> dict:
    track: dict = {"number": 0, "type": 0, "codec": "", "rate": 0.0, "channels": 1, "bits": 0, "frame_ns": 0}
    plain = {TRACK_NUMBER: "number", TRACK_TYPE: "type", DEFAULT_DURATION: "frame_ns", CHANNELS: "channels", BIT_DEPTH: "bits"}
    todo = [(start, end)]
    while todo:
        for x, a, b in elements(data, *todo.pop()):
            if x in plain:
                track[plain[x]] = _number(data, a, b)
            elif x == CODEC_ID:
                track["codec"] = bytes(data[a:b]).rstrip(b"\0").decode("ascii", "replace")
            elif x == SAMPLING_FREQUENCY:
                track["rate"] = _real(data, a, b)
            elif x == AUDIO:
                todo.append((a, b))
    return track


def _cues(data: memoryview, start: int, end: int) -> list[tuple[int, int, int]]:
    found = []
    for x, a, b in elements(data, start, end):
        if x != CUE_POINT:
            continue
        time, places = 0, []
        for y, c, d in elements(data, a, b):
            if y == CUE_TIME:
                time = _number(data, c, d)
            elif y == CUE_TRACK_POSITIONS:
                got = {z: _number(data, p, q) for z, p, q in elements(data, c, d)}
                places.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, 0)))
        found += [(time, *place) for place in places]
    return found


def _cluster(data: memoryview, start: int, end: int, base: int, media: Media) -> None:
    time, nth = 0, len(media.clusters)
    head = 0
    for x, a, b in elements(data, start, end):
        if x == TIMESTAMP:
            time = _number(data, a, b)
        elif x == SIMPLE_BLOCK:
            _block(data, a, b, time, nth, None, media)
        elif x == BLOCK_GROUP:
            inner = list(elements(data, a, b))
            for y, c, d in inner:
                if y == BLOCK:
                    _block(data, c, d, time, nth, all(z != 0xFB for z, _, _ in inner), media)
    # Cues point to the cluster's identifier, which precedes its size.
    for width in range(1, 9):
        if start - width - 4 >= 0 and _number(data, start - width - 4, start - width) == CLUSTER:
            head = start - width - 4
            break
    media.clusters.append((head - base, time))


def _block(data: memoryview, start: int, end: int, time: int, cluster: int, key: bool | None, media: Media) -> None:
    number, at, _ = _vint(data, start)
    if at + 3 > end:
        raise ValueError("a cut block header")
    relative = int.from_bytes(data[at : at + 2], "big", signed=True)
    flags, at = data[at + 2], at + 3
    at, sizes = _frame_sizes(data, at, end, flags >> 1 & 3)
    stamp = (time + relative) * media.scale
    step = media.tracks.get(number, {}).get("frame_ns", 0)
    keyframe = bool(flags & 0x80) if key is None else key
    block = media.packets[-1][2] + 1 if media.packets else 0
    for lace, size in enumerate(sizes):
        media.packets.append((number, cluster, block, lace, stamp + lace * step, at, size, keyframe))
        at += size


def read_payload(raw: bytes, media: Media, track: int) -> bytes:
    """The track's bytes in the order of the packets."""
    return b"".join(raw[p[5] : p[5] + p[6]] for p in media.packets if p[0] == track)


# ---- DataFrames ----

PACKETS = "track int, cluster int, block int, lace int, timestamp_ns long, start long, length long, keyframe boolean"


def packet_table(files: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row for each packet of each file: id and PACKETS. Null media have none; the rows of a
    file stay together in file order."""
    kind = files.schema[id_col].dataType.simpleString()
    out = pa.schema([("track", pa.int32()), ("cluster", pa.int32()), ("block", pa.int32()), ("lace", pa.int32()), ("timestamp_ns", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("keyframe", pa.bool_())])

    def run(batches):
        for batch in batches:
            for ident, raw in zip(batch.column(0), batch.column(1)):
                packets = parse_media(raw.as_py()).packets if raw.is_valid else []
                for at in range(0, len(packets), 10_000):
                    part = packets[at : at + 10_000]
                    columns = [pa.array(c, f.type) for c, f in zip(zip(*part), out)]
                    yield pa.RecordBatch.from_arrays([pa.array([ident.as_py()] * len(part), batch.schema.field(0).type), *columns], names=[id_col, *out.names])

    return files.select(id_col, media_col).mapInArrow(run, f"`{id_col}` {kind}, {PACKETS}")


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's padded UTF-8 bytes as a Matroska file."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for one in _slices(batch):
                raw = [_bytes(t) for t in one.column(1).to_pylist()]
                media = pa.array([write_media(padded(r)) for r in raw], pa.large_binary())
                yield pa.RecordBatch.from_arrays([one.column(0), pa.array(map(len, raw), pa.int64()), media.cast(pa.binary())], names=[id_col, "n_bytes", "media"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def _slices(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def padded(raw: bytes) -> bytes:
    """raw with bytes 0 appended up to a positive multiple of 64 bytes."""
    return raw + bytes(max(PAD, -(-len(raw) // PAD) * PAD) - len(raw))


def features(raw: bytes, media: Media, payload: bytes) -> str:
    """What the file tells: counts, duration and the samples' level, spread and crossings of the middle."""
    wave = np.frombuffer(payload, np.uint8)
    crossings = int(np.count_nonzero(np.diff((wave >= 128).view(np.int8))))
    seekable = sum(1 for _, _, at in media.cues if any(at == place for place, _ in media.clusters)) if len(media.clusters) < 64 else len({at for _, _, at in media.cues} & {place for place, _ in media.clusters})
    last = media.packets[-1][4] // 1_000_000 if media.packets else 0
    squares = int(np.dot(wave.astype(np.int64), wave.astype(np.int64)))
    return f"packets={len(media.packets)};blocks={media.packets[-1][2] + 1 if media.packets else 0};clusters={len(media.clusters)};cues={seekable};last_ms={last};sum={int(wave.sum(dtype=np.int64))};squares={squares};crossings={crossings}"


DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def digests(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The digest columns of stored files (id, n_bytes, media), from the bytes read back through their packets."""
    kind = files.schema[id_col].dataType.simpleString()
    names = [id_col, *(x.split()[0] for x in DIGEST.split(", "))]

    def run(batches):
        for batch in batches:
            rows = []
            for media_bytes in batch.column(2):
                raw = media_bytes.as_py()
                media = parse_media(raw)
                payload = read_payload(raw, media, 1)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAD:]), len(raw), hashlib.sha256(raw).hexdigest(), features(raw, media, payload)))
            cols = list(zip(*rows)) if rows else [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    return files.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, {DIGEST}")


def op1_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document stored as Matroska, read back and digested. Null texts count as empty."""
    return digests(store_texts(table(spark, sf_dir, "documents")))
