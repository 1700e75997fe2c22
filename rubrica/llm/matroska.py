"""Matroska media columns: EBML elements, clusters, lacing and cues parsed into packet tables.

``demux`` reads the bytes of a Matroska file: variable-length element ids and sizes (unknown sizes of segments and
clusters too), tracks, clusters, simple blocks and block groups with any of the four lacings, and cues. It gives a packet
for each laced frame with track, timestamp in nanoseconds, key flag and byte range. ``mux`` writes bytes as one track of
8-bit samples in frames of ``FRAME`` bytes. ``packet_table`` applies ``demux`` to a binary column; ``store_texts`` and
``text_media`` keep texts as audio and read them back.

Null media give no packets; null texts count as empty, whose padded payload is one frame. Rows are independent, so repeated
rows repeat, an empty table gives an empty result, and other columns, whatever their names, are neither read nor returned. Bytes that aren't Matroska, or
end early, raise ``MatroskaError``; ``packet_table(errors="row")`` turns that into one row with a message instead.
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

from .common import arrow_map, slices, table, texts_of

FRAME = 576
RATE = 48_000
FRAMES_A_BLOCK = 8
BLOCKS_A_CLUSTER = 32
PAD = b"\xff"

#: Element ids that Matroska fixes.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP = {SEEK_HEAD, INFO, TRACKS, CLUSTER, CUES, TAGS, CHAPTERS, ATTACHMENTS}
DOC_TYPE, SCALE, DURATION, TRACK, NUMBER, KIND, CODEC = 0x4282, 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x83, 0x86
AUDIO, FREQUENCY, CHANNELS, DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE, GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_PLACES, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


class MatroskaError(ValueError):
    pass


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    key: bool
    cluster: int
    block: int
    offset: int
    size: int


class Media(NamedTuple):
    tracks: dict[int, dict]
    packets: list[Packet]
    clusters: list[int]
    cues: list[tuple[int, int, int]]
    duration_ns: float


def vint(data: bytes, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """(value, next position, unknown) of the variable-length integer at ``at``."""
    if at >= len(data) or not data[at]:
        raise MatroskaError(f"no variable-length integer at byte {at}")
    n = 9 - data[at].bit_length()
    if at + n > len(data):
        raise MatroskaError(f"integer at byte {at} is cut off")
    raw = int.from_bytes(data[at : at + n])
    value = raw & ((1 << 7 * n) - 1)
    return (raw if keep_marker else value), at + n, value == (1 << 7 * n) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int]]:
    """(id, start of the element, start and end of its body) of the elements side by side in ``data[at:end]``."""
    while at < end:
        ident, body, _ = vint(data, at, True)
        size, body, unknown = vint(data, body)
        if unknown:
            if ident not in (SEGMENT, CLUSTER):
                raise MatroskaError(f"element {ident:x} at byte {at} has no size")
            stop = end if ident == SEGMENT else _cluster_end(data, body, end)
        else:
            stop = body + size
        if stop > end:
            raise MatroskaError(f"element {ident:x} at byte {at} ends behind its parent")
        yield ident, at, body, stop
        at = stop


def _cluster_end(data: bytes, at: int, end: int) -> int:
    while at < end:
        ident, body, _ = vint(data, at, True)
        if ident in TOP:
            return at
        size, body, _ = vint(data, body)
        at = body + size
    return at


def uint(data: bytes, at: int, end: int) -> int:
    return int.from_bytes(data[at:end])


def real(data: bytes, at: int, end: int) -> float:
    if end - at not in (0, 4, 8) or end > len(data):
        raise MatroskaError(f"number of {end - at} bytes at byte {at}")
    return struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0] if end > at else 0.0


def laced(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """Byte ranges (offset, size) of the frames in a block's body."""
    if lacing == NO_LACE:
        return [(at, end - at)]
    if at >= end:
        raise MatroskaError(f"lacing at byte {at} is cut off")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise MatroskaError(f"fixed lacing at byte {at} doesn't divide its block")
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == XIPH:
        for _ in range(n - 1):
            size = 0
            while at < end and data[at] == 255:
                size, at = size + 255, at + 1
            if at >= end:
                raise MatroskaError(f"lacing before byte {at} is cut off")
            sizes.append(size + data[at])
            at += 1
    else:
        for i in range(n - 1):
            value, after, _ = vint(data, at)
            sizes.append(value if not i else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1))
            at = after
    last = end - at - sum(sizes)
    if last < 0 or min(sizes, default=0) < 0:
        raise MatroskaError(f"lacing before byte {at} goes beyond its block")
    out = []
    for size in [*sizes, last]:
        out.append((at, size))
        at += size
    return out


def demux(data: bytes) -> Media:
    top = elements(data, 0, len(data))
    first = next(top, None)
    if not first or first[0] != EBML:
        raise MatroskaError("no EBML head")
    kinds = [data[b:e] for i, _, b, e in elements(data, first[2], first[3]) if i == DOC_TYPE]
    if kinds and kinds[0].rstrip(b"\0") not in (b"matroska", b"webm"):
        raise MatroskaError(f"document type {kinds[0]!r}")
    tracks: dict[int, dict] = {}
    found: list[tuple] = []
    clusters: list[int] = []
    cues: list[tuple[int, int, int]] = []
    scale, duration = 1_000_000, 0.0
    for ident, _, body, end in top:
        if ident != SEGMENT:
            continue
        for part, start, b, e in elements(data, body, end):
            if part == INFO:
                for i, _, x, y in elements(data, b, e):
                    scale = uint(data, x, y) if i == SCALE else scale
                    duration = real(data, x, y) if i == DURATION else duration
            elif part == TRACKS:
                for i, _, x, y in elements(data, b, e):
                    if i == TRACK:
                        track = _track(data, x, y)
                        tracks[track["number"]] = track
            elif part == CLUSTER:
                clusters.append(start)
                _cluster(data, b, e, len(clusters) - 1, found)
            elif part == CUES:
                for i, _, x, y in elements(data, b, e):
                    if i == CUE_POINT:
                        cues += _cue(data, x, y, body)
    packets = []
    for cluster, block, track, ticks, key, span, frames in found:
        default = tracks.get(track, {}).get("frame_ns") or (span * scale // len(frames) if span else 0)
        packets += [Packet(track, ticks * scale + k * default, key, cluster, block, o, n) for k, (o, n) in enumerate(frames)]
    return Media(tracks, packets, clusters, cues, duration * scale)


def _track(data: bytes, at: int, end: int) -> dict:
    out = {"number": 0, "kind": 0, "codec": "", "rate": 8000.0, "channels": 1, "depth": 0, "frame_ns": 0}
    for i, _, b, e in elements(data, at, end):
        if i == NUMBER:
            out["number"] = uint(data, b, e)
        elif i == KIND:
            out["kind"] = uint(data, b, e)
        elif i == CODEC:
            out["codec"] = data[b:e].decode("ascii", "replace").rstrip("\0")
        elif i == 0x23E383:  # default duration of a frame
            out["frame_ns"] = uint(data, b, e)
        elif i == AUDIO:
            for j, _, x, y in elements(data, b, e):
                if j == FREQUENCY:
                    out["rate"] = real(data, x, y)
                elif j == CHANNELS:
                    out["channels"] = uint(data, x, y)
                elif j == DEPTH:
                    out["depth"] = uint(data, x, y)
    return out


def _cluster(data: bytes, at: int, end: int, cluster: int, found: list) -> None:
    base, block = 0, 0
    for i, _, b, e in elements(data, at, end):
        if i == TIMESTAMP:
            base = uint(data, b, e)
        elif i in (SIMPLE, GROUP):
            span, key, range_ = 0, None, (b, e)
            if i == GROUP:
                key = True
                for j, _, x, y in elements(data, b, e):
                    if j == BLOCK:
                        range_ = (x, y)
                    elif j == BLOCK_DURATION:
                        span = uint(data, x, y)
                    elif j == REFERENCE:
                        key = False
            b, e = range_
            track, b, _ = vint(data, b)
            if b + 3 > e:
                raise MatroskaError(f"block at byte {b} is cut off")
            ticks, flags = struct.unpack(">hB", data[b : b + 3])
            found.append((cluster, block, track, base + ticks, bool(flags & 0x80) if key is None else key, span, laced(data, b + 3, e, flags >> 1 & 3)))
            block += 1


def _cue(data: bytes, at: int, end: int, segment: int) -> list[tuple[int, int, int]]:
    time, out = 0, []
    for i, _, b, e in elements(data, at, end):
        if i == CUE_TIME:
            time = uint(data, b, e)
        elif i == CUE_PLACES:
            got = {j: uint(data, x, y) for j, _, x, y in elements(data, b, e)}
            out.append((got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER, 0) + segment))
    return [(time, track, place) for track, place in out]


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return (n | 1 << 7 * k).to_bytes(k)


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8) + _size(len(body)) + body


def _uint(ident: int, value: int) -> bytes:
    return _element(ident, value.to_bytes(max(1, (value.bit_length() + 7) // 8)))


def lace(frames: list[bytes], lacing: int) -> bytes:
    """A block's body after its flags."""
    if lacing == NO_LACE:
        return frames[0]
    head = bytes([len(frames) - 1])
    sizes = [len(f) for f in frames[:-1]]
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes)
    elif lacing == EBML_LACE and sizes:
        head += _size(sizes[0])
        for a, b in zip(sizes, sizes[1:], strict=False):
            k = next(k for k in range(1, 9) if abs(b - a) < (1 << 7 * k - 1) - 1)
            head += (b - a + (1 << 7 * k - 1) - 1 | 1 << 7 * k).to_bytes(k)
    return head + b"".join(frames)


_HEAD = _element(EBML, b"".join(_uint(i, v) for i, v in ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8))) + _element(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_TRACKS = _element(TRACKS, _element(TRACK, _uint(NUMBER, 1) + _uint(0x73C5, 1) + _uint(KIND, 2) + _uint(0x9C, 1) + _uint(0x23E383, FRAME * 1_000_000_000 // RATE) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(FREQUENCY, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))))


def mux(payload: bytes, lacing: int = FIXED) -> bytes:
    """``payload``, a positive multiple of ``FRAME`` bytes, as one track of 8-bit samples, with cues for its clusters."""
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    ticks = FRAME * 1000 // RATE
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", float(len(frames) * ticks))) + _element(0x4D80, b"rubrica") + _element(0x5741, b"rubrica"))
    a_block = 1 if lacing == NO_LACE else FRAMES_A_BLOCK
    parts, place, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for c in range(0, len(frames), a_block * BLOCKS_A_CLUSTER):
        blocks = [_uint(TIMESTAMP, c * ticks)]
        for b in range(c, min(c + a_block * BLOCKS_A_CLUSTER, len(frames)), a_block):
            own = frames[b : b + a_block]
            how = lacing if len(own) > 1 else NO_LACE
            blocks.append(_element(SIMPLE, b"\x81" + struct.pack(">hB", (b - c) * ticks, 0x80 | how << 1) + lace(own, how)))
        parts.append(_element(CLUSTER, b"".join(blocks)))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, c * ticks) + _element(CUE_PLACES, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, place))))
        place += len(parts[-1])
    return _HEAD + _element(SEGMENT, b"".join(parts) + _element(CUES, b"".join(cues)))


def padded(text: str) -> tuple[bytes, int]:
    """UTF-8 of ``text`` up to a positive multiple of ``FRAME`` with bytes 255, and its length before that."""
    data = text.encode("utf-8", "surrogatepass")
    return data + PAD * (-len(data) % FRAME or (0 if data else FRAME)), len(data)


def track_bytes(data: bytes, media: Media, track: int) -> bytes:
    """The frames of a track in time order, joined."""
    own = sorted((p for p in media.packets if p.track == track), key=lambda p: (p.timestamp_ns, p.offset))
    return b"".join(data[p.offset : p.offset + p.size] for p in own)


def described(data: bytes, media: Media, payload: bytes) -> str:
    """Features of a file and of its first track's samples."""
    samples = np.frombuffer(payload, np.uint8)
    track = media.tracks[min(media.tracks)]
    steps = np.abs(np.diff(samples.astype(np.int16)))
    return (
        f"codec={track['codec']};rate={track['rate']:g};depth={track['depth']};tracks={len(media.tracks)};clusters={len(media.clusters)};"
        f"blocks={len({(p.cluster, p.block) for p in media.packets})};packets={len(media.packets)};cues={len(media.cues)};"
        f"duration_ms={media.duration_ns / 1e6:g};overhead={len(data) - len(payload)};mean={samples.mean():.4f};"
        f"deviation={samples.std():.4f};step={steps.mean():.4f};peak={int(samples.max())}"
    )


PACKETS = "track long, timestamp_ns long, is_key boolean, cluster long, block long, packet long, byte_offset long, byte_size long, error string"


def packet_table(df: DataFrame, media: str = "media", id_column: str = "doc_id", errors: str = "raise") -> DataFrame:
    """A row for each packet of each file in the binary column ``media``."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = StructType.fromDDL(f"{id_column} {df.schema[id_column].dataType.simpleString()}, {PACKETS}")
    arrow = to_arrow_schema(schema)

    def run(batches):
        for part in slices(batches, "__m"):
            rows = []
            for ident, data in zip(part.column("__i").to_pylist(), part.column("__m").to_pylist(), strict=True):
                if data is None:
                    continue
                try:
                    rows += [(ident, p.track, p.timestamp_ns, p.key, p.cluster, p.block, k, p.offset, p.size, None) for k, p in enumerate(demux(data).packets)]
                except MatroskaError as e:
                    if errors == "raise":
                        raise
                    rows.append((ident, *[None] * 8, str(e)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), arrow, strict=True)], schema=arrow)

    return df.selectExpr(f"`{id_column}` AS __i", f"`{media}` AS __m").mapInArrow(run, schema)


def store_texts(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """The id and ``media``: each text as a Matroska file."""
    kind = df.schema[id_column].dataType.simpleString()

    def part(batch: pa.RecordBatch) -> dict:
        return {id_column: batch.column("__i"), "media": [mux(padded(t)[0]) for t in texts_of(batch, "__t")]}

    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], f"{id_column} {kind}, media binary", part, "__t")


RESULT = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(df: DataFrame, text: str = "text", id_column: str = "doc_id") -> DataFrame:
    """A row for each row of ``df``: the text stored as media, read back from the stored bytes and described."""
    names = [x.split()[0] for x in RESULT.split(", ")]
    kind = df.schema[id_column].dataType.simpleString()

    def one(text: str) -> tuple:
        payload, n = padded(text)
        data = mux(payload)
        media = demux(data)
        back = track_bytes(data, media, 1)
        return (n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(data), hashlib.sha256(data).hexdigest(), described(data, media, back))

    def part(batch: pa.RecordBatch) -> dict:
        rows = [one(t) for t in texts_of(batch, "__t")]
        return {id_column: batch.column("__i")} | dict(zip(names, map(list, zip(*rows)), strict=True))

    return arrow_map(df.selectExpr(f"`{id_column}` AS __i", f"`{text}` AS __t"), ["__i", "__t"], f"{id_column} {kind}, {RESULT}", part, "__t")


def op8_matroska(spark, sf_dir) -> DataFrame:
    return text_media(table(spark, sf_dir, "documents"))
