"""Matroska as media columns: bytes muxed to EBML, and EBML parsed into packet tables.

The writer puts 8-bit samples in frames of FRAME bytes on one PCM track: clusters of SimpleBlocks,
each with one frame or several under fixed-size, EBML or Xiph lacing, and cues at the clusters. The
reader is general: variable-length ids and sizes (also unknown sizes), SimpleBlocks and
BlockGroups, all lacings, cues; every packet comes with its track, timestamp, flags and byte range.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import columns

FRAME = 576
RATE = 8000
# Element ids of the public EBML and Matroska specifications.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS = 0xAE, 0xE1, 0xA0, 0xBB, 0xB7
TIMESTAMP, SIMPLE_BLOCK, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA1, 0x9B
CUE_TIME, CUE_TRACK, CUE_CLUSTER = 0xB3, 0xF7, 0xF1
TRACK_NUMBER, TRACK_TYPE, CODEC, SAMPLING, CHANNELS, DEPTH = 0xD7, 0x83, 0x86, 0xB5, 0x9F, 0x6264
SCALE, DURATION, DOC_TYPE = 0x2AD7B1, 0x4489, 0x4282
MASTERS = {SEGMENT, INFO, TRACKS, CLUSTER, CUES, TRACK_ENTRY, AUDIO, BLOCK_GROUP, CUE_POINT, CUE_POSITIONS}
TOP = {INFO, TRACKS, CLUSTER, CUES, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469}
NO_LACE, XIPH, FIXED, EBML_LACE = 0, 1, 2, 3


def _size(n: int) -> bytes:
    k = 1
    while n >= (1 << 7 * k) - 1:
        k += 1
    return ((1 << 7 * k) | n).to_bytes(k, "big")


def _el(ident: int, data: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(data)) + data


def _uint(ident: int, n: int) -> bytes:
    return _el(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = _el(EBML, _uint(0x4286, 1) + _uint(0x42F7, 1) + _uint(0x42F2, 4) + _uint(0x42F3, 8) + _el(DOC_TYPE, b"matroska") + _uint(0x4287, 4) + _uint(0x4285, 2))
_TRACKS = _el(
    TRACKS,
    _el(TRACK_ENTRY, _uint(TRACK_NUMBER, 1) + _uint(0x73C5, 1) + _uint(TRACK_TYPE, 2) + _el(CODEC, b"A_PCM/INT/LIT") + _el(AUDIO, _el(SAMPLING, struct.pack(">d", RATE)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))),
)
_MS = FRAME * 1000 // RATE


def _laced(frames: list[bytes], lacing: int, when: int) -> bytes:
    head = b"\x81" + struct.pack(">h", when) + bytes([0x80 | lacing << 1])
    if lacing == NO_LACE:
        return _el(SIMPLE_BLOCK, head + frames[0])
    body = bytes([len(frames) - 1])
    if lacing == XIPH:
        body += b"".join(b"\xff" * (len(f) // 255) + bytes([len(f) % 255]) for f in frames[:-1])
    elif lacing == EBML_LACE:
        body += _size(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            d = len(b) - len(a)
            k = 1
            while not -(1 << 7 * k - 1) < d < 1 << 7 * k - 1:
                k += 1
            body += ((1 << 7 * k) | (d + (1 << 7 * k - 1) - 1)).to_bytes(k, "big")
    return _el(SIMPLE_BLOCK, head + body + b"".join(frames))


def mux(payload: bytes, per_block: int = 8, blocks: int = 16) -> bytes:
    """The payload (a positive multiple of FRAME bytes) as a Matroska file; the same bytes give the same file."""
    if not payload or len(payload) % FRAME:
        raise ValueError(f"the payload must be a positive multiple of {FRAME} bytes")
    frames = [payload[i : i + FRAME] for i in range(0, len(payload), FRAME)]
    clusters, step = [], per_block * blocks
    for at in range(0, len(frames), step):
        body = [_uint(TIMESTAMP, at * _MS)]
        for k, b in enumerate(range(at, min(at + step, len(frames)), per_block)):
            some = frames[b : min(b + per_block, at + step)]
            body.append(_laced(some, NO_LACE if len(some) == 1 else (FIXED, EBML_LACE, XIPH)[k % 3], (b - at) * _MS))
        clusters.append((at * _MS, _el(CLUSTER, b"".join(body))))
    front = _el(INFO, _uint(SCALE, 1_000_000) + _el(DURATION, struct.pack(">d", len(frames) * _MS)) + _el(0x4D80, b"arborist") + _el(0x5741, b"arborist")) + _TRACKS
    cues, at = [], len(front)
    for when, c in clusters:
        cues.append(_el(CUE_POINT, _uint(CUE_TIME, when) + _el(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        at += len(c)
    return _HEAD + _el(SEGMENT, front + b"".join(c for _, c in clusters) + _el(CUES, b"".join(cues)))


def _vint(b: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A variable-length number and its length; keep: with its marker, as ids are."""
    first = b[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(b):
        raise ValueError(f"no EBML number at byte {at}")
    n = int.from_bytes(b[at : at + k], "big")
    return (n if keep else n & ((1 << 7 * k) - 1)), k


def elements(b: bytes, at: int = 0, end: int | None = None, depth: int = 0) -> Iterator[tuple[int, int, int, int, int]]:
    """(depth, id, start, start of the data, end) of every element, masters before what they hold."""
    end = len(b) if end is None else end
    while at < end:
        ident, k = _vint(b, at, True)
        size, m = _vint(b, at + k, False)
        data = at + k + m
        unknown = size == (1 << 7 * m) - 1
        stop = end if unknown else data + size
        if stop > end:
            raise ValueError(f"element {ident:#x} at byte {at} ends after what holds it")
        if unknown and ident == CLUSTER:  # it ends where the next element of its own level begins
            stop = data
            while stop < end:
                i, kk = _vint(b, stop, True)
                if i in TOP:
                    break
                s, mm = _vint(b, stop + kk, False)
                stop += kk + mm + s
        yield depth, ident, at, data, stop
        if ident in MASTERS or ident == EBML:
            yield from elements(b, data, stop, depth + 1)
        at = stop


def _frames(b: bytes, data: int, end: int) -> tuple[int, int, int, int, list[tuple[int, int]]]:
    """track, relative timestamp, flags, lacing, and (start, length) of each frame of one block."""
    track, k = _vint(b, data, False)
    when = struct.unpack_from(">h", b, data + k)[0]
    flags = b[data + k + 2]
    at, lacing = data + k + 3, flags >> 1 & 3
    if lacing == NO_LACE:
        return track, when, flags, lacing, [(at, end - at)]
    n = b[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % n:
            raise ValueError("fixed-size lacing with a rest")
        sizes = [(end - at) // n] * (n - 1)
    elif lacing == XIPH:
        for _ in range(n - 1):
            s = 0
            while b[at] == 255:
                s += 255
                at += 1
            sizes.append(s + b[at])
            at += 1
    else:
        for i in range(n - 1):
            v, k = _vint(b, at, False)
            at += k
            sizes.append(v if not i else sizes[-1] + v - ((1 << 7 * k - 1) - 1))
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames are longer than their block")
    out = []
    for s in sizes:
        out.append((at, s))
        at += s
    return track, when, flags, lacing, out


def demux(b: bytes) -> dict:
    """packets: (track, timestamp in ms, keyframe, lacing, cluster, start, length); cues: (time in ms, track, byte of its cluster); tracks; info."""
    out: dict = {"packets": [], "cues": [], "tracks": [], "scale": 1_000_000, "duration": 0.0, "clusters": 0}
    segment, base, cue, step = 0, 0, {}, _MS
    num = lambda d, e: int.from_bytes(b[d:e], "big")
    real = lambda d, e: struct.unpack(">d" if e - d == 8 else ">f", b[d:e])[0] if e > d else 0.0
    for _, ident, _, data, end in elements(b):
        if ident == SEGMENT:
            segment = data
        elif ident == SCALE:
            out["scale"] = num(data, end)
        elif ident == DURATION:
            out["duration"] = real(data, end)
        elif ident == TRACK_ENTRY:
            out["tracks"].append({})
        elif ident in (TRACK_NUMBER, TRACK_TYPE, CHANNELS, DEPTH):
            out["tracks"][-1][ident] = num(data, end)
        elif ident == SAMPLING:
            out["tracks"][-1][ident] = real(data, end)
        elif ident == CODEC:
            out["tracks"][-1][ident] = b[data:end].decode()
        elif ident == CLUSTER:
            out["clusters"] += 1
            base = 0
        elif ident == TIMESTAMP:
            base = num(data, end)
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, when, flags, lacing, frames = _frames(b, data, end)
            scale = out["scale"] / 1e6
            for i, (start, length) in enumerate(frames):
                out["packets"].append((track, (base + when + i * step) * scale, bool(flags & 0x80), lacing, out["clusters"] - 1, start, length))
        elif ident == CUE_TIME:
            cue = {"time": num(data, end)}
        elif ident == CUE_TRACK:
            cue["track"] = num(data, end)
        elif ident == CUE_CLUSTER:
            out["cues"].append((cue["time"] * out["scale"] / 1e6, cue["track"], segment + num(data, end)))
    return out


PACKETS = "key long, packet int, track int, timestamp_ms double, keyframe boolean, lacing int, cluster int, start long, length long, error string"


def packets(files: DataFrame, id_col: str, data_col: str) -> DataFrame:
    """The packet table of Matroska files in a binary column: a row for each packet.

    A null or broken file gives one row with the reason in error and nulls otherwise; an empty table
    gives no rows; other columns are left out.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in PACKETS.split(", ")]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
        for b in batches:
            for i in range(b.num_rows):
                key, data = b.column(0)[i].as_py(), b.column(1)[i].as_py()
                try:
                    if data is None:
                        raise ValueError("null")
                    rows = [(key, k, *p, None) for k, p in enumerate(demux(data)["packets"])]
                except (ValueError, IndexError, struct.error, KeyError) as why:
                    rows = [(key, *[None] * 8, str(why)[:200])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return columns(files, (id_col, "key", "long"), (data_col, "data", "binary")).mapInArrow(work, PACKETS)


def store_text(text: str | None) -> tuple[int, bytes]:
    """Length of the UTF-8 bytes, and the Matroska file that holds them, filled with 255 to whole frames."""
    raw = (text or "").encode("utf-8")
    return len(raw), mux(raw + b"\xff" * (max(1, -(-len(raw) // FRAME)) * FRAME - len(raw)))


def digest(media: bytes) -> tuple:
    """payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature: all from the stored bytes, read back."""
    found = demux(media)
    payload = b"".join([media[p[5] : p[5] + p[6]] for p in found["packets"]])
    hist = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    at = np.arange(256)
    mean = float((hist * at).sum() / len(payload))
    power = float((hist * at * at).sum() / len(payload))
    used = hist[hist > 0] / len(payload)
    lacings = "".join(str(sum(p[3] == k for p in found["packets"])) + "/" for k in range(4))[:-1]
    feature = (
        f"codec={found['tracks'][0][CODEC]};packets={len(found['packets'])};clusters={found['clusters']};cues={len(found['cues'])};lacing={lacings}"
        f";ms={found['packets'][-1][1] + _MS:.0f};mean={mean:.4f};rms={power**0.5:.4f};entropy={float(-(used * np.log2(used)).sum()):.4f}"
    )
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), feature


MEDIA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text muxed, read back and described; a null text counts as empty, a null id stays null.

    Repeated rows give repeated rows, other columns are left out, an empty table gives no rows.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        names = [x.split()[0] for x in MEDIA.split(", ")]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                s = b.slice(at, 256)
                rows = []
                for key, text in zip(s.column(0).to_pylist(), s.column(1).to_pylist()):
                    n, media = store_text(text)
                    rows.append((key, n, *digest(media)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

    return columns(docs, (id_col, "doc_id", "long"), (text_col, "text", "string")).mapInArrow(work, MEDIA)
