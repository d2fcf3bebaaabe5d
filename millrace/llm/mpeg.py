"""MPEG audio as media columns: frames found and checked, tags and variable-bitrate tables parsed, exact durations and seek offsets.

`parse` takes any bytes: it reads an ID3v2 tag, walks MPEG-1/2/2.5 Layer I-III frames, looks for the next frame whose
successor is in place too when a header is damaged, verifies the CRC-16 of protected frames (over the side information in
Layer III, the bit allocation in Layer I, allocation and scale factor selection in Layer II), reads the Xing/Info or
VBRI table, whose frame is no audio, and an ID3v1 tag. Durations are sample counts over a rate, so they are exact. The
places of the audio frames are the seek offsets.

`store` is the lossless carrier that the query uses: Layer III frames at 48 kHz (so that a frame is 3 bytes per kbit/s)
with empty granules, whose main data area is ancillary data by the standard and carries the payload. Full frames have
320 kbit/s, the last one the smallest rate that holds the rest, so the stream is of variable bitrate and begins with a
Xing frame with its table of contents; the payload's size stands in an ID3v2 tag.

Each row is handled on its own: no shuffle; the media table is written and read once. Defined cases: a null text counts
as empty, which is 64 bytes of padding; equal texts give equal media and features; repeated rows and an empty table
need nothing special; bytes without any frame parse to zero frames and duration 0; other columns pass or take no part.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .work import cut, map_arrow, map_columns, table

#: kbit/s by (MPEG-1?, layer); index 0 is free format, 15 is forbidden.
RATES = {
    (True, 1): [0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448],
    (True, 2): [0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384],
    (True, 3): [0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320],
    (False, 1): [0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256],
    (False, 2): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
    (False, 3): [0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160],
}
HERTZ = {3: [44100, 48000, 32000], 2: [22050, 24000, 16000], 0: [11025, 12000, 8000]}


@lru_cache(4096)
def header(four: bytes) -> tuple | None:
    """(frame bytes, samples, rate, layer, side information bytes, protected, mpeg1) of a frame header, or None."""
    if len(four) < 4:
        return None
    x = int.from_bytes(four, "big")
    version, layer, rate, hz = x >> 19 & 3, 4 - (x >> 17 & 3), x >> 12 & 15, x >> 10 & 3
    if x >> 21 != 0x7FF or version == 1 or layer == 4 or rate in (0, 15) or hz == 3:
        return None
    one, mono, pad = version == 3, (x >> 6 & 3) == 3, x >> 9 & 1
    kbps, hertz = RATES[one, layer][rate], HERTZ[version][hz]
    samples = 384 if layer == 1 else 1152 if layer == 2 or one else 576
    size = (12000 * kbps // hertz + pad) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hertz + pad
    side = 0 if layer != 3 else (17 if mono else 32) if one else (9 if mono else 17)
    return size, samples, hertz, layer, side, not x >> 16 & 1, one


_CRC = []
for _i in range(256):
    _x = _i << 8
    for _ in range(8):
        _x = (_x << 1 ^ 0x8005 if _x & 0x8000 else _x << 1) & 0xFFFF
    _CRC.append(_x)


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The CRC of a protected frame, over its last two header bytes and the side information."""
    x = 0xFFFF
    for b in data:
        x = (x << 8 & 0xFF00) ^ _CRC[x >> 8 ^ b]
    return x


def _crc_bits(data: bytes, bits: int, x: int) -> int:
    """The CRC carried on over the first bits of data."""
    for i in range(bits):
        x = (x << 1 ^ 0x8005 if (x >> 15) ^ (data[i >> 3] >> (7 - (i & 7)) & 1) else x << 1) & 0xFFFF
    return x


#: Bits of allocation of a Layer II subband, in runs: for two tables of many subbands, the two of few, and low sampling rates.
_ALLOCATION = {27: [4] * 11 + [3] * 12 + [2] * 4, 30: [4] * 11 + [3] * 12 + [2] * 7, 8: [4, 4] + [3] * 6, 12: [4, 4] + [3] * 10, 0: [4] * 4 + [3] * 7 + [2] * 19}


def _guarded_bits(data: bytes, x: int, layer: int, hertz: int) -> int:
    """How many bits after the CRC of a Layer I or II frame with header x are covered; data begins there."""
    one, mode = x >> 19 & 3 == 3, x >> 6 & 3
    channels = 1 if mode == 3 else 2
    if layer == 1:
        bound = 4 * (x >> 4 & 3) + 4 if mode == 1 else 32
        return 4 * (channels * bound + 32 - bound)
    kbps = RATES[one, 2][x >> 12 & 15] // channels
    limit = 0 if not one else 27 if kbps >= 56 and (hertz == 48000 or kbps <= 80) else 30 if kbps >= 96 else 12 if hertz == 32000 else 8
    widths = _ALLOCATION[limit]
    bound = min(4 * (x >> 4 & 3) + 4 if mode == 1 else 32, len(widths))
    word, at, chosen = int.from_bytes(data[:64], "big") << 8 * max(0, 64 - len(data)), 0, 0
    for sb, width in enumerate(widths):
        for _ in range(channels if sb < bound else 1):
            if word >> (512 - at - width) & ((1 << width) - 1):
                chosen += 1 if sb < bound else channels
            at += width
    return at + 2 * chosen


def intact(frame: bytes, layer: int, hertz: int, side: int) -> bool:
    """Whether a protected frame's CRC holds."""
    said = int.from_bytes(frame[4:6], "big")
    if layer == 3:
        return crc16(frame[2:4] + frame[6 : 6 + side]) == said
    body = frame[6:]
    bits = _guarded_bits(body, int.from_bytes(frame[:4], "big"), layer, hertz)
    return bits <= 8 * len(body) and _crc_bits(body, bits, crc16(frame[2:4])) == said


def id3v2(data: bytes) -> tuple[int, dict[str, str]]:
    """The size of the tag at the start (0: none) and its text fields; TXXX fields by their description."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b > 127 for b in data[6:10]):
        return 0, {}
    size = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
    end, at, tags = min(10 + size, len(data)), 10, {}
    while at + 10 <= end and data[at]:
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if data[3] == 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : min(at + 10 + n, end)]
        if name[0] == "T" and body:
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            text = body[1:].decode(code, "replace").rstrip("\x00")
            key, _, value = text.partition("\x00") if name == "TXXX" else (name, "", text)
            tags[key] = value.lstrip("\ufeff")
        at += 10 + n
    return min(10 + size, len(data)), tags


def parse(data: bytes) -> dict:
    """What a stream holds: frames (place, header bytes, main data place, end), tags, table, checks and duration."""
    at, tags = id3v2(data)
    end = len(data)
    if end >= at + 128 and data[-128:-125] == b"TAG":
        end -= 128
        raw = data[-128:]
        for name, a in (("title", 3), ("artist", 33), ("album", 63)):
            if value := raw[a : a + 30].split(b"\x00")[0].decode("latin-1").strip():
                tags[name] = value
    places, bodies, samples, hertz, resyncs, bad, good, xing, skipped = [], [], 0, 0, 0, 0, 0, None, 0
    lost = False
    while at + 4 <= end:
        h = header(data[at : at + 4])
        whole = h is not None and at + h[0] <= end
        if whole and lost:  # after damage a frame counts if another or the end follows it
            nxt = at + h[0]
            whole = nxt + 4 > end or header(data[nxt : nxt + 4]) is not None
        if not whole:
            resyncs += not lost
            lost = True
            nxt = data.find(b"\xff", at + 1, end)
            skipped += (nxt if nxt >= 0 else end) - at
            at = nxt if nxt >= 0 else end
            continue
        size, n, rate, layer, side, protected, _ = h
        lost = False
        main = at + 4 + 2 * protected + side
        mark = data[main : main + 4] if not places and xing is None else b""
        if mark in (b"Xing", b"Info"):
            xing = _table(data, main)
        elif not places and xing is None and data[at + 36 : at + 40] == b"VBRI" and layer == 3:
            xing = _vbri(data[at + 36 : at + size])
        else:
            if protected:
                ok = intact(data[at : at + size], layer, rate, side)
                good, bad = good + ok, bad + (not ok)
            places.append(at)
            bodies.append((main, at + size))
            samples += n
            hertz = hertz or rate
        at += size
    return {"places": places, "bodies": bodies, "samples": samples, "hertz": hertz, "resyncs": resyncs, "skipped": skipped, "crc_good": good, "crc_bad": bad, "tags": tags, "xing": xing}


def _table(data: bytes, at: int) -> dict:
    flags = int.from_bytes(data[at + 4 : at + 8], "big")
    at += 8
    out: dict = {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(data[at : at + 4], "big")
            at += 4
    if flags & 4:
        out["toc"] = list(data[at : at + 100])
    return out


def _vbri(data: bytes) -> dict:
    """A VBRI header: its table gives the bytes of each stretch of frames."""
    if len(data) < 26:
        return {}
    size, frames, n, scale, width, each = struct.unpack(">IIHHHH", data[10:26])
    steps = [int.from_bytes(data[26 + width * i : 26 + width * (i + 1)], "big") * scale for i in range(n)]
    return {"frames": frames, "bytes": size, "stretch": each, "steps": steps}


_MONO48 = {kbps: b"\xff\xfa" + bytes([i << 4 | 1 << 2, 0xC0]) for i, kbps in enumerate(RATES[True, 3]) if i}
_SIDE = bytes(17)
_HEADS = {kbps: h + crc16(h[2:] + _SIDE).to_bytes(2, "big") + _SIDE for kbps, h in _MONO48.items()}
_ROOM = {kbps: 3 * kbps - 23 for kbps in _HEADS}
_FULL = _ROOM[320]


def _id3(fields: dict[str, str]) -> bytes:
    body = b"".join(b"TXXX" + struct.pack(">IH", len(t), 0) + t for k, v in fields.items() if (t := b"\x00" + k.encode() + b"\x00" + v.encode()))
    n = len(body)
    return b"ID3\x03\x00\x00" + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + body


def store(payload: bytes, fields: dict[str, str]) -> bytes:
    """The payload in a stream of frames."""
    full, rest = divmod(len(payload), _FULL)
    head = _HEADS[320]
    parts = [x for i in range(full) for x in (head, payload[i * _FULL : (i + 1) * _FULL])]
    if rest:
        kbps = next(k for k, room in _ROOM.items() if room >= rest)
        parts += [_HEADS[kbps], payload[full * _FULL :], bytes(_ROOM[kbps] - rest)]
    audio = b"".join(parts)
    frames, size = full + (rest > 0), 192 + len(audio)
    toc = bytes(min(255, 256 * (192 + 960 * (frames * i // 100)) // size) for i in range(100))
    xing = b"\xff\xfb" + _MONO48[64][2:] + _SIDE + b"Xing" + struct.pack(">III", 7, frames, size) + toc
    return _id3(fields | {"payload_bytes": str(len(payload))}) + xing.ljust(192, b"\x00") + audio


def payload_of(data: bytes, parsed: dict) -> bytes:
    return b"".join(data[a:b] for a, b in parsed["bodies"])[: int(parsed["tags"].get("payload_bytes", 0))]


def to_payload(text: str | None) -> tuple[bytes, int]:
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 or (64 if not raw else 0)), len(raw)


def media_table(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, media): each text as a media column."""
    kind = docs.schema[key].dataType.simpleString()

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for t in b.column(1).to_pylist():
            payload, n = to_payload(t)
            out.append(store(payload, {"n_bytes": str(n)}))
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[key, "media"])

    return map_arrow(docs.select(key, F.col(text).cast("string").alias("_text")), run, f"`{key}` {kind}, media binary")


INFO = "n_frames long, samples long, hertz int, duration_s double, resyncs long, skipped_bytes long, crc_good long, crc_bad long, xing_frames long, xing_bytes long, tags map<string,string>, seek array<long>"


def describe(docs: DataFrame, media: str = "media", every: int = 1) -> DataFrame:
    """docs with an `info` struct for the media column: exact duration, checks, tags, table and every n-th frame's place."""
    at = docs.columns.index(media)

    def one(data: bytes | None) -> dict:
        p = parse(data or b"")
        x = p["xing"] or {}
        return {
            "n_frames": len(p["places"]),
            "samples": p["samples"],
            "hertz": p["hertz"],
            "duration_s": p["samples"] / p["hertz"] if p["hertz"] else 0.0,
            "resyncs": p["resyncs"],
            "skipped_bytes": p["skipped"],
            "crc_good": p["crc_good"],
            "crc_bad": p["crc_bad"],
            "xing_frames": x.get("frames"),
            "xing_bytes": x.get("bytes"),
            "tags": list(p["tags"].items()),
            "seek": p["places"][::every],
        }

    kind = pa.struct(
        [(n, pa.int64()) for n in ("n_frames", "samples")]
        + [("hertz", pa.int32()), ("duration_s", pa.float64())]
        + [(n, pa.int64()) for n in ("resyncs", "skipped_bytes", "crc_good", "crc_bad", "xing_frames", "xing_bytes")]
        + [("tags", pa.map_(pa.string(), pa.string())), ("seek", pa.list_(pa.int64()))]
    )

    fields = T.StructType.fromDDL(INFO)
    return map_columns(docs, lambda columns: [*columns, pa.array([one(x) for x in columns[at].to_pylist()], kind)], [*docs.schema.fields, T.StructField("info", fields)])


def op6_mpeg(spark, sf_dir: str) -> DataFrame:
    """Digests, features and frame seek offsets of the payloads that the stored media give back."""
    media = cut(media_table(table(spark, sf_dir, "documents").select("doc_id", "text")), "media")
    kinds = [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("n_frames", pa.int64()), ("samples", pa.int64()), ("duration_s", pa.float64()), ("feature", pa.string()), ("seek", pa.string())]

    def one(data: bytes) -> tuple:
        p = parse(data)
        if p["crc_bad"] or p["resyncs"] or not p["xing"] or p["xing"]["frames"] != len(p["places"]):
            raise ValueError("the stored media are damaged")
        x = payload_of(data, p)
        hist = np.bincount(np.frombuffer(x, np.uint8), minlength=256)
        q = hist[hist > 0] / len(x)
        feature = f"frames={len(p['places'])};samples={p['samples']};hz={p['hertz']};mean={float(hist @ np.arange(256)) / len(x):.6f};entropy={-float(q @ np.log2(q)) + 0.0:.6f};last={p['places'][-1]}"
        return int(p["tags"]["n_bytes"]), len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-64:]), len(data), hashlib.sha256(data).hexdigest(), len(p["places"]), p["samples"], p["samples"] / p["hertz"], feature, ",".join(map(str, p["places"]))

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        cols = zip(*(one(x) for x in b.column(1).to_pylist()))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, (_, t) in zip(cols, kinds))], names=["doc_id", *(n for n, _ in kinds)])

    return map_arrow(media, run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, n_frames long, samples long, duration_s double, feature string, seek string")
