"""MPEG audio as a media column: write, resynchronise, parse, verify, and read back.

`scan` walks any MPEG-1/2/2.5 layer I-III elementary stream: it skips ID3v2, APE and ID3v1 tags, finds frames
by header chains (out of step, a header counts only if the next one agrees or the audio ends there), reads
Xing/Info and VBRI tables, checks Layer III CRCs, and gives the exact duration as samples over rate and the
byte offset of every frame. `store` writes a payload losslessly: 576 bytes in the ancillary part of each
CRC-protected, silent Layer III frame, behind an ID3v2 tag and an Info frame.
"""

from __future__ import annotations

import hashlib
import json
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from .storage import bounded_batches

UNIT = 576
# Fixed values of the MPEG audio standard: kbit/s by (version 1?, layer) and index, Hz by version and index.
KBPS = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG-1, 2: MPEG-2, 0: MPEG-2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int  # bytes of Layer III side information

    def follows(self, other: Header) -> bool:
        return (self.version, self.layer, self.rate) == (other.version, other.layer, other.rate)


@lru_cache(maxsize=8192)
def header(word: bytes) -> Header | None:
    """The header in four bytes; None if they aren't one (free format counts as none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate_index = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or word[3] & 3 == 2:
        return None
    one = version == 3
    kbps, rate, pad, mono = KBPS[one, layer][index], RATES[version][rate_index], word[2] >> 1 & 1, word[3] >> 6 == 3
    if layer == 1:
        samples, size = 384, (12_000 * kbps // rate + pad) * 4
    else:
        samples = 576 if layer == 3 and not one else 1152
        size = samples // 8 * kbps * 1000 // rate + pad
    side = (17 if mono else 32) if one else (9 if mono else 17)
    return Header(version, layer, not word[1] & 1, kbps, rate, 1 if mono else 2, size, samples, side if layer == 3 else 0)


@lru_cache(maxsize=8192)
def crc16(data: bytes) -> int:
    """The CRC of the standard: polynomial 0x8005, start 0xFFFF, most significant bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


@dataclass
class Scan:
    frames: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    layer: int = 0
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, object] | None = None
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    lost_bytes: int = 0


def synchsafe(data: bytes) -> int:
    return data[0] << 21 | data[1] << 14 | data[2] << 7 | data[3]


def read_id3v2(data: bytes, tags: dict[str, str]) -> int:
    """Parse an ID3v2.2-2.4 tag at the start into `tags`; returns where it ends (0: no tag)."""
    if data[:3] != b"ID3" or len(data) < 10 or max(data[6:10]) > 0x7F:
        return 0
    major, end = data[3], 10 + synchsafe(data[6:10])
    at, head = 10, 6 if major == 2 else 10
    while at + head <= min(end, len(data)) and data[at]:
        if major == 2:
            name, size = data[at : at + 3], int.from_bytes(data[at + 3 : at + 6], "big")
        else:
            name, size = data[at : at + 4], synchsafe(data[at + 4 : at + 8]) if major == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        body = data[at + head : min(at + head + size, end)]
        if name[:1] == b"T" and body:
            codec = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1")
            tags[name.decode("latin-1")] = body[1:].decode(codec, "replace").rstrip("\0").replace("\0", "=")
        at += head + size
    return end + (10 if major == 4 and data[5] & 0x10 else 0)


def read_tail_tags(data: bytes) -> list[tuple[int, dict[str, str]]]:
    """Parse ID3v1 and APEv2 tags at the end: (where the data before them end, their tags), from no tag to all."""
    end, tags = len(data), {}
    out = [(end, tags)]
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end, tags = end - 128, dict(tags)
        for name, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
            if text := data[end + a : end + b].split(b"\0")[0].decode("latin-1").strip():
                tags[f"v1.{name}"] = text
        out.append((end, tags))
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end -= min(end, size + (32 if flags >> 31 else 0))
        out.append((end, tags | {"ape": str(size)}))
    return out


def chain_end(data: bytes, at: int, last: Header) -> int:
    """Where the frames that go on from `at` in step with `last` end."""
    while (h := header(data[at : at + 4])) and h.follows(last) and at + h.size <= len(data):
        at += h.size
    return at


def read_vbr(data: bytes, at: int, h: Header) -> dict[str, object] | None:
    """The Xing/Info or VBRI table of a frame, if it holds one."""
    x = at + 4 + 2 * h.protected + h.side
    for x in (at + 4 + h.side, x):
        if data[x : x + 4] in (b"Xing", b"Info"):
            flags, p, out = int.from_bytes(data[x + 4 : x + 8], "big"), x + 8, {"kind": data[x : x + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name] = int.from_bytes(data[p : p + 4], "big")
                    p += 4
            if flags & 4:
                out["toc"] = list(data[p : p + 100])
            return out
    if data[at + 36 : at + 40] == b"VBRI":
        n_bytes, n_frames, entries, scale, width, each = struct.unpack(">IIHHHH", data[at + 46 : at + 62])
        table = [int.from_bytes(data[p : p + width], "big") * scale for p in range(at + 62, at + 62 + entries * width, width or 1)] if width in (1, 2, 3, 4) else []
        return {"kind": "VBRI", "frames": n_frames, "bytes": n_bytes, "frames_per_entry": each, "toc": table}
    return None


def scan(data: bytes) -> Scan:
    """Walk the stream. Bytes that belong to no frame are counted as lost, and each gap as one resync.

    What looks like a tag at the end is frame content if frames in step fill the data across its start.
    """
    out = Scan()
    at, outer = read_id3v2(data, out.tags), read_tail_tags(data)
    end, tail = outer.pop()
    last, lost = None, False
    while at < end:
        h = header(data[at : at + 4])
        if outer and last and not lost and h and at + h.size > end:
            full = chain_end(data, at, last)
            end, tail = next((e for e in outer if e[0] == full), (end, tail))
        if at + 4 > end:
            break
        if h and at + h.size <= end and not (last and not lost and not h.follows(last)):
            after = at + h.size
            ahead = header(data[after : after + 4]) if after + 4 <= end else h
            if (last and not lost) or (ahead and ahead.follows(h)):
                vbr = read_vbr(data, at, h) if last is None and h.layer == 3 else None
                if vbr:
                    out.vbr = vbr
                else:
                    out.frames.append(at)
                    out.sizes.append(h.size)
                    out.samples += h.samples
                if h.protected and h.layer == 3:
                    stated = int.from_bytes(data[at + 4 : at + 6], "big")
                    good = crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.side]) == stated
                    out.crc_good, out.crc_bad = out.crc_good + good, out.crc_bad + (not good)
                out.rate, out.layer, last, lost, at = h.rate, h.layer, h, False, after
                continue
        out.resyncs += not lost
        lost = True
        nxt = data.find(b"\xff", at + 1, end)
        nxt = end if nxt < 0 else nxt
        out.lost_bytes += nxt - at
        at = nxt
    if at < end:
        out.lost_bytes += end - at
    out.tags |= tail
    return out


#: MPEG-1 Layer III, 48 kHz, 224 kbit/s, stereo: 672 bytes a frame, with a CRC or without.
PROTECTED, PLAIN = bytes((0xFF, 0xFA, 0xC4, 0x00)), bytes((0xFF, 0xFB, 0xC4, 0x00))
FRAME, SIDE = 672, 32
BEFORE = PROTECTED + crc16(PROTECTED[2:] + bytes(SIDE)).to_bytes(2, "big") + bytes(SIDE)
AFTER = bytes(FRAME - len(BEFORE) - UNIT)


def pad(data: bytes) -> bytes:
    """Append bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * ((-len(data)) % UNIT if data else UNIT)


def store(payload: bytes, n_bytes: int) -> bytes:
    """An MPEG stream that holds `payload` (a positive multiple of 576 bytes) in its frames."""
    n = len(payload) // UNIT
    text = b"\x00payload-bytes\x00" + str(n_bytes).encode()
    frame = b"TXXX" + len(text).to_bytes(4, "big") + b"\0\0" + text
    tag = b"ID3\x03\0\0" + bytes(len(frame) >> s & 0x7F for s in (21, 14, 7, 0)) + frame
    audio = (n + 1) * FRAME
    toc = bytes(min(255, 256 * (FRAME + i * n * FRAME // 100) // audio) for i in range(100))
    info = PLAIN + bytes(SIDE) + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + audio.to_bytes(4, "big") + toc
    return tag + info + bytes(FRAME - len(info)) + b"".join([x for i in range(0, len(payload), UNIT) for x in (BEFORE, payload[i : i + UNIT], AFTER)])


def read_payload(media: bytes, found: Scan | None = None) -> bytes:
    """The payload that `store` put in the frames."""
    found = scan(media) if found is None else found
    return b"".join([media[at + len(BEFORE) : at + len(BEFORE) + UNIT] for at in found.frames])


def describe(found: Scan) -> str:
    """A stable summary: exact duration as a fraction of a second, frames, checks and seek offsets' digest."""
    offsets = struct.pack(f">{len(found.frames)}Q", *found.frames)
    return json.dumps(
        {
            "codec": f"mpeg-layer-{found.layer}", "frames": len(found.frames), "samples": found.samples, "rate": found.rate,
            "crc_good": found.crc_good, "crc_bad": found.crc_bad, "resyncs": found.resyncs, "lost_bytes": found.lost_bytes,
            "vbr_frames": (found.vbr or {}).get("frames"), "tags": found.tags, "seek_sha256": hashlib.sha256(offsets).hexdigest(),
        },
        sort_keys=True, separators=(",", ":"),
    )


PARSED = "frames long, samples long, rate int, duration_s double, layer int, vbr_frames long, crc_good long, crc_bad long, resyncs long, lost_bytes long, tags map<string,string>, seek_offsets array<long>"


def parsed_row(found: Scan) -> dict[str, object]:
    return {
        "frames": len(found.frames), "samples": found.samples, "rate": found.rate, "duration_s": found.samples / found.rate if found.rate else 0.0,
        "layer": found.layer, "vbr_frames": (found.vbr or {}).get("frames"), "crc_good": found.crc_good, "crc_bad": found.crc_bad,
        "resyncs": found.resyncs, "lost_bytes": found.lost_bytes, "tags": list(found.tags.items()), "seek_offsets": found.frames,
    }


def parse_media(df: DataFrame, *, id_col: str, media_col: str) -> DataFrame:
    """One row per row of `df`: its id, then durations, checks, tags and the seek offset of each frame.

    Null media counts as empty; bytes without any frame give 0 frames, rate 0, duration 0.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [{"id": i, **parsed_row(scan(bytes(m or b"")))} for i, m in zip(pdf["id"], pdf["media"], strict=True)]
            yield pd.DataFrame(rows, columns=["id", *(p.split()[0] for p in PARSED.split(", "))])

    kind = df.schema[id_col].dataType.simpleString()
    return df.select(df[id_col].alias("id"), df[media_col].alias("media")).mapInPandas(parse, f"id {kind}, {PARSED}").withColumnRenamed("id", id_col)


STORED = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets array<long>"


def store_texts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every whole text as MPEG audio, read the stored bytes back, and describe what was read.

    Null text is empty; an empty text stores one unit of bytes 255. Equal texts give equal rows but for the
    id. Null ids pass through. Repeated rows stay repeated; an empty table gives no rows; other columns are
    ignored, whatever their names.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                raw = text.encode() if isinstance(text, str) else b""
                payload = pad(raw)
                media = store(payload, len(raw))
                found = scan(media)
                back = read_payload(media, found)
                if back != payload:
                    raise ValueError(f"document {i}: {len(payload)} bytes stored, others read back ({len(back)})")
                rows.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:]), len(media), hashlib.sha256(media).hexdigest(), describe(found), found.frames))
            out = pd.DataFrame(rows, columns=[p.split()[0] for p in STORED.split(", ")])
            yield out.astype({"doc_id": "Int64"})

    bounded_batches(docs)
    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInPandas(run, STORED)
