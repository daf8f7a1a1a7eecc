"""MPEG audio columns: frames written and parsed in Arrow batches.

``MpegWriter`` stores a byte payload losslessly in MPEG-2 Layer III frames of 576 samples:
each frame is silent (its side information claims no main data) and carries 576 payload
bytes as ancillary data, with its own CRC. An ID3v2 tag and an Info frame with frame count,
byte count and seek table come first, an ID3v1 tag last.

``parse`` reads any MPEG 1, 2 and 2.5 stream of Layers I to III: it skips tags, finds the
first frame header that a chain of further headers confirms, walks frame by frame,
resynchronises after damage, checks the CRCs of Layer III frames, reads Xing/Info and VBRI
tables, and reports exact durations and the byte offset of every frame.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pieces, table

# Fixed values of the MPEG audio header: kbit/s by (version 1?, layer), Hz by version.
_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
_HZ = {0: (11025, 12000, 8000), 2: (22050, 24000, 16000), 3: (44100, 48000, 32000)}
UNIT = 576


@dataclass(frozen=True)
class Header:
    version: int  # 3: MPEG 1, 2: MPEG 2, 0: MPEG 2.5
    layer: int
    crc: bool
    bitrate: int
    hz: int
    mono: bool
    size: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of Layer III side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)

    def like(self, o: "Header") -> bool:
        return (self.version, self.layer, self.hz) == (o.version, o.layer, o.hz)


def header(b: bytes, at: int = 0) -> Header | None:
    """The frame header at a place, or None; free-format and reserved values are none."""
    if at + 4 > len(b) or b[at] != 0xFF or b[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, rate, hz = b[at + 1] >> 3 & 3, 4 - (b[at + 1] >> 1 & 3), b[at + 2] >> 4, b[at + 2] >> 2 & 3
    if version == 1 or layer == 4 or rate in (0, 15) or hz == 3 or b[at + 3] & 3 == 2:
        return None
    kbit, freq, pad = _RATES[(version == 3, layer)][rate], _HZ[version][hz], b[at + 2] >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 3 else 576
    size = (12 * kbit * 1000 // freq + pad) * 4 if layer == 1 else samples // 8 * kbit * 1000 // freq + pad
    return Header(version, layer, not b[at + 1] & 1, kbit * 1000, freq, b[at + 3] >> 6 == 3, size, samples)


def crc16(data: bytes, crc: int = 0xFFFF) -> int:
    """CRC-16 of the MPEG audio frame, polynomial 0x8005, most significant bit first."""
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005) & 0xFFFF if crc & 0x8000 else crc << 1
    return crc


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


class MpegWriter:
    """144 kbit/s at 16 kHz mono: 648 bytes a frame, header 4, CRC 2, side information 9,
    payload 576, zeros 57."""

    HEAD = bytes((0xFF, 0xF2, 0xD8, 0xC0))
    PREFIX = HEAD + crc16(HEAD[2:] + bytes(9)).to_bytes(2, "big") + bytes(9)
    SIZE = 648

    def id3v2(self, title: str) -> bytes:
        body = b"\x03" + title.encode()
        frame = b"TIT2" + _synchsafe(len(body)) + b"\0\0" + body
        return b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame

    def write(self, payload: bytes) -> bytes:
        n = len(payload) // UNIT
        frames = np.zeros((n, self.SIZE), np.uint8)
        frames[:, :15] = np.frombuffer(self.PREFIX, np.uint8)
        frames[:, 15:15 + UNIT] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
        total = (n + 1) * self.SIZE
        toc = bytes(min(255, (i * n // 100 + 1) * self.SIZE * 256 // total) for i in range(100))
        info = self.PREFIX + b"Info" + (7).to_bytes(4, "big") + n.to_bytes(4, "big") + total.to_bytes(4, "big") + toc
        tag = b"TAG" + b"payload".ljust(125, b"\0")
        return self.id3v2("payload") + info.ljust(self.SIZE, b"\0") + frames.tobytes() + tag


@dataclass
class Parsed:
    frames: list[int] = field(default_factory=list)
    first: Header | None = None
    samples: int = 0
    seconds: Fraction = Fraction(0)
    crc_ok: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    lost: int = 0
    tags: list[str] = field(default_factory=list)
    title: str | None = None
    table: dict | None = None


def _sync(b: bytes, at: int, end: int, confirm: int = 3) -> int:
    """The next place from which ``confirm`` like headers follow each other (fewer where the
    data end), or -1."""
    while (at := b.find(b"\xff", at, end)) >= 0:
        if h := header(b, at):
            to, n = at + h.size, 1
            while n < confirm and to < end and (g := header(b, to)) and g.like(h):
                to, n = to + g.size, n + 1
            if n == confirm or to == end:
                return at
        at += 1
    return -1


def _vbr(b: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of a frame."""
    for skip in (2 if h.crc else 0, 0):
        x = at + 4 + skip + h.side
        if b[x:x + 4] in (b"Xing", b"Info"):
            flags, x, out = int.from_bytes(b[x + 4:x + 8], "big"), x + 8, {"kind": b[x:x + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], x = int.from_bytes(b[x:x + 4], "big"), x + 4
            if flags & 4:
                out["toc"], x = list(b[x:x + 100]), x + 100
            return out
    x = at + 36
    if b[x:x + 4] == b"VBRI":
        size, frames, n, scale, width = (int.from_bytes(b[x + i:x + j], "big") for i, j in ((10, 14), (14, 18), (18, 20), (20, 22), (22, 24)))
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": [int.from_bytes(b[x + 26 + width * i:x + 26 + width * (i + 1)], "big") * scale for i in range(n)]}
    return None


def _size_of(b: bytes) -> int:
    return sum((x & 127) << s for x, s in zip(b, (21, 14, 7, 0)))


def _title(body: bytes, version: int, flags: int) -> str | None:
    """The title among the frames of an ID3v2 tag; sizes are synchsafe from version 4 on, ids
    and sizes of three bytes in version 2."""
    if flags & 0x40 and version > 2:  # an extended header
        n = _size_of(body[:4]) if version > 3 else int.from_bytes(body[:4], "big") + 4
        body = body[n:]
    width = 3 if version == 2 else 4
    at, head = 0, 6 if version == 2 else 10
    while at + head <= len(body) and body[at]:
        size = int.from_bytes(body[at + 3:at + 6], "big") if version == 2 else _size_of(body[at + 4:at + 8]) if version > 3 else int.from_bytes(body[at + 4:at + 8], "big")
        if body[at:at + width] in (b"TT2", b"TIT2"):
            text = body[at + head:at + head + size]
            code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(text[0] if text else 0, "latin-1")
            return text[1:].decode(code, "replace").rstrip("\0")
        at += head + size
    return None


def parse(b: bytes | None) -> Parsed:
    """What a stream holds. Checksums are verified in Layer III, whose protected bits are the
    header and side information; frames of Layers I and II are found and timed, and count
    neither as good nor as bad. Null, empty and foreign bytes give no frames; a last frame that
    the data cut short is counted as lost bytes."""
    out, b = Parsed(), b or b""
    at, end = 0, len(b)
    while b[at:at + 3] == b"ID3" and len(b) >= at + 10:
        size = _size_of(b[at + 6:at + 10])
        out.tags.append("ID3v2")
        if out.title is None:
            out.title = _title(b[at + 10:at + 10 + size], b[at + 3], b[at + 5])
        at += 10 + size + 10 * (b[at + 5] >> 4 & 1)
    if end - at >= 128 and b[end - 128:end - 125] == b"TAG":
        out.tags.append("ID3v1")
        if out.title is None:
            out.title = b[end - 125:end - 95].split(b"\0")[0].rstrip().decode("latin-1") or None
        end -= 128
    if end - at >= 32 and b[end - 32:end - 24] == b"APETAGEX":
        out.tags.append("APEv2")
        end = max(at, end - 32 * (1 + (b[end - 9] >> 7)) - int.from_bytes(b[end - 20:end - 16], "little") + 32)
    checks: dict[bytes, bool] = {}
    while at < end:
        h = header(b, at)
        if h is None or at + h.size > end or out.first is None and _sync(b, at, at + 1 if at + h.size == end else end) != at or out.first is not None and not h.like(out.first):
            to = _sync(b, at + 1, end)
            to = end if to < 0 else to
            out.lost += to - at
            out.resyncs += to < end
            at = to
            continue
        if out.first is None:
            out.first = h
            if (t := _vbr(b, at, h)) is not None:
                out.table = t
                at += h.size
                continue
        if h.crc and h.layer == 3:
            own = b[at + 2:at + 6 + h.side]
            if own not in checks:
                checks[own] = crc16(own[:2] + own[4:]) == int.from_bytes(own[2:4], "big")
            good = checks[own]
            out.crc_ok, out.crc_bad = out.crc_ok + good, out.crc_bad + (not good)
        out.frames.append(at)
        out.samples += h.samples
        at += h.size
    if out.first:
        out.seconds = Fraction(out.samples, out.first.hz)
    return out


def ancillary(b: bytes, p: Parsed) -> bytes:
    """The payload that ``MpegWriter`` has put into the frames."""
    if not p.frames:
        return b""
    a = np.frombuffer(b, np.uint8)
    at = np.array(p.frames, np.int64) + 15
    if len(at) == 1 or (np.diff(at) == MpegWriter.SIZE).all():
        whole = a[p.frames[0]:p.frames[0] + len(at) * MpegWriter.SIZE].reshape(-1, MpegWriter.SIZE)
        return whole[:, 15:15 + UNIT].tobytes()
    return a[at[:, None] + np.arange(UNIT)].tobytes()


def _store(batches):
    w = MpegWriter()
    for whole in batches:
        for batch in pieces(whole, "text"):
            raw = [(t or "").encode() for t in batch.column("text").to_pylist()]
            media = [w.write(r + b"\xff" * (max(UNIT, -(-len(r) // UNIT) * UNIT) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])


def store_texts(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): every text as an MPEG audio stream. A null text is stored as
    an empty one; the payload is padded with bytes 255 to a positive multiple of 576. A text of
    any length is stored whole, in one stream. Rows are independent, so repeated rows, ties
    and an empty table need no care; columns other than doc_id and text are not looked at."""
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_store, "doc_id long, n_bytes long, media binary")


PROBED = ("doc_id long, n_bytes long, n_frames long, sample_rate int, samples long, duration_us long, crc_ok long, crc_bad long, resyncs long, tags array<string>, "
          "vbr_kind string, vbr_frames long, vbr_bytes long, seek_offsets array<long>, payload binary, media_bytes long, media_sha256 string, mean double, rms double")


def _probe(batches):
    import pandas as pd  # noqa: F401

    for batch in batches:
        ids, sizes, out = batch.column("doc_id").to_pylist(), batch.column("n_bytes").to_pylist(), []
        for i, n, m in zip(ids, sizes, batch.column("media")):
            buf = m.as_buffer()
            b = buf.to_pybytes() if buf is not None else b""
            p = parse(b)
            payload = ancillary(b, p)
            x = np.frombuffer(payload, np.uint8)
            total, squares, count = int(x.sum(dtype=np.int64)), int((x.astype(np.uint32) ** 2).sum(dtype=np.int64)), max(len(x), 1)
            t = p.table or {}
            out.append((i, n, len(p.frames), p.first.hz if p.first else None, p.samples, int(p.seconds * 1_000_000), p.crc_ok, p.crc_bad, p.resyncs, p.tags,
                        t.get("kind"), t.get("frames"), t.get("bytes"), p.frames, payload, len(b), hashlib.sha256(b).hexdigest(), total / count, (squares / count) ** 0.5))
            if len(out) >= 256:
                yield _rows(out)
                out = []
        if out:
            yield _rows(out)


_ARROW = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.string(), pa.int64(), pa.int64(),
          pa.list_(pa.int64()), pa.binary(), pa.int64(), pa.string(), pa.float64(), pa.float64()]


def _rows(out):
    names = [f.split()[0] for f in PROBED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(_ARROW)], names)


def probe(media: DataFrame) -> DataFrame:
    """For each row of (doc_id, n_bytes, media): frames, duration, seek offsets, checks, tags,
    the variable-bitrate table and the ancillary payload. Null and foreign bytes have no
    frames, no sample rate and an empty payload."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_probe, PROBED)


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = probe(store_texts(table(spark, sf_dir, "documents")))
    feature = F.concat_ws(";", F.format_string("frames=%d", "n_frames"), F.format_string("samples=%d", "samples"), F.format_string("hz=%d", "sample_rate"), F.format_string("crc=%d/%d", "crc_ok", "crc_bad"),
                          F.format_string("%s=%d/%d", "vbr_kind", "vbr_frames", "vbr_bytes"), F.concat(F.lit("tags="), F.array_join("tags", ",")), F.format_string("seek=%s", F.hex(F.xxhash64("seek_offsets"))),
                          F.format_string("mean=%.3f", "mean"), F.format_string("rms=%.3f", "rms"))
    return p.select("doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
                    F.crc32(F.expr("substring(payload, -32)")).alias("tail_crc32"), "media_bytes", "media_sha256", feature.alias("feature"))


def unpadded(payload: bytes, n: int) -> bytes:
    return payload[:n]


def tail_crc(payload: bytes) -> int:
    return zlib.crc32(payload[-32:])
