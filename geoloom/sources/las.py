"""LAS point files: headers, points of a range, single records, COPC headers and ranges.

Record formats 0 to 10 are read; positions are scaled doubles, colours 8 bits a channel (the
high byte of 16-bit channels, the value itself where no channel of the batch exceeds 255).
Points of compressed files need a codec that may not be installed; their headers don't.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import limits
from . import BadFile, NoCodec, decoded

SCHEMA = "idx long, x double, y double, z double, intensity int, cls int, r int, g int, b int"
#: Points that a file may declare.
MOST_POINTS = 50_000_000
# Byte offsets of classification and colour in the record formats.
_CLS = {**{f: 15 for f in range(6)}, **{f: 16 for f in range(6, 11)}}
_RGB = {2: 20, 3: 28, 5: 28, 7: 30, 8: 30, 10: 30}
_LEAST = {0: 20, 1: 28, 2: 26, 3: 34, 4: 57, 5: 63, 6: 30, 7: 36, 8: 38, 9: 59, 10: 67}


@dataclass
class Header:
    version: str
    point_format: int
    compressed: bool
    record_length: int
    point_offset: int
    n_points: int
    scale: tuple
    offset: tuple
    low: tuple
    high: tuple


def header(b: bytes) -> Header:
    """The public header block."""
    if len(b) < 227:
        raise BadFile(f"a LAS header has 227 bytes at least, here are {len(b)}")
    if b[:4] != b"LASF":
        raise BadFile("no LASF at the start")
    major, minor = b[24], b[25]
    point_offset, = struct.unpack_from("<I", b, 96)
    kind, length, legacy = struct.unpack_from("<BHI", b, 104)
    n = legacy
    if (major, minor) >= (1, 4) and len(b) >= 255:
        n = struct.unpack_from("<Q", b, 247)[0] or legacy
    numbers = struct.unpack_from("<12d", b, 131)
    x1, x0, y1, y0, z1, z0 = numbers[6:]
    return Header(f"{major}.{minor}", kind & 0x3F, bool(kind & 0x80), length, point_offset, n, numbers[:3], numbers[3:6], (x0, y0, z0), (x1, y1, z1))


def detect(b: bytes) -> str:
    """e57, las, laz or copc, by the first bytes."""
    if b[:8] == b"ASTM-E57":
        return "e57"
    if b[:4] != b"LASF" or len(b) < 105:
        raise BadFile("no point cloud format that is known")
    if not b[104] & 0x80:
        return "las"
    return "copc" if (b[24], b[25]) >= (1, 4) else "laz"


def point_offset(h_offset: Column, record_length: Column, i: Column) -> Column:
    """Where record i begins."""
    return h_offset + record_length * i


def byte_range(h_offset: Column, record_length: Column, start: Column, count: Column) -> Column:
    """The bytes (start, end) of a run of records."""
    return F.struct((h_offset + record_length * start).alias("start"), (h_offset + record_length * (start + count)).alias("end"))


def records(raw: bytes, h: Header, first: int = 0) -> pd.DataFrame:
    """Whole records in ``raw`` as rows; a cut-off last record is left out."""
    n, w = len(raw) // h.record_length, h.record_length
    at = np.frombuffer(raw, np.uint8, n * w).reshape(n, w)
    col = lambda o, t: np.ascontiguousarray(at[:, o:o + np.dtype(t).itemsize]).view(t)[:, 0]
    out = {"idx": np.arange(first, first + n)}
    for k, a in enumerate("xyz"):
        out[a] = col(4 * k, "<i4") * h.scale[k] + h.offset[k]
    out["intensity"] = col(12, "<u2").astype(np.int32)
    cls = at[:, _CLS[h.point_format]].astype(np.int32)
    out["cls"] = cls & 31 if h.point_format < 6 else cls
    if h.point_format in _RGB:
        rgb = np.stack([col(_RGB[h.point_format] + 2 * k, "<u2") for k in range(3)]).astype(np.int32)
        rgb = rgb >> 8 if n and rgb.max() > 255 else rgb
        out |= dict(zip("rgb", rgb))
    else:
        out |= {c: pd.array([None] * n, "Int32") for c in "rgb"}
    return pd.DataFrame(out)


def _checked(h: Header) -> Header:
    if h.compressed:
        raise NoCodec("compressed points need a LAZ codec")
    if h.point_format not in _LEAST or h.record_length < _LEAST[h.point_format]:
        raise BadFile(f"record format {h.point_format} of {h.record_length} bytes")
    if h.n_points > MOST_POINTS:
        raise BadFile(f"{h.n_points} points declared, {MOST_POINTS} allowed")
    return h


def parse(b: bytes, start: int = 0, count: int | None = None, chunk: int = 100_000):
    """Frames of at most ``chunk`` points of [start, start + count); a file that is cut off
    gives the whole records that it has."""
    h = _checked(header(b))
    there = min(h.n_points, max(len(b) - h.point_offset, 0) // h.record_length)
    end = there if count is None else min(there, start + count)
    for at in range(start, end, chunk):
        n = min(chunk, end - at)
        lo = h.point_offset + at * h.record_length
        yield records(b[lo:lo + n * h.record_length], h, at)


def read(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row a point of each file."""
    return decoded(df, key, content, parse, SCHEMA)


def headers(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row a file: what its header says."""
    def one(b):
        h = header(b)
        yield pd.DataFrame([(h.version, h.point_format, h.compressed, h.record_length, h.point_offset, h.n_points, *h.scale, *h.offset, *h.low, *h.high)])

    names = [f"{n}_{a} double" for n in ("scale", "offset", "min", "max") for a in "xyz"]
    return decoded(df.withColumn("_head", F.substring(F.col(content), 1, 375)), key, "_head", one, "version string, point_format int, compressed boolean, record_length int, point_offset long, n_points long, " + ", ".join(names))


def point_at(df: DataFrame, key: str, content: str, index: Column) -> DataFrame:
    """The one record at ``index`` of each file, from its bytes alone."""
    h = headers(df, key, content)
    cut = df.select(key, content, index.cast("long").alias("_i")).join(h, key).where(F.col("_i") < F.col("n_points"))
    length = F.col("record_length").cast("long")
    slim = cut.select(key, F.concat(F.substring(F.col(content), F.lit(1), F.col("point_offset").cast("int")), F.substring(F.col(content), (F.col("point_offset") + length * F.col("_i") + 1).cast("int"), length.cast("int"))).alias("_one"), "_i")
    out = decoded(slim, key, "_one", parse, SCHEMA)
    return out.drop("idx").join(slim.select(key, F.col("_i").alias("idx")), key).select(key, "idx", "x", "y", "z", "intensity", "cls", "r", "g", "b")


def read_ranges(spark, path: str, points_per_split: int = 1_000_000) -> DataFrame:
    """(path, idx, ..): points of all files below ``path``, a file's records dealt out in
    splits that many tasks read by byte range; nothing loads a whole file."""
    from ..sources import files

    # of each file the header bytes alone come to the planner: a row a file
    heads = files(spark, path).select("path", F.substring("content", 1, 375).alias("content"))
    h = headers(heads, "path", "content").select("path", "n_points", "point_offset", "record_length")
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_points") - 1, F.lit(0)), F.lit(points_per_split).cast("long")))
    splits = h.select("path", step.alias("start")).repartition("path", "start")

    def run(frames):
        from pyarrow import fs

        for pdf in frames:
            for name, start in zip(pdf["path"], pdf["start"]):
                where, at = fs.FileSystem.from_uri(name)
                with where.open_input_file(at) as f:
                    hd = _checked(header(f.read(375)))
                    f.seek(hd.point_offset + int(start) * hd.record_length)
                    left = min(points_per_split, hd.n_points - int(start))
                    while left > 0:
                        raw = f.read(min(left, 100_000) * hd.record_length)
                        if len(raw) < hd.record_length:
                            break
                        out = records(raw, hd, int(start) + min(points_per_split, hd.n_points - int(start)) - left)
                        left -= len(out)
                        out.insert(0, "path", name)
                        yield out

    return splits.mapInPandas(run, f"path string, {SCHEMA}")


# ---------------------------------------------------------------- COPC

def copc(b: bytes) -> dict:
    """Of a LAS 1.4 header with compressed points: bounds, point offset, and the table of
    chunks (one that spans all points, as no hierarchy is walked)."""
    h = header(b)
    if not h.compressed or h.version < "1.4":
        raise BadFile("no COPC header")
    table = [{"offset": h.point_offset, "size": max(len(b) - h.point_offset, 0), "count": h.n_points}]
    return {"version": h.version, "pointDataOffset": h.point_offset, "pointCount": h.n_points, "bounds": [*h.low, *h.high], "chunkTable": table}


def copc_ranges(df: DataFrame, key: str, chunks: str, length: str) -> DataFrame:
    """(key, ranges, total): the HTTP ranges of each file's chunk table (an array of offset and
    size); chunks without bytes or beyond the file are passed over, the last cut at its end."""
    c = df.select(key, F.col(length).alias("_n"), F.posexplode_outer(chunks).alias("_i", "c"))
    end = F.least(F.col("c.offset") + F.col("c.size"), F.col("_n"))
    ok = (F.col("c.size") > 0) & (F.col("c.offset") < F.col("_n"))
    text = F.when(ok, F.concat(F.lit("bytes="), F.col("c.offset").cast("string"), F.lit("-"), (end - 1).cast("string")))
    return c.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.when(ok, F.struct("_i", text.alias("t"))))), lambda v: v["t"]).alias("ranges"), F.coalesce(F.sum(F.when(ok, end - F.col("c.offset"))), F.lit(0)).alias("total"))


def copc_download(point_offset_: Column, chunks: Column) -> Column:
    """The point offset and the sizes of all chunks, added up."""
    return F.aggregate(chunks, point_offset_.cast("long"), lambda s, c: s + c["size"].cast("long"))
