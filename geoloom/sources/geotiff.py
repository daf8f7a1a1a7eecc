"""TIFF elevation grids: header, coordinate keys, and samples as rows (row, col, z).

Either byte order; 8-, 16- and 32-bit integer and 32- and 64-bit float samples of the first
band and directory; strips or tiles, uncompressed or DEFLATE.
"""

from __future__ import annotations

import json
import struct
import zlib
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import BadFile, decoded

SCHEMA = "row long, col long, z float"
# Bytes and struct codes of the field types.
_KINDS = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 6: "b", 7: "B", 8: "h", 9: "i", 11: "f", 12: "d", 16: "Q"}
_GEO = {1024: "modelType", 1025: "rasterType", 2048: "geographicType", 3072: "projectedCSType", 4096: "verticalCSType", 1026: "citation", 2049: "geogCitation"}


@dataclass
class Info:
    order: str
    width: int
    height: int
    bits: int
    sample: int  # 1 unsigned, 2 signed, 3 float
    bands: int
    compression: int
    planar: int
    block: tuple  # height and width of a strip or tile
    tiled: bool
    offsets: list
    counts: list
    geo: dict = field(default_factory=dict)
    scale: tuple | None = None
    tie: tuple | None = None
    no_data: float | None = None

    @property
    def across(self) -> int:
        return -(-self.width // self.block[1])

    @property
    def n_blocks(self) -> int:
        return self.across * -(-self.height // self.block[0])

    @property
    def bounds(self) -> tuple:
        """min and max of x and y, by tie point and pixel size; the unit square without them."""
        if not self.scale or not self.tie:
            return 0.0, 0.0, 1.0, 1.0
        x0, y1 = self.tie[3] - self.tie[0] * self.scale[0], self.tie[4] + self.tie[1] * self.scale[1]
        return x0, y1 - self.height * self.scale[1], x0 + self.width * self.scale[0], y1

    @property
    def resolution(self) -> tuple:
        x0, y0, x1, y1 = self.bounds
        return (x1 - x0) / self.width, (y1 - y0) / self.height


def _tags(b: bytes, e: str, at: int) -> dict:
    try:
        n, = struct.unpack_from(e + "H", b, at)
        out = {}
        for i in range(n):
            tag, kind, count = struct.unpack_from(e + "HHI", b, at + 2 + 12 * i)
            code = _KINDS.get(kind)
            if not code:
                continue
            size = struct.calcsize(e + code) * count
            where = at + 10 + 12 * i if size <= 4 else struct.unpack_from(e + "I", b, at + 10 + 12 * i)[0]
            if where + size > len(b):
                raise BadFile(f"tag {tag} lies beyond the file")
            out[tag] = b[where:where + size].split(b"\0")[0].decode("latin-1") if kind == 2 else struct.unpack_from(f"{e}{len(code) * count}{code[0]}", b, where)
        return out
    except struct.error:
        raise BadFile("the directory is cut off") from None


def info(b: bytes) -> Info:
    """The first directory."""
    if b[:2] not in (b"II", b"MM") or len(b) < 8:
        raise BadFile("no TIFF byte order")
    e = "<" if b[:2] == b"II" else ">"
    magic, at = struct.unpack_from(e + "HI", b, 2)
    if magic != 42:
        raise BadFile(f"magic number {magic}")
    t = _tags(b, e, at)
    if 256 not in t or 257 not in t:
        raise BadFile("no width or height")
    one = lambda tag, d: t[tag][0] if tag in t else d
    w, h, tiled = t[256][0], t[257][0], 322 in t
    if not w or not h:
        raise BadFile("an empty image")
    compression = one(259, 1)
    if compression not in (1, 8, 32946):
        raise BadFile(f"compression {compression}")
    block = (one(323, h), t[322][0]) if tiled else (min(one(278, h), h), w)
    off, cnt = (t.get(324 if tiled else 273), t.get(325 if tiled else 279))
    if not off or not cnt:
        raise BadFile("no data blocks")
    geo = {}
    if 34735 in t:
        keys = t[34735]
        for i in range(keys[3] if len(keys) > 3 else 0):
            if 8 + 4 * i > len(keys):
                break
            key, place, n, v = keys[4 + 4 * i:8 + 4 * i]
            geo[key] = v if place == 0 else t.get(34737, "")[v:v + n].rstrip("|") if place == 34737 else (t.get(34736) or ())[v] if place == 34736 and v < len(t.get(34736) or ()) else v
    nd = t.get(42113)
    try:
        nd = float(nd) if nd else None
    except ValueError:
        nd = None
    return Info(e, w, h, one(258, 8), one(339, 1 if one(258, 8) < 32 else 3), one(277, 1), compression, one(284, 1), block, tiled, list(off), list(cnt), geo, t.get(33550), t.get(33922), nd)


def block(b: bytes, i: Info, number: int) -> np.ndarray:
    """One strip or tile of the first band, cut to the image, as single floats."""
    if not 0 <= number < min(i.n_blocks, len(i.offsets)):
        raise BadFile(f"block {number} of {i.n_blocks}")
    raw = b[i.offsets[number]:i.offsets[number] + i.counts[number]]
    if i.compression != 1:
        try:
            raw = zlib.decompress(raw)
        except zlib.error as err:
            raise BadFile(f"block {number}: {err}") from None
    kind = {(1, 8): "u1", (2, 8): "i1", (1, 16): "u2", (2, 16): "i2", (1, 32): "u4", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}.get((i.sample, i.bits))
    if not kind:
        raise BadFile(f"{i.bits}-bit samples of kind {i.sample}")
    top, left = number // i.across * i.block[0], number % i.across * i.block[1]
    rows = i.block[0] if i.tiled else min(i.block[0], i.height - top)
    bands = i.bands if i.planar == 1 else 1
    need = rows * i.block[1] * bands
    v = np.frombuffer(raw, i.order + kind, min(need, len(raw) // np.dtype(kind).itemsize))
    if len(v) < need:
        raise BadFile(f"block {number} is cut off")
    grid = v.reshape(rows, i.block[1], bands)[:, :, 0].astype(np.float32)
    return grid[:min(i.block[0], i.height - top), :min(i.block[1], i.width - left)]


def parse(b: bytes, blocks=None):
    """A frame a block, of all blocks or of those numbered."""
    i = info(b)
    for k in range(i.n_blocks) if blocks is None else blocks:
        g = block(b, i, k)
        top, left = k // i.across * i.block[0], k % i.across * i.block[1]
        r, c = np.indices(g.shape)
        yield pd.DataFrame({"row": (r + top).ravel(), "col": (c + left).ravel(), "z": g.ravel()})


def read(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row a sample of each file."""
    return decoded(df, key, content, parse, SCHEMA)


def read_block(df: DataFrame, key: str, content: str, number: int) -> DataFrame:
    """The samples of one strip or tile of each file."""
    return decoded(df, key, content, lambda b: parse(b, [number]), SCHEMA)


def swath(grid: DataFrame, first: int, rows: int) -> DataFrame:
    return grid.where(F.col("row").between(first, first + rows - 1))


def headers(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row a file: size, bounds, resolution and the coordinate keys as JSON."""
    def one(b):
        i = info(b)
        crs = {_GEO[k]: v for k, v in i.geo.items() if k in _GEO}
        yield pd.DataFrame([(i.width, i.height, i.bits, i.n_blocks, i.tiled, *map(float, i.bounds), *map(float, i.resolution), json.dumps(crs, sort_keys=True))])

    return decoded(df, key, content, one, "width long, height long, bits int, blocks long, tiled boolean, min_x double, min_y double, max_x double, max_y double, res_x double, res_y double, crs string")
