"""Features to Mapbox vector tiles: rows are dealt out to tiles in generated code, a tile's
features are clipped, put on its grid and encoded in the task of the tile."""

from __future__ import annotations

import functools
import itertools
import json
import math
import struct

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXTENT, BUFFER = 4096, 64
KINDS = {"Point": 1, "MultiPoint": 1, "LineString": 2, "Polygon": 3}


# ---------------------------------------------------------------- protocol buffers

_SMALL = [bytes([i]) for i in range(128)]


def varint(n: int) -> bytes:
    if 0 <= n < 128:
        return _SMALL[n]
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, body: bytes) -> bytes:
    return varint(number << 3 | 2) + varint(len(body)) + body


def _zig(n: int) -> int:
    return n << 1 if n >= 0 else (-n << 1) - 1


def _value(v) -> bytes:
    if isinstance(v, bool):
        return varint(7 << 3) + varint(int(v))
    if isinstance(v, int):
        return varint(6 << 3) + varint(_zig(v))
    if isinstance(v, float):
        return varint(3 << 3 | 1) + struct.pack("<d", v)
    return _field(1, str(v).encode())


def commands(kind: int, parts: list[list[tuple[int, int]]]) -> list[int]:
    """Moves, lines and closings, in steps."""
    out, x, y = [], 0, 0

    def step(p):
        nonlocal x, y
        out.extend((_zig(p[0] - x), _zig(p[1] - y)))
        x, y = p

    if kind == 1:
        points = [p for part in parts for p in part]
        out.append(len(points) << 3 | 1)
        for p in points:
            step(p)
        return out
    for part in parts:
        own = part[:-1] if kind == 3 and len(part) > 1 and part[0] == part[-1] else part
        out.append(1 << 3 | 1)
        step(own[0])
        out.append((len(own) - 1) << 3 | 2)
        for p in own[1:]:
            step(p)
        if kind == 3:
            out.append(1 << 3 | 7)
    return out


def encode(layers: dict[str, list[tuple]], extent: int = EXTENT) -> bytes:
    """Layers of (id, kind, parts, properties), which may be a generator; tags are kept once a layer."""
    tile = []
    for name, features in layers.items():
        keys, values, body = {}, {}, []  # pieces, joined once
        for fid, kind, parts, props in features:
            tags = b""
            for k, v in (props or {}).items():
                if v is not None:
                    tags += varint(keys.setdefault(k, len(keys))) + varint(values.setdefault(_value(v), len(values)))
            f = b"" if fid is None else varint(1 << 3) + varint(fid)
            f += _field(2, tags) if tags else b""
            body.append(_field(2, f + varint(3 << 3) + varint(kind) + _field(4, b"".join(map(varint, commands(kind, parts))))))
        head = varint(15 << 3) + varint(2) + _field(1, name.encode())
        body = b"".join([head, *body, *(_field(3, k.encode()) for k in keys), *(_field(4, v) for v in values), varint(5 << 3) + varint(extent)])
        tile += [varint(3 << 3 | 2) + varint(len(body)), body]
    return b"".join(tile)


# ---------------------------------------------------------------- clipping

def clip_line(part, lo: float, hi: float) -> list[list[tuple[float, float]]]:
    """The runs of a line within the square lo..hi."""
    out: list = []
    for (x0, y0), (x1, y1) in zip(part, part[1:]):
        t0, t1 = 0.0, 1.0
        for d, a in ((x1 - x0, x0), (y1 - y0, y0)):
            if d == 0:
                if not lo <= a <= hi:
                    t0, t1 = 1.0, 0.0
            else:
                u, v = sorted(((lo - a) / d, (hi - a) / d))
                t0, t1 = max(t0, u), min(t1, v)
        if t0 > t1:
            continue
        p, q = (x0 + t0 * (x1 - x0), y0 + t0 * (y1 - y0)), (x0 + t1 * (x1 - x0), y0 + t1 * (y1 - y0))
        if out and t0 == 0 and out[-1][-1] == p:
            out[-1].append(q)
        else:
            out.append([p, q])
    return out


def clip_ring(ring, lo: float, hi: float) -> list[tuple[float, float]]:
    """A closed ring cut to the square, side by side."""
    own = list(ring[:-1]) if len(ring) > 1 and ring[0] == ring[-1] else list(ring)
    for axis, limit, keep in ((0, lo, 1), (0, hi, -1), (1, lo, 1), (1, hi, -1)):
        inside = lambda p: keep * (p[axis] - limit) >= 0  # noqa: E731, B023
        out = []
        for a, b in zip(own, own[1:] + own[:1]):
            if inside(a):
                out.append(a)
            if inside(a) != inside(b):
                t = (limit - a[axis]) / (b[axis] - a[axis])
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
        own = out
    return own + own[:1] if len(own) >= 3 else []


def thinned(part, tolerance: float):
    """A line without positions that stray less than the tolerance."""
    import numpy as np

    from ..operators.planar import simplified

    return [part[i] for i in simplified(np.array(part, float), tolerance)] if len(part) > 2 and tolerance > 0 else part


# ---------------------------------------------------------------- tiles of rows

def world(lng: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """A place in tiles of a zoom, as x and y from the upper left."""
    n = float(2 ** zoom)
    y = (1 - F.log(F.tan(F.radians(lat)) + 1 / F.cos(F.radians(lat))) / math.pi) / 2
    return (lng + 180) / 360 * n, F.least(F.greatest(y, F.lit(0.0)), F.lit(1.0)) * n


def tiles(features: DataFrame, zoom: int, layer: str = "layer", tolerance: float = 3.0, extent: int = EXTENT, buffer: int = BUFFER) -> DataFrame:
    """(x, y, content) of the features (feature, type, coords, properties as JSON) at a zoom. A
    feature goes to the tiles that its envelope and the buffer meet; there it is clipped,
    thinned and put on the grid. Features that come to nothing are left out."""
    at = F.transform("coords", lambda p: F.struct(*(c.alias(n) for n, c in zip("xy", world(p["x"], p["y"], zoom)))))
    f = features.where("size(coords) > 0").select("feature", "type", at.alias("w"), "properties")
    rim, n = buffer / extent, 2 ** zoom
    edge = lambda a, fn, d: F.least(F.greatest(F.floor(fn(F.transform("w", lambda p: p[a])) + d), F.lit(0)), F.lit(n - 1))
    f = f.withColumn("tx", F.explode(F.sequence(edge("x", F.array_min, -rim), edge("x", F.array_max, rim)))).withColumn("ty", F.explode(F.sequence(edge("y", F.array_min, -rim), edge("y", F.array_max, rim))))

    grid = lambda part: [p for i, p in enumerate(q) if not i or p != q[i - 1]] if (q := [(round(x), round(y)) for x, y in part]) else []

    def shapes(table, tx, ty):
        """The features of a tile by their number; as objects there are a few thousand at a time."""
        read = functools.lru_cache(4096)(json.loads)
        order = pc.sort_indices(table, sort_keys=[("feature", "ascending")])
        for at in range(0, len(order), 4096):
            rows = table.take(order.slice(at, 4096))
            for feature, kind, w, text in zip(*(rows[c].to_pylist() for c in ("feature", "type", "w", "properties"))):
                p = [((v["x"] - tx) * extent, (v["y"] - ty) * extent) for v in w]
                kind = KINDS.get(kind)
                if kind == 1:
                    parts = [[(round(x), round(y)) for x, y in p if -buffer <= x <= extent + buffer and -buffer <= y <= extent + buffer]]
                elif kind == 2:
                    parts = [g for c in clip_line(thinned(p, tolerance), -buffer, extent + buffer) if len(g := grid(c)) > 1]
                elif kind == 3:
                    parts = [g for c in [clip_ring(thinned(p, tolerance), -buffer, extent + buffer)] if len(g := grid(c)) > 3]
                else:
                    parts = []
                if any(parts):
                    yield int(feature), kind, parts, read(text) if text else {}

    def run(table):
        tx, ty = (table[c][0].as_py() for c in ("tx", "ty"))
        own = shapes(table, tx, ty)
        first = next(own, None)
        content = [] if first is None else [encode({layer: itertools.chain([first], own)}, extent)]
        return pa.table({"x": pa.array([tx] * len(content), pa.int64()), "y": pa.array([ty] * len(content), pa.int64()), "content": pa.array(content, pa.binary())})

    return f.groupBy("tx", "ty").applyInArrow(run, "x long, y long, content binary")
