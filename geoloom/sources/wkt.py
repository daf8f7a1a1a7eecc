"""Well-known text and binary of points, lines and polygons, both ways.

A geometry is a struct of its type and parts: ``type`` is POINT, MULTIPOINT, LINESTRING or
POLYGON, ``parts`` an array of position arrays (rings of a polygon, one part else).
"""

from __future__ import annotations

import re
import struct

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import BadFile

GEOMETRY = "type string, parts array<array<struct<x:double,y:double>>>"
KINDS = {1: "POINT", 2: "LINESTRING", 3: "POLYGON", 4: "MULTIPOINT"}
_HEAD = re.compile(r"\s*(?:SRID=\d+;)?\s*(POINT|MULTIPOINT|LINESTRING|POLYGON)\s*(Z|M|ZM)?\s*(EMPTY\s*$|\()", re.I)


def _position(text: str) -> tuple[float, float]:
    words = text.strip().strip("()").split()
    if len(words) < 2:
        raise BadFile(f"no position: {text!r}")
    try:
        return float(words[0]), float(words[1])
    except ValueError:
        raise BadFile(f"no number in {text!r}") from None


def parse_wkt(text: str) -> tuple[str, list[list[tuple[float, float]]]]:
    """Type and parts; ordinates after the second are dropped, EMPTY has no parts."""
    m = _HEAD.match(text)
    if not m:
        raise BadFile(f"no supported geometry: {text[:40]!r}")
    kind, at = m[1].upper(), m.end()
    if m[3].upper().startswith("EMPTY"):
        return kind, []
    body = text[at:].strip()
    if not body.endswith(")"):
        raise BadFile("an open parenthesis")
    body = body[:-1]
    if kind == "POLYGON":
        rings = re.findall(r"\(([^()]*)\)", body)
        if not rings or re.sub(r"\([^()]*\)|[\s,]", "", body):
            raise BadFile("rings that are no lists of positions")
        return kind, [[_position(p) for p in r.split(",")] for r in rings]
    return kind, [[_position(p) for p in body.split(",")]]


def _struct(kind: str, parts) -> dict:
    return {"type": kind, "parts": [[{"x": x, "y": y} for x, y in p] for p in parts]}


def from_wkt(text: Column) -> Column:
    """The geometry of a text; a null has none, a broken one raises."""
    @F.pandas_udf(GEOMETRY)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{"type": None, "parts": None} if t is None else _struct(*parse_wkt(t)) for t in s], columns=["type", "parts"])

    return run(text)


def parse_wkb(b: bytes) -> tuple[str, list[list[tuple[float, float]]]]:
    """Type and parts of types 1 to 4 in either byte order; Z and M ordinates are dropped."""
    try:
        kind, parts, at = _wkb(b, 0)
    except struct.error:
        raise BadFile("the geometry is cut off") from None
    return kind, parts


def _wkb(b: bytes, at: int):
    if at >= len(b) or b[at] > 1:
        raise BadFile("no byte order")
    order = "<" if b[at] else ">"
    code = struct.unpack_from(f"{order}I", b, at + 1)[0]
    at += 5
    if code & 0x20000000:
        at += 4
    extra = bool(code & 0x80000000) + bool(code & 0x40000000)
    code &= 0x1FFFFFFF
    extra += {0: 0, 1: 1, 2: 1, 3: 2}.get(code // 1000, 0)
    kind, width = KINDS.get(code % 1000), 16 + 8 * extra
    if not kind:
        raise BadFile(f"geometry type {code}")

    def run(at: int, n: int):
        if at + n * width > len(b):
            raise BadFile("the geometry is cut off")
        return [struct.unpack_from(f"{order}dd", b, at + i * width) for i in range(n)], at + n * width

    if kind == "POINT":
        p, at = run(at, 1)
        return kind, [] if p[0][0] != p[0][0] else [p], at
    n = struct.unpack_from(f"{order}I", b, at)[0]
    at += 4
    if kind == "LINESTRING":
        p, at = run(at, n)
        return kind, [p] if p else [], at
    out = []
    for _ in range(n):
        if kind == "POLYGON":
            m = struct.unpack_from(f"{order}I", b, at)[0]
            p, at = run(at + 4, m)
            out.append(p)
        else:
            _, p, at = _wkb(b, at)
            out.extend(q for r in p for q in r)
    return kind, ([out] if out else []) if kind == "MULTIPOINT" else out, at


def from_wkb(content: Column) -> Column:
    @F.pandas_udf(GEOMETRY)
    def run(s: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([{"type": None, "parts": None} if b is None else _struct(*parse_wkb(bytes(b))) for b in s], columns=["type", "parts"])

    return run(content)


def flat(geometry: Column) -> Column:
    """All positions of a geometry, its parts one after the other."""
    return F.flatten(geometry["parts"])


def to_wkt(geometry: Column, digits: int | None = None) -> Column:
    """The text, in generated code; numbers as Spark prints them, or with ``digits``."""
    number = (lambda c: F.format_string(f"%.{digits}f", c)) if digits is not None else (lambda c: c.cast("string"))
    part = lambda p: F.concat(F.lit("("), F.array_join(F.transform(p, lambda v: F.concat_ws(" ", number(v["x"]), number(v["y"]))), ", "), F.lit(")"))
    parts = F.transform(geometry["parts"], part)
    body = F.when(F.size(geometry["parts"]) == 0, F.lit(" EMPTY")).when(geometry["type"] == "POLYGON", F.concat(F.lit("("), F.array_join(parts, ", "), F.lit(")"))).otherwise(parts[0])
    return F.concat(geometry["type"], body)


def to_wkb(geometry: Column) -> Column:
    """Little-endian bytes; an empty point has NaN ordinates."""
    codes = {k: c for c, k in KINDS.items()}

    def one(kind: str, parts) -> bytes:
        xy = lambda p: b"".join(struct.pack("<dd", v["x"], v["y"]) for v in p)
        head = struct.pack("<BI", 1, codes[kind])
        if kind == "POINT":
            return head + (xy(parts[0][:1]) if len(parts) else struct.pack("<dd", float("nan"), float("nan")))
        if kind == "LINESTRING":
            return head + struct.pack("<I", sum(map(len, parts))) + b"".join(map(xy, parts))
        if kind == "POLYGON":
            return head + struct.pack("<I", len(parts)) + b"".join(struct.pack("<I", len(p)) + xy(p) for p in parts)
        return head + struct.pack("<I", sum(map(len, parts))) + b"".join(struct.pack("<BIdd", 1, 1, v["x"], v["y"]) for p in parts for v in p)

    @F.pandas_udf("binary")
    def run(g: pd.DataFrame) -> pd.Series:
        return pd.Series([None if k is None else one(k, p) for k, p in zip(g["type"], g["parts"])])

    return run(geometry)


def geometry(kind: str, parts: Column) -> Column:
    return F.struct(F.lit(kind).alias("type"), parts.alias("parts"))
