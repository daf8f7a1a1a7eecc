"""GPX tracks and TopoJSON topologies to rows."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import BadFile, decoded

# ---------------------------------------------------------------- GPX, in generated code


def read_gpx(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, seq, lng, lat, ele, time): the track points of each text, in order. A point
    without elevation has 0, one without a numeric place is left out."""
    parts = F.regexp_extract_all(F.col(text), F.lit(r"(?s)(<trkpt\b[^>]*?(?:/>|>.*?</trkpt>))"), F.lit(1))
    p = df.select(key, F.posexplode(parts).alias("seq", "p"))
    attr = lambda name: F.regexp_extract("p", rf"""\b{name}\s*=\s*["']([^"']*)["']""", 1)
    inner = lambda name: F.regexp_extract("p", rf"<{name}>\s*([^<]*?)\s*</{name}>", 1)
    num = lambda c: c.try_cast("double")
    out = p.select(key, F.col("seq").cast("long"), num(attr("lon")).alias("lng"), num(attr("lat")).alias("lat"), F.coalesce(num(inner("ele")), F.lit(0.0)).alias("ele"), F.nullif(inner("time"), F.lit("")).alias("time"))
    return out.where("lng is not null and lat is not null")


# ---------------------------------------------------------------- TopoJSON

TOPO = "object string, part long, seq long, lng double, lat double, type string"


def _arcs(t: dict) -> list[list[tuple[float, float]]]:
    """Arcs as positions: with a transform they are steps on a grid."""
    tr = t.get("transform")
    out = []
    for arc in t.get("arcs") or []:
        x = y = 0.0
        own = []
        for p in arc:
            if tr:
                x, y = x + p[0], y + p[1]
                own.append((x * tr["scale"][0] + tr["translate"][0], y * tr["scale"][1] + tr["translate"][1]))
            else:
                own.append((float(p[0]), float(p[1])))
        out.append(own)
    return out


def _line(arcs, refs) -> list[tuple[float, float]]:
    """Arcs end to end, a shared position once; a negative reference is the arc ~i turned round."""
    out: list = []
    for r in refs:
        own = arcs[r] if r >= 0 else arcs[~r][::-1]
        out += own[1:] if out else own
    return out


def _parts(g: dict, arcs, place):
    kind, refs = g.get("type"), g.get("arcs")
    if kind == "Point":
        yield [place(g["coordinates"])]
    elif kind == "MultiPoint":
        yield [place(c) for c in g["coordinates"]]
    elif kind == "LineString":
        yield _line(arcs, refs)
    elif kind in ("MultiLineString", "Polygon"):
        for r in refs:
            yield _line(arcs, r)
    elif kind == "MultiPolygon":
        for p in refs:
            for r in p:
                yield _line(arcs, r)


def topology(text: str):
    """(object name, geometry, its parts) of every geometry."""
    try:
        t = json.loads(text)
    except ValueError as e:
        raise BadFile(f"not JSON: {e}") from None
    if not isinstance(t, dict) or t.get("type") != "Topology":
        raise BadFile("no topology")
    arcs, tr = _arcs(t), t.get("transform")
    place = lambda c: (c[0] * tr["scale"][0] + tr["translate"][0], c[1] * tr["scale"][1] + tr["translate"][1]) if tr else (float(c[0]), float(c[1]))

    def walk(name, g):
        if g.get("type") == "GeometryCollection":
            for h in g.get("geometries") or []:
                yield from walk(name, h)
        else:
            try:
                yield name, g, list(_parts(g, arcs, place))
            except (IndexError, KeyError, TypeError):
                raise BadFile(f"a geometry of {name!r} refers to what is not there") from None

    for name, g in (t.get("objects") or {}).items():
        yield from walk(name, g)


def read_topojson(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row a position: object, part (numbered over the object's geometries), place, type."""
    def parse(s):
        rows, part, last = [], 0, None
        for name, g, parts in topology(s):
            part = part if name == last else 0
            last = name
            for p in parts:
                rows += [(name, part, i, x, y, g["type"]) for i, (x, y) in enumerate(p)]
                part += 1
        yield pd.DataFrame(rows, columns=["object", "part", "seq", "lng", "lat", "type"])

    return decoded(df, key, text, parse, TOPO)


def _geometry(g: dict, parts) -> dict:
    kind = g["type"]
    xy = [[list(p) for p in part] for part in parts]
    if kind == "Point":
        c = xy[0][0]
    elif kind in ("LineString", "MultiPoint"):
        c = xy[0]
    elif kind == "MultiPolygon":
        c, at = [], 0
        for polygon in g["arcs"]:
            c.append(xy[at:at + len(polygon)])
            at += len(polygon)
    else:
        c = xy
    return {"type": kind, "coordinates": c}


def to_geojson(text: str) -> str:
    """The topology as a collection of features, with ids and properties."""
    out = []
    for _, g, parts in topology(text):
        f = {"type": "Feature", "geometry": _geometry(g, parts) if g.get("type") else None, "properties": g.get("properties") or {}}
        if "id" in g:
            f["id"] = g["id"]
        out.append(f)
    return json.dumps({"type": "FeatureCollection", "features": out}, separators=(",", ":"))


def topojson_to_geojson(df: DataFrame, key: str, text: str) -> DataFrame:
    return decoded(df, key, text, lambda s: [pd.DataFrame({"text": [to_geojson(s)]})], "text string")


# ---------------------------------------------------------------- IFC

IFC = "solid long, seq long, x double, y double, z double"
_ENTITY = re.compile(r"#(\d+)\s*=\s*([A-Z0-9_]+)\s*\((.*)\)\s*;", re.S)


def _split(args: str) -> list[str]:
    """Arguments at the outer level."""
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(args):
        if c == "'":
            quoted = not quoted
        elif not quoted:
            depth += c == "("
            depth -= c == ")"
            if c == "," and not depth:
                out.append(args[at:i].strip())
                at = i + 1
    return [*out, args[at:].strip()]


def ifc_entities(text: str) -> dict[int, tuple[str, list[str]]]:
    """id: (name, arguments) of the data section, whatever lines it is broken into."""
    out, quoted, at = {}, False, 0
    for i, c in enumerate(text):
        if c == "'":
            quoted = not quoted
        elif c == ";" and not quoted:
            if m := _ENTITY.match(text[at:i + 1].strip()):
                out[int(m[1])] = (m[2], _split(m[3]))
            at = i + 1
    return out


def _numbers(text: str) -> list[float]:
    return [float(v) for v in re.findall(r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", text)]


def _profile(e: dict, ref: int) -> list[tuple[float, float]]:
    kind, a = e.get(ref, ("", []))
    if kind == "IFCRECTANGLEPROFILEDEF":
        x, y = float(a[3]) / 2, float(a[4]) / 2
        return [(-x, -y), (x, -y), (x, y), (-x, y)]
    if kind == "IFCARBITRARYCLOSEDPROFILEDEF":
        line = e.get(int(a[2].lstrip("#")), ("", []))
        if line[0] == "IFCPOLYLINE":
            refs = [int(r) for r in re.findall(r"#(\d+)", line[1][0])]
            points = [tuple(_numbers(e[r][1][0])[:2]) for r in refs if e.get(r, ("",))[0] == "IFCCARTESIANPOINT"]
            return points[:-1] if len(points) > 1 and points[0] == points[-1] else points
    return []


def ifc_solids(text: str):
    """(id, profile, direction, depth) of every extruded solid whose profile can be read."""
    e = ifc_entities(text)
    for i, (kind, a) in sorted(e.items()):
        if kind == "IFCEXTRUDEDAREASOLID" and len(a) >= 4:
            p = _profile(e, int(a[0].lstrip("#"))) if a[0].startswith("#") else []
            if len(p) >= 3:
                d = e.get(int(a[2].lstrip("#")) if a[2].startswith("#") else -1, ("", ["(0.,0.,1.)"]))[1][0]
                yield i, p, (_numbers(d) + [0.0, 0.0, 1.0])[:3], float(a[3])


def read_ifc(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, solid, seq, x, y, z): the triangle corners, three a triangle, of the prisms that
    extruded solids make: floor, roof, and two triangles a wall."""
    from ..operators.meshing import prism

    def parse(s):
        for i, p, d, depth in ifc_solids(s):
            t = prism(p, d, depth)
            yield pd.DataFrame({"solid": [i] * len(t), "seq": range(len(t)), "x": t[:, 0], "y": t[:, 1], "z": t[:, 2]})

    return decoded(df, key, text, parse, IFC)
