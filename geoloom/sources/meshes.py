"""PLY, OBJ and PCD files to points; E57 as far as its header."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import BadFile, NoCodec, chunks, decoded
from ..functions import limits

POINTS = "idx long, x float, y float, z float, r int, g int, b int, nx float, ny float, nz float"
_TYPES = {"char": "i1", "uchar": "u1", "short": "i2", "ushort": "u2", "int": "i4", "uint": "u4", "float": "f4", "double": "f8", "int8": "i1", "uint8": "u1", "int16": "i2", "uint16": "u2", "int32": "i4", "uint32": "u4", "float32": "f4", "float64": "f8"}


def _number(word: bytes) -> float:
    try:
        return float(word)
    except ValueError:
        return 0.0


def _points(cols: dict, n: int) -> pd.DataFrame:
    """The point schema from what a file has of it; a colour or normal needs all three parts."""
    out = {"idx": np.arange(n)}
    out |= {a: np.asarray(cols[a], np.float32) for a in "xyz"}
    for names, kind in ((("r", "g", "b"), "Int32"), (("nx", "ny", "nz"), "Float32")):
        there = all(c in cols for c in names)
        for c in names:
            out[c] = pd.array(np.asarray(cols[c]).astype(np.int32 if kind == "Int32" else np.float32), kind) if there else pd.array([None] * n, kind)
    return pd.DataFrame(out)


# ---------------------------------------------------------------- PLY

def ply_header(b: bytes) -> dict:
    """format, vertex count and properties, face count, and where the data begin."""
    if b[:3] != b"ply":
        raise BadFile("no ply at the start")
    end = b.find(b"end_header")
    if end < 0:
        raise BadFile("a header without an end")
    at = b.find(b"\n", end) + 1 or len(b)
    out = {"format": None, "vertices": 0, "faces": 0, "properties": [], "data": at, "lead": []}
    element = None
    for line in b[:end].decode("ascii", "replace").split("\n"):
        w = line.split()
        if not w:
            continue
        if w[0] == "format" and len(w) > 1:
            out["format"] = w[1]
        elif w[0] == "element" and len(w) > 2:
            element = w[1]
            if element == "vertex":
                out["vertices"] = int(w[2])
            elif element == "face":
                out["faces"] = int(w[2])
        elif w[0] == "property" and element == "vertex" and len(w) > 2:
            if w[1] not in _TYPES:
                raise BadFile(f"vertex property of type {w[1]}")
            out["properties"].append((w[2], _TYPES[w[1]]))
    if out["format"] not in ("ascii", "binary_little_endian"):
        raise BadFile(f"format {out['format']}")
    if not {"x", "y", "z"} <= {n for n, _ in out["properties"]}:
        raise BadFile("a vertex without x, y or z")
    return out


_ALIAS = {"red": "r", "green": "g", "blue": "b"}


def ply(b: bytes):
    """Frames of the vertices, in the file's order. Faces are counted by the header alone."""
    h = ply_header(b)
    names, n = [_ALIAS.get(p, p) for p, _ in h["properties"]], h["vertices"]
    if h["format"] == "ascii":
        rows = [r for r in (line.split() for line in b[h["data"]:].split(b"\n")) if r][:n]
        if len(rows) < n or any(len(r) < len(names) for r in rows):
            raise BadFile("fewer vertices than the header says")
        cols = {name: [_number(r[k]) for r in rows] for k, name in enumerate(names)}
    else:
        kind = np.dtype([(f"{i}", "<" + t) for i, (_, t) in enumerate(h["properties"])])
        if len(b) - h["data"] < n * kind.itemsize:
            raise BadFile("fewer vertices than the header says")
        rec = np.frombuffer(b, kind, n, h["data"])
        cols = {name: rec[f"{i}"] for i, name in enumerate(names)}
    yield from chunks(_points(cols, n))


def read_ply(df: DataFrame, key: str, content: str) -> DataFrame:
    return decoded(df, key, content, ply, POINTS)


def ply_faces(df: DataFrame, key: str, content: str) -> DataFrame:
    """(key, vertices, faces) as the headers say."""
    return decoded(df, key, content, lambda b: [pd.DataFrame([(ply_header(b)["vertices"], ply_header(b)["faces"])])], "vertices long, faces long")


# ---------------------------------------------------------------- OBJ: lines, in generated code

def read_obj(df: DataFrame, key: str, text: str, part: str | None = None) -> DataFrame:
    """(key, idx, x, y, z, nx, ny, nz): ``v`` lines by their order, with the ``vn`` lines of the
    same order where a text has as many of both. Malformed lines are passed over; faces too.
    With ``part`` a text is the rows of a key in that order: each is parsed where it lies, and
    the sizes of those before it say where its lines count from. Parts with as many of both
    lines, before them too, pair them on the spot; lines of other parts are joined."""
    from ..operators.durable import stored

    words = F.transform(F.split(text, r"\r?\n"), lambda t: F.split(F.trim(t), r"\s+"))
    num = lambda w: F.struct(*(F.get(w, F.lit(i)).try_cast("float").alias(a) for i, a in ((1, "x"), (2, "y"), (3, "z"))))
    own = lambda kind: F.filter(F.transform(F.filter("w", lambda w: w[0] == kind), num), lambda p: p["x"].isNotNull() & p["y"].isNotNull() & p["z"].isNotNull())
    rows = df.where(F.col(text).isNotNull()).select(key, (F.col(part) if part else F.lit(0)).cast("long").alias("part"), words.alias("w"))
    lists = rows.select(key, "part", F.posexplode(F.arrays_zip(own("v").alias("v"), own("vn").alias("n"))).alias("i", "p"))  # flat, as lists are read by the thousand
    rows = stored(lists.select(key, "part", "i", *(F.col(f"p.v.{a}").alias(a) for a in "xyz"), *(F.col(f"p.n.{a}").alias(f"n{a}") for a in "xyz")))
    sizes = rows.groupBy(key, "part").agg(F.count("x").alias("nv"), F.count("nx").alias("nn"))  # a row a part
    file = Window.partitionBy(key)
    before = file.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    placed = sizes.select(key, "part", "nv", "nn", first("nv").alias("v0"), first("nn").alias("n0"), (F.sum("nv").over(file) == F.sum("nn").over(file)).alias("both"))
    placed = placed.select(key, "part", "v0", "n0", "both", (F.col("both") & (F.col("v0") == F.col("n0")) & (F.col("nv") == F.col("nn"))).alias("here"))
    rows = rows.join(F.broadcast(placed), [key, "part"])
    v, n = [F.col(a) for a in "xyz"], [F.col(f"n{a}") for a in "xyz"]
    at = lambda c: (F.col(c) + F.col("i")).alias("idx")
    far = rows.where("both and not here and nx is not null").select(key, at("n0"), *n)
    return rows.where("here").select(key, at("v0"), *v, *n).unionAll(rows.where("not here and x is not null").select(key, at("v0"), *v).join(far, [key, "idx"], "left").select(key, "idx", *v, *n))


# ---------------------------------------------------------------- PCD

def pcd_header(b: bytes) -> dict:
    """Fields with their types, points, kind of data, and where they begin."""
    at, h = 0, {}
    while "DATA" not in h:
        end = b.find(b"\n", at)
        if end < 0:
            raise BadFile("a PCD header without DATA")
        line, at = b[at:end].decode("ascii", "replace").strip(), end + 1
        if line and not line.startswith("#"):
            w = line.split()
            h[w[0].upper()] = w[1:]
    fields = [f.lower() for f in h.get("FIELDS", [])]
    if not {"x", "y", "z"} <= set(fields):
        raise BadFile("no x, y or z field")
    size, kind, count = ([*h.get(k, []), *[d] * len(fields)][:len(fields)] for k, d in (("SIZE", "4"), ("TYPE", "F"), ("COUNT", "1")))
    n = int(h["POINTS"][0]) if h.get("POINTS") else int((h.get("WIDTH") or ["0"])[0]) * int((h.get("HEIGHT") or ["1"])[0])
    return {"fields": fields, "types": [f"{t.lower()}{s}" for s, t in zip(size, kind)], "counts": [int(c) for c in count], "points": n, "data": (h["DATA"] or [""])[0].lower(), "at": at}


def _rgb(packed: np.ndarray) -> dict:
    bits = np.asarray(packed).astype("<f4").view("<u4")
    return {"r": (bits >> 16) & 255, "g": (bits >> 8) & 255, "b": bits & 255}


def pcd(b: bytes):
    """Frames of the points of ascii or binary data. Short ascii rows are passed over, words
    that are no numbers count as 0; a binary file that is cut off gives its whole records."""
    h = pcd_header(b)
    if h["data"] == "ascii":
        at, width = {}, 0
        for f, c in zip(h["fields"], h["counts"]):
            at[f], width = width, width + c
        rows = [r for r in (line.split() for line in b[h["at"]:].split(b"\n")) if len(r) >= width][:h["points"] or None]
        cols = {f: np.array([_number(r[k]) for r in rows], float) for f, k in at.items()}
        n = len(rows)
    elif h["data"] == "binary":
        kind = np.dtype([(f"{i}", "<" + t, (c,)) for i, (t, c) in enumerate(zip(h["types"], h["counts"]))])
        n = min(h["points"], (len(b) - h["at"]) // kind.itemsize)
        rec = np.frombuffer(b, kind, n, h["at"])
        cols = {f: rec[f"{i}"][:, 0] for i, f in enumerate(h["fields"])}
    else:
        raise BadFile(f"data {h['data']!r}")
    for name in ("rgb", "rgba"):
        if name in cols:
            v = cols[name]
            cols |= _rgb(v if v.dtype.kind == "f" else v.astype("<u4").view("<f4"))
    yield from chunks(_points(cols, n))


def read_pcd(df: DataFrame, key: str, content: str, part: str | None = None) -> DataFrame:
    """With ``part`` a file is the rows of a key in that order, the first with the whole header
    and each ending with a whole point: every part is parsed behind that header where it lies,
    and the sizes of those before it say where its points count from."""
    if part is None:
        return decoded(df, key, content, pcd, POINTS)
    from ..operators.durable import stored

    most, names = limits.get_input_size_limit(), [n.split()[0] for n in POINTS.split(", ")]
    key_type = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)

    @F.pandas_udf("head binary, most long")
    def head(s: pd.Series) -> pd.DataFrame:
        own = [(bytes(b), pcd_header(bytes(b))) for b in s]
        return pd.DataFrame({"head": [b[:h["at"]] for b, h in own], "most": pd.array([None if h["data"] == "ascii" and not h["points"] else h["points"] for _, h in own], "Int64")})

    def parse(frames):
        limits.set_input_size_limit(most)
        for pdf in frames:
            for k, p, c in zip(pdf[key], pdf["part"], pdf["content"]):
                limits.check_input_size(len(c), str(k))
                at = 0
                for out in pcd(bytes(c)):
                    out.insert(0, key, k)
                    out.insert(1, "part", p)
                    out["idx"] = range(at, at + len(out))
                    at += len(out)
                    yield out

    files = df.where(F.col(content).isNotNull()).select(key, F.col(part).alias("part"), F.col(content).alias("content"))
    heads = files.groupBy(key).agg(F.min("part").alias("first"), F.min_by("content", "part").alias("c")).select(key, "first", head("c").alias("h")).select(key, "first", "h.*")  # a row a file
    own = files.join(F.broadcast(heads.drop("most")), key).select(key, "part", F.when(F.col("part") == F.col("first"), F.col("content")).otherwise(F.concat("head", "content")).alias("content"))
    rows = stored(own.mapInPandas(parse, f"{key} {key_type}, part long, {POINTS}"))
    before = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy(key, "part").agg(F.count(F.lit(1)).alias("n")).select(key, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row a part
    out = rows.join(F.broadcast(starts), [key, "part"]).join(F.broadcast(heads.select(key, "most")), key).withColumn("idx", F.col("idx") + F.col("start"))
    return out.where("most is null or idx < most").select(key, *names)


# ---------------------------------------------------------------- E57

def e57_header(b: bytes) -> dict:
    """Version, lengths and the place of the XML part; the points themselves have no reader here."""
    if b[:8] != b"ASTM-E57":
        raise BadFile("no ASTM-E57 at the start")
    if len(b) < 48:
        raise BadFile("the header is cut off")
    major, minor, length, xml_at, xml_n, page = struct.unpack_from("<IIQQQQ", b, 8)
    return {"version": f"{major}.{minor}", "length": length, "xml_offset": xml_at, "xml_length": xml_n, "page": page}


def e57(b: bytes):
    e57_header(b)
    raise NoCodec("E57 points have no reader here")
