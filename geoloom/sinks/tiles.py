"""3D tiles: point, mesh and instance tiles, glTF binaries, tilesets and terrain."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.meshing import ears, grid_triangles

WHITE = (255, 255, 255)


def _pad(b: bytes, n: int = 8, fill: bytes = b"\0", before: int = 0) -> bytes:
    return b + fill * (-(len(b) + before) % n)


def _json(x, n: int = 8, before: int = 0) -> bytes:
    return _pad(json.dumps(x, separators=(",", ":")).encode(), n, b" ", before)


def _tile(magic: bytes, head: bytes, table: dict, body: bytes, batch: bytes, content: bytes) -> bytes:
    """Header (28 bytes, and ``head``), feature table, batch table, content."""
    ft, fb = _json(table, 8, 28 + len(head)), _pad(body)
    n = 28 + len(head) + len(ft) + len(fb) + len(batch) + len(content)
    return magic + struct.pack("<6I", 1, n, len(ft), len(fb), len(batch), 0) + head + ft + fb + batch + content


def oct16(n: np.ndarray) -> np.ndarray:
    """(k, 2) bytes of unit vectors, octahedral."""
    n = np.asarray(n, float).reshape(-1, 3)
    o = n[:, :2] / (np.abs(n[:, 0]) + np.abs(n[:, 1]) + np.maximum(np.abs(n[:, 2]), 1e-10))[:, None]
    fold = (1 - np.abs(o[:, ::-1])) * np.where(o >= 0, 1.0, -1.0)
    o = np.where(n[:, 2:] < 0, fold, o)
    return np.floor(np.clip(o * 0.5 + 0.5, 0, 0.99999) * 255 + 0.5).astype(np.uint8)


def pnts(xyz: np.ndarray, colours: np.ndarray | None = None, normals: np.ndarray | None = None) -> bytes:
    """A point tile about the points' middle: single floats, RGB bytes, oct16 normals."""
    xyz = np.asarray(xyz, float).reshape(-1, 3)
    mid = (xyz.min(axis=0) + xyz.max(axis=0)) / 2 if len(xyz) else np.zeros(3)
    body = (xyz - mid).astype("<f4").tobytes()
    table = {"POINTS_LENGTH": len(xyz), "RTC_CENTER": mid.tolist(), "POSITION": {"byteOffset": 0}}
    if colours is not None:
        table["RGB"] = {"byteOffset": len(body)}
        body += np.asarray(colours, np.uint8).tobytes()
    if normals is not None:
        table["NORMAL_OCT16P"] = {"byteOffset": len(body)}
        body += oct16(normals).tobytes()
    return _tile(b"pnts", b"", table, body, b"", b"")


def b3dm(glb: bytes, batches: int = 0, batch_table: dict | None = None) -> bytes:
    if glb[:4] != b"glTF":
        raise ValueError("no glTF binary")
    return _tile(b"b3dm", b"", {"BATCH_LENGTH": batches}, b"", _json(batch_table) if batch_table else b"", glb)


def i3dm(glb: bytes, positions, quaternions=None, scales=None) -> bytes:
    """Instances of a glTF binary; a quaternion (x, y, z, w) becomes an up and a right vector."""
    if glb[:4] != b"glTF":
        raise ValueError("no glTF binary")
    p = np.asarray(positions, "<f4").reshape(-1, 3)
    table, body = {"INSTANCES_LENGTH": len(p), "POSITION": {"byteOffset": 0}}, p.tobytes()
    if quaternions is not None:
        x, y, z, w = np.asarray(quaternions, float).reshape(-1, 4).T
        up = np.stack([2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)], axis=1)
        right = np.stack([1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)], axis=1)
        for name, v in (("NORMAL_UP", up), ("NORMAL_RIGHT", right)):
            table[name] = {"byteOffset": len(body)}
            body += v.astype("<f4").tobytes()
    if scales is not None:
        table["SCALE"] = {"byteOffset": len(body)}
        body += np.asarray(scales, "<f4").tobytes()
    return _tile(b"i3dm", struct.pack("<I", 1), table, body, b"", glb)


# ---------------------------------------------------------------- glTF

class Gltf:
    """A scene of meshes and point sets, to JSON or one binary."""

    def __init__(self):
        self.bin, self.views, self.accessors, self.meshes, self.materials = b"", [], [], [], []

    def _accessor(self, a: np.ndarray, kind: str, component: int, target: int | None, bounds: bool = False) -> int:
        self.bin = _pad(self.bin, 4)
        view = {"buffer": 0, "byteOffset": len(self.bin), "byteLength": a.nbytes}
        if target:
            view["target"] = target
        self.bin += a.tobytes()
        self.views.append(view)
        acc = {"bufferView": len(self.views) - 1, "componentType": component, "count": len(a), "type": kind}
        if component == 5121:
            acc["normalized"] = True
        if bounds and len(a):
            acc |= {"min": a.min(axis=0).astype(float).tolist(), "max": a.max(axis=0).astype(float).tolist()}
        self.accessors.append(acc)
        return len(self.accessors) - 1

    def add_material(self, rgba=(1.0, 1.0, 1.0, 1.0), metallic: float = 0.0, roughness: float = 1.0) -> int:
        self.materials.append({"pbrMetallicRoughness": {"baseColorFactor": [float(v) for v in rgba], "metallicFactor": metallic, "roughnessFactor": roughness}})
        return len(self.materials) - 1

    def add_mesh(self, positions, indices=None, normals=None, colours=None, material: int = -1) -> int:
        """Triangles with ``indices``, else points."""
        a = {"POSITION": self._accessor(np.asarray(positions, "<f4").reshape(-1, 3), "VEC3", 5126, 34962, True)}
        if normals is not None:
            a["NORMAL"] = self._accessor(np.asarray(normals, "<f4").reshape(-1, 3), "VEC3", 5126, 34962)
        if colours is not None:
            c = np.asarray(colours, np.uint8).reshape(-1, 3)
            a["COLOR_0"] = self._accessor(np.column_stack([c, np.full(len(c), 255, np.uint8)]), "VEC4", 5121, 34962)
        p = {"attributes": a, "mode": 0 if indices is None else 4}
        if indices is not None:
            p["indices"] = self._accessor(np.asarray(indices, "<u4").ravel(), "SCALAR", 5125, 34963)
        if 0 <= material < len(self.materials):
            p["material"] = material
        self.meshes.append({"primitives": [p]})
        return len(self.meshes) - 1

    def scene(self) -> dict:
        out = {"asset": {"version": "2.0", "generator": "geoloom"}, "scene": 0, "scenes": [{"nodes": list(range(len(self.meshes)))}], "nodes": [{"mesh": i} for i in range(len(self.meshes))], "meshes": self.meshes,
               "accessors": self.accessors, "bufferViews": self.views, "buffers": [{"byteLength": len(_pad(self.bin, 4))}]}
        if self.materials:
            out["materials"] = self.materials
        return out

    def to_json(self) -> str:
        return json.dumps(self.scene(), separators=(",", ":"))

    def to_glb(self) -> bytes:
        text, body = _json(self.scene(), 4), _pad(self.bin, 4)
        return b"glTF" + struct.pack("<II", 2, 28 + len(text) + len(body)) + struct.pack("<I", len(text)) + b"JSON" + text + struct.pack("<I", len(body)) + b"BIN\0" + body


def points_glb(xyz, colours=None, normals=None) -> bytes:
    g = Gltf()
    g.add_mesh(xyz, None, normals, colours)
    return g.to_glb()


def mesh_glb(xyz, indices, normals=None, colours=None) -> bytes:
    g = Gltf()
    g.add_mesh(xyz, indices, normals, colours)
    return g.to_glb()


def terrain_glb(heights: np.ndarray, spacing: float = 1.0) -> bytes:
    """Two triangles a cell; normals by differences, the rim's by one side."""
    h, w = heights.shape
    r, c = np.indices((h, w))
    z = np.pad(heights.astype(float), 1, mode="edge")
    nx, ny = (z[1:-1, :-2] - z[1:-1, 2:]) / 2, (z[:-2, 1:-1] - z[2:, 1:-1]) / 2
    n = np.stack([nx, ny, np.ones((h, w))], -1)
    n /= np.linalg.norm(n, axis=-1, keepdims=True)
    xyz = np.stack([c * spacing, r * spacing, heights], -1)
    return mesh_glb(xyz.reshape(-1, 3), grid_triangles(w, h), n.reshape(-1, 3))


# ---------------------------------------------------------------- polygons on the globe

def extruded(ring, height: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Earth-centred corners (n, 3) and triangles of a polygon (lng, lat) at a height."""
    p = np.asarray(ring, float).reshape(-1, 2)
    a, b = 6378137.0, 6356752.314245179
    e2, lng, lat = 1 - b * b / (a * a), np.radians(p[:, 0]), np.radians(p[:, 1])
    n = a / np.sqrt(1 - e2 * np.sin(lat) ** 2)
    xyz = np.stack([(n + height) * np.cos(lat) * np.cos(lng), (n + height) * np.cos(lat) * np.sin(lng), (n * (1 - e2) + height) * np.sin(lat)], axis=1)
    return xyz, ears(p)


def polygon_tile(features, height_property: str | None = None) -> tuple[bytes, int]:
    """A mesh tile of the polygons of GeoJSON features, and how many features there are."""
    xyz, tri, at, n = [], [], 0, 0
    for f in features:
        n += 1
        g, p = f.get("geometry") or {}, f.get("properties") or {}
        polygons = [g["coordinates"]] if g.get("type") == "Polygon" else g["coordinates"] if g.get("type") == "MultiPolygon" else []
        for rings in polygons:
            z = p.get(height_property) if height_property else None
            z = float(z) if isinstance(z, (int, float)) else float(rings[0][0][2]) if len(rings[0][0]) > 2 else 0.0
            v, t = extruded([q[:2] for q in rings[0]], z)
            xyz.append(v)
            tri.append(t + at)
            at += len(v)
    g = Gltf()
    g.add_mesh(np.concatenate(xyz) if xyz else np.zeros((0, 3)), np.concatenate(tri) if tri else np.zeros((0, 3)))
    return b3dm(g.to_glb(), n), n


# ---------------------------------------------------------------- tilesets

def leaf_points(cloud: DataFrame, nodes: DataFrame, max_depth: int) -> DataFrame:
    """Cloud rows with the ``path`` of the octree leaf that holds them: an equi-join of code
    prefixes, a row of each point for each level that leaves have."""
    from ..operators.points import MORTON, _digits, _extent, finite

    depth = min(max_depth, MORTON)
    rows = cloud.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    b = _extent(rows, *"xyz").first()
    if b["lo_x"] is None:
        return rows.withColumn("path", F.lit(""))
    coded = _digits(rows, b, depth)
    leaves = nodes.where("leaf and n > 0").select("path", "level")
    levels = [r["level"] for r in leaves.select("level").distinct().collect()]  # depth + 1 at most
    octal = F.lpad(F.conv(F.col("code").cast("string"), 10, 8), depth, "0") if depth else F.lit("")
    own = coded.withColumn("_octal", octal).withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels])))
    return own.withColumn("path", F.substring(F.col("_octal"), F.lit(1), F.col("level"))).join(leaves, ["path", "level"]).drop("_octal", "code", "level")


def point_tiles(cloud: DataFrame, max_points: int, max_depth: int) -> DataFrame:
    """(path, n, content): a point tile of each octree leaf that has points. A leaf has
    ``max_points`` at most, but where its points can't be told apart; each row keeps its colour."""
    from ..operators.points import octree

    nodes = octree(cloud, max_points, max_depth)
    colour = all(c in cloud.columns for c in "rgb")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        return pd.DataFrame({"path": [pdf["path"].iloc[0]], "n": [len(pdf)], "content": [pnts(pdf[["x", "y", "z"]].to_numpy(), pdf[["r", "g", "b"]].to_numpy() if colour else None)]})

    return leaf_points(cloud, nodes, max_depth).groupBy("path").applyInPandas(run, "path string, n long, content binary")


def tileset(nodes: DataFrame, spacing: float | None = None, factor: float = 1.0) -> DataFrame:
    """(path, parent, box, error, uri): the tiles of a tileset; only leaves with points have a
    tile of their own. Errors halve from level to level, by the spacing where one is given."""
    from ..operators.points import geometric_error

    mid, half = [(F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 for a in "xyz"], [(F.col(f"max_{a}") - F.col(f"min_{a}")) / 2 for a in "xyz"]
    zero = F.lit(0.0)
    box = F.array(*mid, half[0], zero, zero, zero, half[1], zero, zero, zero, half[2])
    error = geometric_error(F.col("level")) if spacing is None else F.lit(spacing * factor) / F.pow(F.lit(2.0), F.col("level"))
    parent = F.when(F.col("level") > 0, F.substring(F.col("path"), F.lit(1), F.col("level") - 1))
    return nodes.where("n > 0").select("path", parent.alias("parent"), box.alias("box"), error.alias("error"), F.when(F.col("leaf"), F.concat(F.lit("tile_"), F.when(F.col("path") == "", "root").otherwise(F.col("path")), F.lit(".pnts"))).alias("uri"))


def tileset_json(rows: list) -> str:
    """The nested tileset of ``tileset`` rows (a subtree that fits the caller)."""
    at = {}
    for r in sorted(rows, key=lambda r: len(r["path"])):
        node = {"boundingVolume": {"box": list(r["box"])}, "geometricError": 0.0 if r["uri"] else r["error"], "refine": "ADD"}
        if r["uri"]:
            node["content"] = {"uri": r["uri"]}
        at[r["path"]] = node
        if r["parent"] in at:
            at[r["parent"]].setdefault("children", []).append(node)
    top = at[min(at, key=len)] if at else {}
    return json.dumps({"asset": {"version": "1.0"}, "geometricError": max((r["error"] for r in rows), default=0.0), "root": top}, separators=(",", ":"))


def mesh_tileset(xyz, indices, normals=None, colours=None, error: float = 0.0) -> tuple[str, bytes]:
    """tileset.json and the one mesh tile that it names."""
    p = np.asarray(xyz, float).reshape(-1, 3)
    lo, hi = p.min(axis=0), p.max(axis=0)
    half = (hi - lo) / 2
    box = [*((lo + hi) / 2), half[0], 0, 0, 0, half[1], 0, 0, 0, half[2]]
    text = json.dumps({"asset": {"version": "1.0"}, "geometricError": error, "root": {"boundingVolume": {"box": [float(v) for v in box]}, "geometricError": error, "refine": "REPLACE", "content": {"uri": "mesh.b3dm"}}}, separators=(",", ":"))
    return text, b3dm(mesh_glb(p, indices, normals, colours))


def instanced_tileset(glb: bytes, transforms, error: float = 0.0) -> tuple[str, list[bytes]]:
    """tileset.json and a tile for each column-major 4x4 transform."""
    m = np.asarray(transforms, float).reshape(-1, 16)
    kids = [{"transform": t.tolist(), "boundingVolume": {"sphere": [0, 0, 0, 1]}, "geometricError": 0.0, "content": {"uri": f"instance_{i}.b3dm"}} for i, t in enumerate(m)]
    text = json.dumps({"asset": {"version": "1.0"}, "geometricError": error, "root": {"boundingVolume": {"sphere": [0, 0, 0, float(np.abs(m[:, 12:15]).max(initial=0)) + 1]}, "geometricError": error, "refine": "ADD", "children": kids}}, separators=(",", ":"))
    return text, [b3dm(glb)] * len(m)


# ---------------------------------------------------------------- terrain

def quantized_mesh(heights: np.ndarray) -> bytes:
    """A grid as 16-bit u, v and height, triangles, and the corners on each side: counts
    first, numbers as they are (no zig-zag or high-water coding)."""
    h, w = heights.shape
    lo, hi = (float(heights.min()), float(heights.max())) if heights.size else (0.0, 0.0)
    r, c = np.indices((h, w))
    scaled = lambda v, n: np.floor(v / max(n, 1) * 32767).astype("<u2")
    hh = np.floor((heights - lo) / (hi - lo) * 32767).astype("<u2") if hi - lo > 1e-10 else np.zeros((h, w), "<u2")
    t = grid_triangles(w, h).astype("<u4")
    n = np.arange(h * w).reshape(h, w).astype("<u4")
    sides = [n[:, 0], n[-1], n[:, -1], n[0]]
    out = struct.pack("<3d2f", 0.0, 0.0, 0.0, lo, hi) + struct.pack("<I", h * w) + scaled(c, w - 1).tobytes() + scaled(r, h - 1).tobytes() + hh.tobytes()
    out = _pad(out, 4) + struct.pack("<I", len(t)) + t.tobytes()
    return out + b"".join(struct.pack("<I", len(s)) + s.astype("<u4").tobytes() for s in sides)


def pyramid(grid: DataFrame, key: str, max_zoom: int) -> DataFrame:
    """(key, level, row, col, z): each level keeps the even rows and columns of the one before
    it; level 0 is the grid itself, up to level 6."""
    top = min(max_zoom, 6)
    level = F.explode(F.sequence(F.lit(0), F.lit(top)))
    rows = grid.withColumn("level", level).withColumn("_s", F.expr("shiftleft(1L, level)"))
    return rows.where((F.col("row") % F.col("_s") == 0) & (F.col("col") % F.col("_s") == 0)).select(key, "level", (F.col("row") / F.col("_s")).cast("long").alias("row"), (F.col("col") / F.col("_s")).cast("long").alias("col"), "z")


def terrain_tiles(grid: DataFrame, key: str, max_zoom: int) -> DataFrame:
    """(key, level, width, height, error, content): a quantised mesh a level; errors 1000 / 2^level."""
    kind = next(f.dataType.simpleString() for f in grid.schema.fields if f.name == key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        g = np.zeros((int(pdf["row"].max()) + 1, int(pdf["col"].max()) + 1), np.float32)
        g[pdf["row"], pdf["col"]] = pdf["z"]
        level = int(pdf["level"].iloc[0])
        return pd.DataFrame({key: [pdf[key].iloc[0]], "level": [level], "width": [g.shape[1]], "height": [g.shape[0]], "error": [1000 / 2 ** level], "content": [quantized_mesh(g)]})

    return pyramid(grid, key, max_zoom).groupBy(key, "level").applyInPandas(run, f"{key} {kind}, level int, width long, height long, error double, content binary")
