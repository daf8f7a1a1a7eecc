"""Point tiles and glTF binaries read back."""

from __future__ import annotations

import json
import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from . import BadFile, decoded


def tile(b: bytes, magic: bytes) -> tuple[dict, bytes, bytes]:
    """Feature table, its bytes, and the content."""
    if b[:4] != magic or len(b) < 28:
        raise BadFile(f"no {magic.decode()} tile")
    version, n, ft, fb, bt, bb = struct.unpack_from("<6I", b, 4)
    if n != len(b):
        raise BadFile("the tile is cut off")
    at = 32 if magic == b"i3dm" else 28
    return json.loads(b[at:at + ft]), b[at + ft:at + ft + fb], b[at + ft + fb + bt + bb:]


def pnts(b: bytes):
    t, body, _ = tile(b, b"pnts")
    n = t["POINTS_LENGTH"]
    xyz = np.frombuffer(body, "<f4", 3 * n, t["POSITION"]["byteOffset"]).reshape(n, 3) + np.array(t["RTC_CENTER"])
    rgb = np.frombuffer(body, np.uint8, 3 * n, t["RGB"]["byteOffset"]).reshape(n, 3).astype(np.int32) if "RGB" in t else np.full((n, 3), 255, np.int32)
    yield pd.DataFrame({"seq": np.arange(n), "x": xyz[:, 0], "y": xyz[:, 1], "z": xyz[:, 2], "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})


def read_pnts(df: DataFrame, key: str, content: str) -> DataFrame:
    return decoded(df, key, content, pnts, "seq long, x double, y double, z double, r int, g int, b int")


def glb(b: bytes) -> tuple[dict, bytes]:
    """The scene and the binary chunk."""
    if b[:4] != b"glTF" or struct.unpack_from("<I", b, 8)[0] != len(b):
        raise BadFile("no whole glTF binary")
    n, = struct.unpack_from("<I", b, 12)
    return json.loads(b[20:20 + n]), b[28 + n:]


def accessor(scene: dict, body: bytes, i: int) -> np.ndarray:
    a = scene["accessors"][i]
    v = scene["bufferViews"][a["bufferView"]]
    kind, width = {5126: "<f4", 5125: "<u4", 5121: "u1"}[a["componentType"]], {"SCALAR": 1, "VEC3": 3, "VEC4": 4}[a["type"]]
    return np.frombuffer(body, kind, a["count"] * width, v["byteOffset"]).reshape(a["count"], width)
