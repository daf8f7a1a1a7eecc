"""Points to LAS 1.2 files, a file a key."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def encode(pdf: pd.DataFrame, scale: float = 0.001) -> bytes:
    """Record format 2 with colours (r, g, b of 8 bits, stored in the high byte), 0 without.
    Offsets are the least position, so that any extent of 2^31 steps fits."""
    xyz = pdf[["x", "y", "z"]].to_numpy(float).reshape(-1, 3)
    low = np.floor(xyz.min(axis=0)) if len(xyz) else np.zeros(3)
    high = xyz.max(axis=0) if len(xyz) else np.zeros(3)
    least = xyz.min(axis=0) if len(xyz) else np.zeros(3)
    colour = "r" in pdf
    kind = np.dtype([("xyz", "<i4", 3), ("intensity", "<u2"), ("flags", "u1"), ("cls", "u1"), ("angle", "i1"), ("user", "u1"), ("source", "<u2")] + ([("rgb", "<u2", 3)] if colour else []))
    rec = np.zeros(len(xyz), kind)
    rec["xyz"] = np.round((xyz - low) / scale)
    if "intensity" in pdf:
        rec["intensity"] = pdf["intensity"]
    if "cls" in pdf:
        rec["cls"] = pdf["cls"].to_numpy() & 31
    if colour:
        rec["rgb"] = pdf[["r", "g", "b"]].to_numpy().astype(np.uint16) << 8
    h = bytearray(227)
    h[0:4], h[24], h[25] = b"LASF", 1, 2
    struct.pack_into("<HII", h, 94, 227, 227, 0)
    struct.pack_into("<BHI", h, 104, 2 if colour else 0, kind.itemsize, len(xyz))
    struct.pack_into("<12d", h, 131, *[scale] * 3, *low, *(v for hi, lo in zip(high, least) for v in (hi, lo)))
    return bytes(h) + rec.tobytes()


def write(df: DataFrame, key: str, order: str, scale: float = 0.001) -> DataFrame:
    """(key, content): the points of each key, by ``order``, as one file; a key is what fits a task."""
    kind = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)
    return df.groupBy(key).applyInPandas(lambda pdf: pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(pdf.sort_values(order), scale)]}), f"{key} {kind}, content binary")
