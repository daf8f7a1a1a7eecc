"""Elevation grids to TIFF files of single floats, a file a key."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def encode(grid: np.ndarray, bounds: tuple | None = None, tile: int | None = None, deflate: bool = True, order: str = "<", rows: int = 16) -> bytes:
    """``grid``: (height, width). Strips of ``rows``, or square tiles; WGS84 keys with bounds."""
    h, w = grid.shape
    bh, bw = (tile, tile) if tile else (rows, w)
    blocks = []
    for top in range(0, h, bh):
        for left in range(0, w, bw):
            g = grid[top:top + bh, left:left + bw].astype(order + "f4")
            if tile:
                g = np.pad(g, ((0, bh - g.shape[0]), (0, bw - g.shape[1]))).astype(order + "f4")
            blocks.append(zlib.compress(g.tobytes()) if deflate else g.tobytes())
    at = 8
    offsets = []
    for b in blocks:
        offsets.append(at)
        at += len(b)
    at += at % 2
    tags = [(256, "I", [w]), (257, "I", [h]), (258, "H", [32]), (259, "H", [8 if deflate else 1]), (262, "H", [1]), (277, "H", [1]), (339, "H", [3])]
    tags += [(322, "I", [bw]), (323, "I", [bh]), (324, "I", offsets), (325, "I", [len(b) for b in blocks])] if tile else [(273, "I", offsets), (278, "I", [bh]), (279, "I", [len(b) for b in blocks])]
    if bounds:
        x0, y0, x1, y1 = bounds
        tags += [(33550, "d", [(x1 - x0) / w, (y1 - y0) / h, 0.0]), (33922, "d", [0.0, 0.0, 0.0, x0, y1, 0.0]), (34735, "H", [1, 1, 0, 2, 1024, 0, 1, 2, 2048, 0, 1, 4326])]
    tags.sort()
    kinds, tail, extra = {"H": 3, "I": 4, "d": 12}, at + 2 + 12 * len(tags) + 4, b""
    head = struct.pack(order + "H", len(tags))
    for tag, code, values in tags:
        body = struct.pack(f"{order}{len(values)}{code}", *values)
        if len(body) > 4:
            place = struct.pack(order + "I", tail + len(extra))
            extra += body
        else:
            place = body.ljust(4, b"\0")
        head += struct.pack(order + "HHI", tag, kinds[code], len(values)) + place
    data = b"".join(blocks)
    data += b"\0" * (at - 8 - len(data))
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, at) + data + head + struct.pack(order + "I", 0) + extra


def write(df: DataFrame, key: str, **how) -> DataFrame:
    """(key, content): the full grid (row, col, z) of each key as one file."""
    kind = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        r, c = pdf["row"].to_numpy() - pdf["row"].min(), pdf["col"].to_numpy() - pdf["col"].min()
        g = np.full((r.max() + 1, c.max() + 1), np.nan, np.float32)
        g[r, c] = pdf["z"]
        return pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(g, **how)]})

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, content binary")
