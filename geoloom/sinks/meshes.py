"""Points to PLY, PCD and OBJ texts and bytes, a file a key."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ply(pdf: pd.DataFrame) -> bytes:
    """Binary little-endian, with colours where there are r, g, b."""
    colour = "r" in pdf
    kind = np.dtype([(a, "<f4") for a in "xyz"] + ([(c, "u1") for c in "rgb"] if colour else []))
    rec = np.zeros(len(pdf), kind)
    for name in kind.names:
        rec[name] = pdf[name]
    head = f"ply\nformat binary_little_endian 1.0\nelement vertex {len(pdf)}\n" + "".join(f"property float {a}\n" for a in "xyz") + ("property uchar red\nproperty uchar green\nproperty uchar blue\n" if colour else "") + "element face 0\nproperty list uchar int vertex_indices\nend_header\n"
    return head.encode() + rec.tobytes()


def _pcd_head(colour: bool, n, binary: bool) -> str:
    names = ["x", "y", "z", *(["rgb"] if colour else [])]
    return f"# .PCD v0.7\nVERSION 0.7\nFIELDS {' '.join(names)}\nSIZE{' 4' * len(names)}\nTYPE{' F' * len(names)}\nCOUNT{' 1' * len(names)}\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA {'binary' if binary else 'ascii'}\n"


def _pcd_body(pdf: pd.DataFrame, binary: bool) -> bytes:
    colour = "r" in pdf
    kind = np.dtype([(a, "<f4") for a in "xyz"] + ([("rgb", "<f4")] if colour else []))
    rec = np.zeros(len(pdf), kind)
    for a in "xyz":
        rec[a] = pdf[a]
    if colour:
        c = pdf[["r", "g", "b"]].to_numpy().astype(np.uint32)
        rec["rgb"] = ((c[:, 0] << 16) | (c[:, 1] << 8) | c[:, 2]).astype("<u4").view("<f4")
    return rec.tobytes() if binary else "".join([" ".join(map(repr, row)) + "\n" for row in rec.tolist()]).encode()


def pcd(pdf: pd.DataFrame, binary: bool = True) -> bytes:
    return _pcd_head("r" in pdf, len(pdf), binary).encode() + _pcd_body(pdf, binary)


def pcd_parts(df: DataFrame, key: str, order: str, binary: bool = True) -> DataFrame:
    """(key, part, content): ``pcd`` of each key's rows, by ``order``, in parts that one after the
    other are the file: first the header, then a batch of points each."""
    colour = "r" in df.columns
    count = F.count(F.lit(1)).cast("string")
    words = _pcd_head(colour, "\0", binary).split("\0")
    head = F.concat(F.lit(words[0]), count, F.lit(words[1]), count, F.lit(words[2])).cast("binary")
    own = [F.col(c) for c in ("x", "y", "z", *("rgb" if colour else ""))]
    return df.groupBy(key).agg(head.alias("content")).select(key, F.lit(-1).cast("long").alias("part"), "content").unionByName(parted(df, key, order, own, lambda b: _pcd_body(b.to_pandas(), binary), "content"))


def write(df: DataFrame, key: str, order: str, encode) -> DataFrame:
    """(key, content): the rows of each key, by ``order``, through ``encode``; a key is what fits a task."""
    kind = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)
    return df.groupBy(key).applyInPandas(lambda pdf: pd.DataFrame({key: [pdf[key].iloc[0]], "content": [encode(pdf.sort_values(order))]}), f"{key} {kind}, content binary")


def parted(df: DataFrame, key: str, order: str, columns: list[Column], encode, content: str) -> DataFrame:
    """(key, part, <content>): the rows of each key, by ``order``, a part a batch at most, through
    ``encode`` of an Arrow batch of ``columns``. Rows are dealt out by range, so a file of any
    size is written by many tasks; its parts, in order, are the file."""
    kind = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0)
            own = keys.to_pylist()
            starts = [i for i, k in enumerate(own) if not i or k != own[i - 1]]
            out = [encode(batch.slice(i, j - i)) for i, j in zip(starts, [*starts[1:], len(own)])]
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(starts, pa.int64())), pa.array(range(part, part + len(out)), pa.int64()), pa.array(out, pa.string() if content == "text" else pa.binary())], [key, "part", content])
            part += len(out)

    dealt = df.repartitionByRange(key, order).sortWithinPartitions(key, order).select(key, *columns)
    return dealt.mapInArrow(run, f"{key} {kind}, part long, {content} {'string' if content == 'text' else 'binary'}")


def obj(df: DataFrame, key: str, order: str, normals: bool = False) -> DataFrame:
    """(key, part, text): ``v`` lines, and ``vn`` lines of nx, ny, nz after those of the same
    part. A file's parts follow each other, with a line's end between two."""
    line = lambda head, *cols: F.concat_ws(" ", F.lit(head), *(F.col(c).cast("string") for c in cols))
    own = [line("v", "x", "y", "z").alias("v"), *([line("vn", "nx", "ny", "nz").alias("vn")] if normals else [])]
    return parted(df, key, order, own, lambda b: "\n".join(t for c in b.columns[1:] for t in c.to_pylist()), "text")


def vertex_buffer(colour: list[Column] | None = None, normal: list[Column] | None = None) -> Column:
    """Ten floats a vertex: position, normal (0, 0, 1 without one), and RGBA in 0..1 (white without)."""
    n = normal or [F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    c = [*(v / 255.0 for v in colour), F.lit(1.0)] if colour else [F.lit(1.0)] * 4
    return F.array(*(v.cast("float") for v in (F.col("x"), F.col("y"), F.col("z"), *n, *c)))


def indexed(df: DataFrame, key: str) -> DataFrame:
    """(key, indices): 0 to n - 1 for the n points of a key."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).select(key, F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("indices"))
