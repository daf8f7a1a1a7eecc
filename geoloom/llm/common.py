"""Helpers that the operators of this subpackage share: tables, durable intermediate
results, and vectorised work on Arrow text buffers."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, the folder that the driver and all
    executors see. Only a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="geoloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/geoloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def written(df: DataFrame, **options) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: it cuts lineage, survives lost
    executors, and fixes what a sampling or range shuffle has dealt out. ``discard`` deletes it."""
    path = shared_dir(df.sparkSession)
    df.write.options(compression="zstd", **options).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folder = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes written tables whose last reader is done."""
    for df in tables:
        if path := getattr(df, "_folder", None):
            jvm, jsc = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(jsc.hadoopConfiguration()).delete(where, True)


#: Rows of a few bytes that ``lookup`` sends to every executor at most: some 35 MB there.
LOOKUP = 500_000


def lookup(large: DataFrame, small: DataFrame, on: list[str], how: str) -> DataFrame:
    """``large`` joined with ``small``, a table of ids. Its rows are counted: up to LOOKUP of
    them are broadcast, so that the large side stays where it lies; more are joined by a shuffle."""
    return large.join(small.hint("broadcast" if small.count() <= LOOKUP else "merge"), on, how)


def stem(spark: SparkSession, documents: DataFrame, *extra: str) -> DataFrame:
    """``doc_id`` and ``text`` alone, so that no further column of the input can clash."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *extra)


# ---------------------------------------------------------------- text as bytes

def lower_table() -> np.ndarray:
    """A byte map that lower-cases A-Z and leaves every other byte as it is."""
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


LOWER = lower_table()
_b = np.arange(256)
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` after lower-casing, on UTF-8.
ALNUM = ((_b >= 48) & (_b <= 57)) | ((_b >= 97) & (_b <= 122)) | (_b >= 128)
#: Bytes of ``[^\x20\x09-\x0D]``.
NONSPACE = ~((_b == 32) | ((_b >= 9) & (_b <= 13)))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n+1 offsets; a null has no bytes."""
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    if col.null_count:
        col = col.fill_null("")
    n, bufs = len(col), col.buffers()
    if not n:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(bufs[1], np.int64)[col.offset:col.offset + n + 1]
    data = np.frombuffer(bufs[2], np.uint8)[off[0]:off[-1]] if bufs[2] is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


def pieces(batch: pa.RecordBatch, col: str, most: int = 2 << 20):
    """Slices of a batch of at most about ``most`` bytes of text, at least a row each."""
    i = batch.schema.get_field_index(col)
    _, off = buffers(batch.column(i))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(off, off[at] + most, "right")) - 1)
        yield batch.slice(at, min(to, batch.num_rows) - at)
        at = to


_POW = [np.ones(1, _U64), np.ones(1, _U64)]
_M = 0x9E3779B97F4A7C15 | 1
_MI = pow(_M, -1, 1 << 64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW[0]) < n:
        size = max(n, 1 << 16)
        for k, base in ((0, _M), (1, _MI)):
            p = np.full(size, base, _U64)
            p[0] = 1
            _POW[k] = np.multiply.accumulate(p)
    return _POW[0], _POW[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer."""
    x = x ^ (x >> _U64(33))
    x = x * _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x = x * _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


class Words:
    """The words of a batch of texts: where each starts and ends in the lower-cased bytes,
    its 64-bit hash, and ``first``: n+1 positions at which the texts' words begin."""

    def __init__(self, col: pa.Array, is_word: np.ndarray):
        raw, off = buffers(col)
        self.data = LOWER[raw]
        inside = is_word[self.data]
        n = len(inside)
        edge = np.zeros(n + 1, bool)
        edge[off] = True
        prev = np.zeros(n, bool)
        prev[1:] = inside[:-1]
        self.start = np.flatnonzero(inside & (~prev | edge[:n]))
        after = np.zeros(n, bool)
        after[:-1] = inside[1:]
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, off).astype(np.int64)
        self.hash = self._hashes()

    def _hashes(self, block: int = 1 << 18) -> np.ndarray:
        """Blocks of whole words keep the prefix sums in cache."""
        out = np.empty(len(self.start), _U64)
        at = 0
        while at < len(out):
            lo = int(self.start[at])
            to = max(at + 1, int(np.searchsorted(self.end, lo + block, "right")))
            hi = int(self.end[to - 1])
            p, inv = _powers(hi - lo + 1)
            total = np.zeros(hi - lo + 1, _U64)
            np.cumsum((self.data[lo:hi].astype(_U64) + _U64(1)) * p[:hi - lo], out=total[1:])
            s = self.start[at:to] - lo
            out[at:to] = (total[self.end[at:to] - lo] - total[s]) * inv[s]
            at = to
        return mix(out)

    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def words(self, a: int, b: int) -> bytes:
        d, s, e = self.data, self.start, self.end
        return b" ".join(d[s[i]:e[i]].tobytes() for i in range(a, b))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive word hashes, for every start with k words left (texts not
    told apart)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, _U64)
    c, out = _U64(0xD6E8FEB86659FD93), h[:n].copy()
    for j in range(1, k):
        out *= c
        out += h[j:n + j]
    return mix(out + _U64(k))
