"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. The potential of a line's label is linear in features of the line
and of its two neighbours, that of two adjacent labels is a matrix of four weights. Training
takes each line of a labelled document to carry the document's label and climbs the
conditional likelihood with whole-sample gradient steps (Adam). A document's score is the
mean of its lines' forward-backward marginals of *good*, weighted by length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NONSPACE, Words, buffers, mix, pieces, stem, table

#: Bound on the labelled sample that the field is fitted on: documents, and lines in all.
SAMPLE_DOCS, SAMPLE_LINES = 4000, 300_000
THRESHOLD = 0.3
STEPS, RATE, RIDGE = 120, 0.08, 1e-4


def _classes() -> np.ndarray:
    """0 lower, 1 upper, 2 digit, 3 white space, 4 . and ,  5 ! and ?  6 quotes, brackets,
    dashes, colons  7 other ASCII marks and control bytes  8 beyond ASCII."""
    c = np.full(256, 7, np.uint8)
    c[128:] = 8
    for k, chars in ((0, b"abcdefghijklmnopqrstuvwxyz"), (1, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (2, b"0123456789"), (3, b" \t\r\n\x0b\x0c"), (4, b".,"), (5, b"!?"), (6, b"'\"()-:;")):
        c[list(chars)] = k
    return c


_CLASS = _classes()
N_CLASS = 9
N_OWN = N_CLASS + 12
#: Own features, those of the line before and after, and whether there is one.
N_FEATURES = 3 * N_OWN + 2


def lines_of(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line, its weight (bytes, 1 at least), and n+1 offsets of the texts'
    lines; a text without bytes is one empty line."""
    raw, off = buffers(col)
    n_docs = len(off) - 1
    nl = np.flatnonzero(raw == 10)
    of_nl = np.searchsorted(off, nl, "right") - 1
    doc = np.concatenate([np.arange(n_docs), of_nl])
    start = np.concatenate([off[:-1], nl + 1])
    order = np.lexsort((start, doc))
    doc, start = doc[order], start[order]
    n = len(start)
    first = np.searchsorted(doc, np.arange(n_docs + 1))
    end = np.empty(n, np.int64)
    end[:-1] = start[1:] - 1
    end[first[1:] - 1] = off[1:]
    size = end - start
    line_of_byte = np.repeat(np.arange(n), np.diff(np.append(start, off[-1])))
    counts = np.bincount(line_of_byte * N_CLASS + _CLASS[raw], minlength=n * N_CLASS).reshape(n, N_CLASS).astype(np.float64)
    f = np.zeros((n, N_OWN))
    bytes_ = np.maximum(size, 1)[:, None]
    f[:, :N_CLASS] = np.minimum(counts / bytes_, 1)
    letters = counts[:, 0] + counts[:, 1]
    f[:, 1] = counts[:, 1] / np.maximum(letters, 1)

    w = Words(col, NONSPACE)
    line = np.searchsorted(start, w.start, "right") - 1
    words = np.bincount(line, minlength=n).astype(np.float64)
    per = lambda x: np.bincount(line, x, minlength=n) / np.maximum(words, 1)
    length = w.end - w.start
    same = np.zeros(len(line))
    if len(line) > 1:
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (line[1:] == line[:-1])
    k = N_CLASS
    f[:, k] = per(same)
    f[:, k + 1] = np.minimum(per(length) / 12, 2)
    f[:, k + 2] = per(length > 14)
    f[:, k + 3] = per(length <= 3)
    last = raw[w.end - 1] if len(w.end) else np.zeros(0, np.uint8)
    f[:, k + 4] = per(_CLASS[last] == 7)
    f[:, k + 5] = per(_CLASS[last] == 5)
    f[:, k + 6] = np.log1p(words) / 6
    f[:, k + 7] = np.log1p(size) / 10
    some = size > 0
    at, to = start[some], end[some] - 1
    f[some, k + 8] = _CLASS[raw[at]] == 1
    f[some, k + 9] = raw[to] == 46
    # a line that its text has had before, and empty lines
    key = np.zeros(n, np.uint64)
    if len(line):
        np.add.at(key, line, mix(w.hash + np.arange(len(line), dtype=np.uint64) - np.searchsorted(line, line).astype(np.uint64)))
    full = np.flatnonzero(words > 0)
    seen = full[np.lexsort((full, key[full], doc[full]))]
    if len(seen) > 1:
        f[seen[1:], k + 10] = (key[seen[1:]] == key[seen[:-1]]) & (doc[seen[1:]] == doc[seen[:-1]])
    f[:, k + 11] = words == 0

    x = np.zeros((n, N_FEATURES))
    x[:, :N_OWN] = f
    has = np.ones(n, bool)
    has[first[:-1]] = False
    x[1:, N_OWN:2 * N_OWN] = f[:-1] * has[1:, None]
    x[:-1, 2 * N_OWN:3 * N_OWN] = f[1:] * has[1:, None]
    x[:, -2] = has
    x[:-1, -1] = has[1:]
    return x, np.maximum(size, 1).astype(np.float64), first


@dataclass
class Field:
    """``weights``: of the features and a constant, for *good* against *bad*; ``trans``:
    log potentials of adjacent labels."""

    weights: np.ndarray
    trans: np.ndarray

    def marginals(self, x: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """P(good) of each line, the expected label pairs summed over all lines, and log Z a
        text. Texts advance together, the longest first."""
        e = x @ self.weights[:-1] + self.weights[-1]
        n = np.diff(first)
        order = np.argsort(-n, kind="stable")
        start, n = first[:-1][order], n[order]
        t = np.exp(self.trans)
        a = np.empty((len(e), 2))
        scale = np.zeros(len(e))
        pot = np.stack([np.exp(-np.clip(e, -60, 60) / 2), np.exp(np.clip(e, -60, 60) / 2)], axis=1)
        steps = int(n[0]) if len(n) else 0
        alive = np.searchsorted(-n, -np.arange(steps), "left")
        for s in range(steps):
            at = start[:alive[s]] + s
            now = pot[at] if s == 0 else (a[at - 1] @ t) * pot[at]
            z = now.sum(axis=1)
            a[at], scale[at] = now / z[:, None], np.log(z)
        b = np.ones((len(e), 2))
        pairs = np.zeros((2, 2))
        for s in range(steps - 2, -1, -1):
            at = start[:alive[s + 1]] + s
            after = b[at + 1] * pot[at + 1]
            now = after @ t.T
            b[at] = now / now.sum(axis=1)[:, None]
            joint = a[at][:, :, None] * t[None] * after[:, None, :]
            pairs += (joint / joint.sum(axis=(1, 2))[:, None, None]).sum(axis=0)
        good = a * b
        return good[:, 1] / good.sum(axis=1), pairs, np.add.reduceat(scale, first[:-1]) if len(first) > 1 else np.zeros(0)

    def score(self, x: np.ndarray, weight: np.ndarray, first: np.ndarray) -> np.ndarray:
        good, _, _ = self.marginals(x, first)
        total = np.add.reduceat(weight, first[:-1])
        return np.clip(np.add.reduceat(good * weight, first[:-1]) / total, 0, 1)


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, steps: int = STEPS) -> Field:
    """``label``: 0 or 1 a text. Without texts of both labels the field says even odds, or
    leans to the one it has seen."""
    field = Field(np.zeros(N_FEATURES + 1), np.zeros((2, 2)))
    if not len(label) or label.min() == label.max():
        field.weights[-1] = 0.0 if not len(label) else 4.0 * label[0] - 2.0
        return field
    y = np.repeat(label, np.diff(first)).astype(np.float64)
    # texts weigh alike, whatever their number of lines
    n = np.diff(first).astype(np.float64)
    seen = np.array([[((n - 1) * (label == 0)).sum(), 0], [0, ((n - 1) * (label == 1)).sum()]])
    m, v = np.zeros(N_FEATURES + 5), np.zeros(N_FEATURES + 5)
    for step in range(1, steps + 1):
        good, pairs, _ = field.marginals(x, first)
        diff = y - good
        g = np.concatenate([x.T @ diff, [diff.sum()], (seen - pairs).ravel()]) / len(y)
        theta = np.concatenate([field.weights, field.trans.ravel()])
        g -= RIDGE * theta
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        theta = theta + RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
        field = Field(theta[:-4], theta[-4:].reshape(2, 2))
    return field


def fold(col: str = "doc_id", n: int = 5):
    """crc32 of the id as text, modulo n; a null id counts as text of no bytes."""
    return F.pmod(F.crc32(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def train(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_lines: int = SAMPLE_LINES) -> Field:
    """A field from at most ``sample_docs`` labelled documents outside the held-out fifth,
    taken by a hash of the id, and of these as many as have ``sample_lines`` lines together.
    Their features are computed by the tasks; the driver gets those alone.

    Labels other than 0 and 1, and those of unknown ids, teach nothing. Of two labels for one
    id the lower counts. Rows that repeat an id are each learned from. A document of more than
    ``sample_lines`` lines is not learned from. Further columns are not looked at; an empty
    table gives a field of even odds."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1)").where(fold() != 0)
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("h", F.shiftrightunsigned(F.xxhash64("doc_id"), 1))
    # the lowest hashes: a first cut by the share that is wanted, so that few rows are sorted
    n = known.count()
    few = known.where(F.col("h") < int(2 * sample_docs / n * 2**63)) if n > 4 * sample_docs else known
    ids = few.orderBy("h", "doc_id").limit(sample_docs).drop("h")
    docs = stem(documents.sparkSession, documents).withColumn("n", F.size(F.split(F.coalesce("text", F.lit("")), "\n"))).where(F.col("n") <= sample_lines)
    rows = docs.join(F.broadcast(ids), "doc_id")  # sample_docs rows at most

    def features(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                x, _, first = lines_of(b.column("text"))
                out = [x[p:q].astype(np.float32).tobytes() for p, q in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("quality"), pa.array(np.diff(first), pa.int64()), pa.array(out, pa.binary())], ["doc_id", "quality", "n", "x"])

    x, label, sizes, total = [], [], [], 0
    got = rows.select("doc_id", "quality", "text").mapInArrow(features, "doc_id long, quality int, n long, x binary")
    for r in sorted(got.collect(), key=lambda r: (r["doc_id"], r["n"])):
        if total + r["n"] <= sample_lines:
            total += r["n"]
            x.append(np.frombuffer(r["x"], np.float32).reshape(-1, N_FEATURES))
            label.append(r["quality"])
            sizes.append(r["n"])
    first = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    return fit(np.concatenate(x).astype(np.float64) if x else np.zeros((0, N_FEATURES)), first, np.array(label, np.int64))


SCHEMA = "doc_id long, score double"


def score(documents: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) for each row: a function of the text alone. Null and empty texts are
    one empty line, texts of any length are taken whole. Repeated rows get equal scores, further
    columns are not looked at; an empty table gives no rows."""
    held = documents.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held.value.score(*lines_of(b.column("text"))))], ["doc_id", "score"])

    return stem(documents.sparkSession, documents).mapInArrow(run, SCHEMA)


def op7_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", (fold() == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))


def accepted(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``documents`` that the field, trained on them, does not reject; all columns
    kept, in one pass without a shuffle.

    Every row is judged by its own text, whatever its doc_id: rows without one and repeated
    rows too. Null and empty texts are one empty line. Without usable labels nothing tells
    good from bad, scores are even and all rows stay. An empty table gives no rows.
    """
    held = documents.sparkSession.sparkContext.broadcast(train(documents, labels))

    def run(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                yield b.filter(pa.array(held.value.score(*lines_of(b.column("text"))) >= THRESHOLD))

    return documents.mapInArrow(run, documents.schema)
