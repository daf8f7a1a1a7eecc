"""Benchmark decontamination by winnowing.

Every text is cut into words, and of each sliding window of k-gram hashes only the
rightmost minimum is kept as a fingerprint. Two texts that share ``window`` words in a row
are certain to keep the same fingerprint inside them (k + span - 1 <= window), so joining
document fingerprints to benchmark fingerprints finds every shared window. A joined
fingerprint is extended to the benchmark windows around it, which are compared word by word.

Items shorter than ``window`` words are windows of their own length, each length with a
winnowing of its own that guarantees it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ALNUM, Words, discard, grams, pieces, stem, table, written

WINDOW = 10
#: Benchmark windows that one pass over the documents holds at most; more go in blocks.
BLOCK_WINDOWS = 400_000
SCHEMA = "doc_id long, n_words long, spans array<struct<start:long,end:long>>, item_ids array<long>"
SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def layer(n: int) -> tuple[int, int]:
    """(k, span): grams of k words, the least of every ``span`` in a row; k + span - 1 = n."""
    k = (n + 1) // 2
    return k, n - k + 1


def winnow(h: np.ndarray, ok: np.ndarray, span: int) -> np.ndarray:
    """Positions of the rightmost minimum of each ``span`` hashes in a row; ``ok[i]`` tells
    whether the window from i lies within one text."""
    n = len(ok)
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = h[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, span):
        x = h[j:n + j]
        less = x <= best
        best[less] = x[less]
        at[less] = j
    return np.unique((at + np.arange(n))[ok])


def _last(item) -> tuple:
    """The order of item ids, the missing one last."""
    return item is None, item or 0


class Index:
    """The windows of a block of benchmark items: for each window length the fingerprints
    that lead to them, the hashes of whole windows, and the items that hold each."""

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW):
        found: dict[int, dict[int, tuple[bytes, set]]] = {}
        prints: dict[int, set] = {}
        w = Words(pa.array([t for _, t in items], pa.large_string()), ALNUM)
        for i, (item, _) in enumerate(items):
            a, b = int(w.first[i]), int(w.first[i + 1])
            if a == b:
                continue
            n = min(window, b - a)
            k, span = layer(n)
            h = w.hash[a:b]
            g = grams(h, n)
            prints.setdefault(n, set()).update(grams(h, k)[winnow(grams(h, k), np.ones(len(g), bool), span)].tolist())
            own = found.setdefault(n, {})
            for j, x in enumerate(g.tolist()):
                own.setdefault(x, (w.words(a + j, a + j + n), set()))[1].add(item)
        self.layers = []
        for n, own in sorted(found.items()):
            keys = np.array(sorted(own), np.uint64)
            self.layers.append((n, np.array(sorted(prints[n]), np.uint64), keys, [own[x][0] for x in keys.tolist()], [sorted(own[x][1], key=_last) for x in keys.tolist()]))

    def match(self, w: Words) -> tuple[np.ndarray, list[set]]:
        """Which words of ``w`` lie in a benchmark window, and the items of each text."""
        total, docs = len(w.hash), w.doc()
        change, items = np.zeros(total + 1, np.int64), [set() for _ in range(len(w.first) - 1)]
        for n, prints, keys, texts, owners in self.layers:
            if total < n:
                continue
            k, span = layer(n)
            g = grams(w.hash, k)
            last = total - n + 1
            whole = docs[:last] == docs[n - 1:]
            kept = winnow(g, whole, span)
            hits = kept[_among(g[kept], prints) >= 0]
            if not len(hits):
                continue
            starts = np.unique((hits[:, None] - np.arange(span)[None, :]).ravel())
            starts = starts[(starts >= 0) & (starts < last)]
            starts = starts[whole[starts]]
            full = grams_at(w.hash, starts, n)
            at = _among(full, keys)
            for s, x in zip(starts[at >= 0].tolist(), at[at >= 0].tolist()):
                if w.words(s, s + n) == texts[x]:
                    change[s] += 1
                    change[s + n] -= 1
                    items[docs[s]].update(owners[x])
        return np.cumsum(change[:total]) > 0, items


def grams_at(h: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    from .common import mix

    c, out = np.uint64(0xD6E8FEB86659FD93), h[starts].copy()
    for j in range(1, k):
        out *= c
        out += h[starts + j]
    return mix(out + np.uint64(k))


def _among(x: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The place of each x in sorted keys, or -1."""
    at = np.minimum(np.searchsorted(keys, x), max(len(keys) - 1, 0))
    return np.where(keys[at] == x, at, -1) if len(keys) else np.full(len(x), -1)


def _scan(index, batches):
    idx = index.value
    for whole in batches:
        for batch in pieces(whole, "text"):
            w = Words(batch.column("text"), ALNUM)
            hit, items = idx.match(w)
            edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
            # runs end where a text ends
            docs, n = w.doc(), len(hit)
            cut = np.flatnonzero((docs[1:] != docs[:-1]) & hit[1:] & hit[:-1]) + 1 if n > 1 else np.zeros(0, np.int64)
            a = np.union1d(np.flatnonzero(edge == 1), cut)
            b = np.union1d(np.flatnonzero(edge == -1), cut)
            per = np.searchsorted(a, w.first)
            base = w.first[docs[a]] if len(a) else np.zeros(0, np.int64)
            spans = pa.StructArray.from_arrays([pa.array(a - base, pa.int64()), pa.array(b - base, pa.int64())], ["start", "end"])
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array(np.diff(w.first), pa.int64()),
                pa.ListArray.from_arrays(pa.array(per, pa.int32()), spans),
                pa.array([sorted(s, key=_last) for s in items], pa.list_(pa.int64())),
            ], ["doc_id", "n_words", "spans", "item_ids"])


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> list[list]:
    """For each block the hash buckets whose items it holds, and the written items; one block
    with no buckets if all windows fit it. A long item comes in runs of words that overlap by
    ``window`` - 1, so that no block depends on the longest item."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).distinct()
    run = max(block_windows // 16, 1)

    def cut(batches):
        for whole in batches:
            for b in pieces(whole, "text"):
                w, ids, texts, sizes = Words(b.column("text"), ALNUM), [], [], []
                for item, p, q in zip(b.column("item_id").to_pylist(), w.first[:-1].tolist(), w.first[1:].tolist()):
                    for at in range(p, max(q - window + 1, p + 1) if q > p else p, run):
                        to = min(q, at + run + window - 1)
                        ids.append(item)
                        texts.append(w.words(at, to).decode("utf-8", "replace"))
                        sizes.append(max(to - at - window + 1, 1))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array(sizes, pa.int64())], ["item_id", "text", "w"])

    runs = written(items.mapInArrow(cut, "item_id long, text string, w long"))
    total = runs.agg(F.sum("w")).first()[0] or 0
    if total <= block_windows:
        return [[runs]]
    many = 64 * -(-total // block_windows)
    runs = written(runs.withColumn("bucket", F.pmod(F.xxhash64("item_id", "text"), F.lit(many))))
    out, room = [], 0
    for r in runs.groupBy("bucket").agg(F.sum("w").alias("w")).orderBy("bucket").toLocalIterator():
        if not out or r["w"] > room:
            out.append([])
            room = block_windows
        out[-1].append(r["bucket"])
        room -= r["w"]
    return [[runs.where(F.col("bucket").isin(own))] for own in out]


def _indexes(benchmark: DataFrame, window: int, block_windows: int):
    """A broadcast Index of each block in turn."""
    for (runs,) in _blocks(benchmark, window, block_windows):
        yield benchmark.sparkSession.sparkContext.broadcast(Index([(r["item_id"], r["text"]) for r in runs.select("item_id", "text").toLocalIterator()], window))


def find_leaks(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """For each row of ``documents`` (doc_id, text): its words, the spans of words (start,
    end) that occur within a benchmark window, and the ids of the items they come from.

    Null or empty texts have no words, no spans; texts of any length are taken whole. An empty
    benchmark hits nothing; items without words hit nothing, items without an id hit as one
    item whose id is null. Rows without a doc_id get a result, repeated rows repeated results;
    item_ids are distinct. Columns other than doc_id, text and item_id, text are not looked at.
    An empty table gives no rows.

    Benchmark windows are broadcast in blocks of ``block_windows`` at most (about 200 bytes
    each). Up to one block it is a single pass; a larger benchmark takes a pass per block,
    whose results are joined on a row number that the documents got first.
    """
    spark = documents.sparkSession
    docs = stem(spark, documents)
    indexes = list(_indexes(benchmark, window, block_windows))
    if len(indexes) == 1:
        return _pass(docs, indexes[0])
    docs = written(docs.withColumn("row", F.monotonically_increasing_id()))
    out = None
    for index in indexes:
        part = _pass(docs.select(F.col("row").alias("doc_id"), "text"), index)
        out = part if out is None else out.unionAll(part)
    out = out.groupBy("doc_id").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("spans")).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids"))
    out = out.withColumn("spans", F.aggregate(F.array_sort("s"), F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), _merge))
    return docs.select("doc_id", "row").join(out.withColumnRenamed("doc_id", "row"), "row").select("doc_id", "n_words", "spans", "item_ids")


def _merge(acc, x):
    last = F.element_at(acc, -1)
    grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"))))
    return F.when(F.size(acc) == 0, F.array(x)).when(x["start"] > last["end"], F.concat(acc, F.array(x))).otherwise(grown)


def _pass(docs: DataFrame, index) -> DataFrame:
    return docs.select("doc_id", "text").mapInArrow(lambda batches: _scan(index, batches), SCHEMA)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    ids = F.array_join(F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("item_ids").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``documents`` without a benchmark window, all columns kept, in one pass
    without a shuffle. A benchmark of several blocks takes a pass a block, each over the written
    rows that the one before has left.

    Every row is judged by its own text, whatever its doc_id: rows without one and repeated
    rows too. Rows without words stay. An empty benchmark leaves all; an empty table gives no
    rows.
    """
    def without(index):
        def run(batches):
            for whole in batches:
                for b in pieces(whole, "text"):
                    w = Words(b.column("text"), ALNUM)
                    hit, _ = index.value.match(w)
                    n = np.concatenate([[0], np.cumsum(hit)])
                    yield b.filter(pa.array(n[w.first[1:]] == n[w.first[:-1]]))
        return run

    out, before = documents, None
    for k, index in enumerate(_indexes(benchmark, window, block_windows)):
        if k:
            out = written(out)
            if before is not None:
                discard(before)
            before = out
        out = out.mapInArrow(without(index), documents.schema)
    return out


OP1_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
        FROM (SELECT item_id, w, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dg AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
       FROM (SELECT doc_id, n, w, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lens WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dg.n, item_id FROM dg JOIN win ON dg.n = win.n AND dg.g = win.g),
hits AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM m) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
"""
