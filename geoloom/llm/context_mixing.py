"""Language-model scores by online logistic context mixing.

A text is its lower-cased tokens joined by single spaces and closed by an end byte; bytes
are predicted bit by bit along the Huffman code that training bytes have behind the byte
before. Hashed contexts (orders 2, 3 and 5, and the begun word) each look up a log-odds
prediction; a mixer adds these up with the weights and bias of the set that a gate opens, by
how well the begun word and the longest order are known. Weights and biases start equal for
every text and are refined online within it, block by block, so a text's score depends on
the corpus counts and itself alone. Total bits, and bits a byte, follow.

The counts behind the predictions come from all training texts. Each context's table has at
least a slot for each (context, node) pair that these show, as told by a sample of the
contexts, so it grows with the corpus. Each task counts the zeros and ones of its own slots,
shards of these are added up in a tree of bounded groups, and the log-odds (a byte a slot)
go into one file in the shared folder, which the workers map. Only where that folder is in a
store without such files do they pass through the driver.
"""

from __future__ import annotations

import heapq
import math
import os
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import pieces, shared_dir, table, written
from .line_quality import fold

END = 255  # no byte of UTF-8
PAD = 16
#: The least slots of each context's table, as a power of two.
SLOTS = (18, 20, 22, 22)
N_CTX = len(SLOTS)


def bases(sizes) -> np.ndarray:
    """Where each table begins, and the slots of all."""
    return np.concatenate([[0], np.cumsum([1 << s for s in sizes])]).astype(np.int64)


BASES = bases(SLOTS)
#: One of so many contexts is looked at to size the tables.
SAMPLE = 256
SHARD = 1 << 16
#: (Context, byte) pairs that a task holds before it turns them into shards, and the bytes of
#: shards before it hands them on.
PAIRS = 1 << 20
#: Pairs that are taken apart into bits at a time.
RUN = 1 << 17
HELD = 32 << 20
FAN = 32
#: Tokens whose counts go to every worker; the others are looked up by a join.
COMMON = 200_000
#: Tables up to this power of two are counted in place by each task; larger ones by sorting.
DENSE = 21
#: Bits of a text after which weights are first learned; blocks grow fourfold up to the second.
BLOCKS = (128, 8192)
#: Limits of how well the begun word and the longest order are known, as log-odds; each side
#: has three levels (between two steps of the odds), so a gate opens one of nine sets of weights.
LEVELS = (1.04, 3.04)
N_GATE = 9
#: Weights of the contexts, and a bias, at the start: a row a gate, the word's level first. They
#: were found on training texts that were left out of the counts for it.
START = ((0.08, 0.23, 0.59, 0.12, 0.0), (0.05, 0.35, 0.62, 0.0, -0.05), (0.01, 0.37, 0.63, 0.05, 0.06), (0.02, 0.26, 0.52, 0.31, -0.09), (0.05, 0.19, 0.6, 0.2, 0.0),
         (0.07, 0.38, 0.74, -0.08, -0.08), (0.07, 0.33, 0.57, 0.4, -0.25), (-0.05, 0.25, 0.57, 0.42, -0.21), (0.08, 0.26, 0.57, 0.28, -0.07))
RATE = 4.0
DELTA = 0.3
#: Log-odds are kept in steps of 1 / STEPS, in a byte.
STEPS = 12


def normal(text: str | None) -> bytes:
    return b" ".join((text or "").encode("utf-8", "replace").lower().split())


# ---------------------------------------------------------------- binary code of bytes

@dataclass
class Code:
    """A prefix code for each byte that may stand before: ``at[p, s]`` and ``len[p, s]`` (flat)
    give the run of byte s behind byte p in ``node`` and ``bit``."""

    at: np.ndarray
    len: np.ndarray
    node: np.ndarray
    bit: np.ndarray


def huffman(counts: np.ndarray) -> Code:
    """``counts``: of bytes (columns) behind bytes (rows). A byte's share in all rows together
    is added to each row, so that every byte has a path everywhere."""
    counts = np.asarray(counts, np.float64).reshape(256, 256)
    every = counts.sum(axis=0) + 1
    lens, flat = [], []
    for row in counts + every / every.sum():
        paths = _paths(row)
        lens += [len(p) for p in paths]
        flat += [step for p in paths for step in p]
    lens = np.array(lens, np.int64)
    return Code(np.cumsum(lens) - lens, lens, np.array([a for a, _ in flat], np.uint32), np.array([b for _, b in flat], np.uint8))


def _paths(weights: np.ndarray) -> list[list[tuple[int, int]]]:
    """(node, bit) from the root to each symbol of a Huffman tree."""
    heap = [(float(c), s, s) for s, c in enumerate(weights)]
    heapq.heapify(heap)
    tree, n = [], len(weights)
    while len(heap) > 1:
        (ca, _, a), (cb, _, b) = heapq.heappop(heap), heapq.heappop(heap)
        tree.append((a, b))
        heapq.heappush(heap, (ca + cb, n + len(tree), n + len(tree) - 1))
    paths, todo = [[]] * n, [(n + len(tree) - 1, [])]
    while todo:
        x, path = todo.pop()
        if x < n:
            paths[x] = path
        else:
            for bit, y in enumerate(tree[x - n]):
                todo.append((y, path + [(x - n, bit)]))
    return paths


# ---------------------------------------------------------------- contexts

def stream(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts with PAD spaces before and END behind each; the places to predict, and how
    many of these each text has."""
    pad, end = b" " * PAD, bytes([END])
    data = np.frombuffer(b"".join(x for t in texts for x in (pad, t, end)), np.uint8)
    n = np.array([len(t) + 1 for t in texts], np.int64)
    start = np.cumsum(n + PAD) - n
    places = np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())
    return data, places, n


def contexts(data: np.ndarray, places: np.ndarray) -> list[np.ndarray]:
    """A 32-bit hash of each context at each place."""
    m = np.uint32(0x2C1B3C6D)
    x = data.astype(np.uint32)
    out, h = [], np.zeros(len(x), np.uint32)
    for j in range(1, 6):
        h[j:] += x[:-j]
        h += np.uint32(j)
        h *= m
        h ^= h >> np.uint32(15)
        if j in (2, 3, 5):
            out.append(h[places])
    # the begun word, from a sum of its bytes times powers of a place: exact for any length
    power = _powers32(len(x))
    total = np.zeros(len(x) + 1, np.uint32)
    np.cumsum((x + np.uint32(7)) * power[0][:len(x)], dtype=np.uint32, out=total[1:])
    space = np.where(data == 32, np.arange(1, len(x) + 1), 0)
    begin = np.zeros(len(x) + 1, np.int64)
    np.maximum.accumulate(space, out=begin[1:])
    at = begin[places]
    w = (total[places] - total[at]) * power[1][at]
    w ^= w >> np.uint32(16)
    w *= np.uint32(0x7FEB352D)
    w ^= w >> np.uint32(15)
    out.append(w)
    return out


_P32: list = []


def _powers32(n: int):
    if not _P32 or len(_P32[0]) < n + 1:
        size, base = max(n + 1, 1 << 18), 0x9E3779B1
        both = []
        for b in (base, pow(base, -1, 1 << 32)):
            p = np.full(size, b, np.uint32)
            p[0] = 1
            both.append(np.multiply.accumulate(p, dtype=np.uint32))
        _P32[:] = both
    return _P32


def behind(data: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The byte at each place, with the one before it above: what ``bits_of`` takes."""
    return data[places - 1].astype(np.int64) << 8 | data[places]


def bits_of(code: Code, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bits a symbol, and the node and value of each bit."""
    n = code.len[symbols]
    total = np.cumsum(n)
    at = np.repeat(code.at[symbols] - (total - n), n) + np.arange(total[-1] if len(n) else 0)
    return n, code.node[at], code.bit[at]


def slots(size: int, ctx: np.ndarray, n: np.ndarray, node: np.ndarray) -> np.ndarray:
    """The slot of each bit in a table of 2 ** size slots. Sixteen nodes of a context lie next
    to each other, in an order of the context's own, so that a path touches few cache lines."""
    h = np.repeat(ctx, n)
    h += node >> np.uint32(4)
    h *= np.uint32(0xC2B2AE35)
    h >>= np.uint32(32 - size)
    h ^= node & np.uint32(15)
    return h


# ---------------------------------------------------------------- training

def token_counts(docs: DataFrame) -> DataFrame:
    """(token, c) of all texts: words, the end (an empty token), and the bytes of the stream by
    the byte before them (token FF, that byte, and the byte; no word has a byte FF)."""

    def count(batches):
        from collections import Counter

        words, bytes_, ends = Counter(), np.zeros(1 << 16, np.int64), 0

        def flush():
            keys = list(words)
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([words[k] for k in keys], pa.int64())], ["token", "c"])

        for whole in batches:
            for b in pieces(whole, "text", 1 << 19):
                raw = [normal(t) for t in b.column("text").to_pylist()]
                ends += len(raw)
                for r in raw:
                    words.update(r.split(b" ") if r else ())
                data, places, _ = stream(raw)
                bytes_ += np.bincount(behind(data, places), minlength=1 << 16)
                if len(words) > 200_000:
                    yield flush()
                    words.clear()
        if words:
            yield flush()
        there = np.flatnonzero(bytes_).tolist()
        yield pa.RecordBatch.from_arrays([pa.array([b"", *(bytes([END, k >> 8, k & 255]) for k in there)], pa.binary()), pa.array([ends, *bytes_[there].tolist()], pa.int64())], ["token", "c"])

    return docs.mapInArrow(count, "token binary, c long").where("c > 0").groupBy("token").agg(F.sum("c").alias("c"))


def sizes_of(docs: DataFrame, code) -> tuple:
    """The power of two that holds each context's (context, node) pairs, SLOTS at least and
    the 32 bits of a context's hash at most. ``code``: a broadcast Code."""

    def sample(batches):
        held, n_held = [[] for _ in SLOTS], 0

        def flush():
            for i, parts in enumerate(held):
                pair = np.unique(np.concatenate([np.zeros(0, np.uint64), *parts]))
                parts.clear()
                n, node, _ = bits_of(code.value, (pair & np.uint64(0xFFFF)).astype(np.int64))
                key = np.unique(np.repeat(pair >> np.uint64(16), n) << np.uint64(8) | node)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), i, np.int32)), pa.array(key.astype(np.int64))], ["context", "key"])

        for whole in batches:
            for b in pieces(whole, "text", 1 << 18):
                data, places, _ = stream([normal(t) for t in b.column("text").to_pylist()])
                symbol = behind(data, places).astype(np.uint64)
                for parts, ctx in zip(held, contexts(data, places)):
                    few = np.flatnonzero(ctx % np.uint32(SAMPLE) == 0)
                    parts.append(np.unique(ctx[few].astype(np.uint64) << np.uint64(16) | symbol[few]))
                    n_held += len(parts[-1])
                if n_held > PAIRS // 4:
                    yield from flush()
                    n_held = 0
        yield from flush()

    found = dict(docs.mapInArrow(sample, "context int, key long").distinct().groupBy("context").count().collect())
    return tuple(max(least, min(32, (SAMPLE * found.get(i, 0) - 1).bit_length())) for i, least in enumerate(SLOTS))


def packed(keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Keys below 2^33 with times below 2^31 in the low bits."""
    both = keys.astype(np.uint64)
    both <<= np.uint64(31)
    both |= times.astype(np.uint64)
    return both


def unpacked(both: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and their times added up; ``both`` is used up."""
    both.sort()
    times = (both & np.uint64((1 << 31) - 1)).view(np.int64)
    both >>= np.uint64(31)
    return _runs(both.view(np.int64), times)


def _runs(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(times, first) if len(keys) else times


def summed(keys: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys in order, each once, and their times, which may be of any size, added up."""
    order = np.argsort(keys, kind="stable")
    return _runs(keys[order], times[order])


def pairs_of(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context its (context, byte before, byte) triples in the texts, each once, and
    their times."""
    data, places, _ = stream(texts)
    symbol, out = behind(data, places).astype(np.uint64), []
    for ctx in contexts(data, places):
        pair = ctx.astype(np.uint64) << np.uint64(16) | symbol
        pair.sort()
        first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
        out.append((pair[first], np.diff(np.append(first, len(pair)))))
    return out


def in_slots(code: Code, size: int, pair: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs taken apart into bits: twice the slot, and one more for a one; times."""
    n, node, bit = bits_of(code, (pair & np.uint64(0xFFFF)).astype(np.int64))
    s = slots(size, (pair >> np.uint64(16)).astype(np.uint32), n, node).astype(np.int64)
    s *= 2
    s += bit
    return s, np.repeat(times, n)


def count_slots(code: Code, texts: list[bytes], table: np.ndarray, sizes=SLOTS) -> None:
    """Adds the zeros (row 0) and ones (row 1) that the texts show to the table's slots."""
    for size, base, (pair, times) in zip(sizes, bases(sizes), pairs_of(texts)):
        key, times = in_slots(code, size, pair, times)
        np.add.at(table, (key & 1, base + (key >> 1)), times.astype(table.dtype))


def _counted(code, sizes, batches):
    """Zeros and ones of the slots that this task's texts show, in compressed shards."""
    from pyspark import TaskContext

    task, start = TaskContext.get().partitionId(), bases(sizes)

    def put(held, shards):
        """Pairs go to the shards; the bytes these get."""
        size_ = 0
        for size, base, parts in zip(sizes, start, held):
            if not parts:
                continue
            pair, times = map(np.concatenate, zip(*parts))
            parts.clear()
            key, times = unpacked(np.concatenate([packed(*in_slots(code, size, pair[k:k + RUN], times[k:k + RUN])) for k in range(0, len(pair), RUN)]))
            first = int(2 * base) // (2 * SHARD)
            edge = np.searchsorted(key, np.arange(0, (2 << size) + 1, 2 * SHARD)).tolist()
            for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                if a < b:
                    blob = _zip(key[a:b] - 2 * SHARD * k, times[a:b])
                    shards.setdefault(first + k, []).append(blob)
                    size_ += len(blob)
        return size_

    def rows(shards):
        for k, blobs in shards.items():
            if len(blobs) > 1:
                blobs = [_zip(*summed(*map(np.concatenate, zip(*map(_unzip, blobs)))))]
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([task], pa.int32()), pa.array(blobs, pa.binary())], ["shard", "part", "counts"])

    dense = {i: np.zeros(2 << size, np.int64) for i, size in enumerate(sizes) if size <= DENSE}
    held, shards, n_bytes, some = [[] for _ in sizes], {}, 0, False
    for whole in batches:
        for b in pieces(whole, "text", 1 << 19):
            some, texts = True, [normal(t) for t in b.column("text").to_pylist()]
            for i, (pair, times) in enumerate(pairs_of(texts)):
                if i in dense:
                    for k in range(0, len(pair), RUN):
                        np.add.at(dense[i], *in_slots(code, sizes[i], pair[k:k + RUN], times[k:k + RUN]))
                else:
                    held[i].append((pair, times))
            if sum(len(p) for parts in held for p, _ in parts) > PAIRS:
                n_bytes += put(held, shards)
                if n_bytes > HELD:
                    yield from rows(shards)
                    shards, n_bytes = {}, 0
    if any(held):
        put(held, shards)
    yield from rows(shards)
    if some:
        for i, total in dense.items():
            for k in range(0, len(total), 2 * SHARD):
                key = np.flatnonzero(total[k:k + 2 * SHARD])
                if len(key):
                    yield from rows({int(2 * start[i] + k) // (2 * SHARD): [_zip(key, total[k + key])]})


def _zip(key: np.ndarray, times: np.ndarray) -> bytes:
    """Ascending keys, as steps, and their times, whole numbers of any size up to 63 bits."""
    wide = 8 if len(times) and times.max() >= 1 << 31 else 4
    both = np.concatenate([np.diff(key, prepend=0), times]).astype(f"<i{wide}")
    planes = np.ascontiguousarray(both.view(np.uint8).reshape(-1, wide).T)
    return len(key).to_bytes(4, "little") + bytes([wide]) + pa.Codec("zstd", 1).compress(planes.tobytes(), asbytes=True)


def _unzip(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, wide = int.from_bytes(blob[:4], "little"), blob[4]
    planes = np.frombuffer(pa.Codec("zstd").decompress(blob[5:], 2 * wide * n, asbytes=True), np.uint8).reshape(wide, -1)
    both = np.ascontiguousarray(planes.T).view(f"<i{wide}").reshape(2, n).astype(np.int64)
    return np.cumsum(both[0]), both[1]


def _total(blobs) -> np.ndarray:
    """Zeros and ones, in turn, of a shard's slots."""
    total = np.zeros(2 * SHARD, np.int64)
    for b in blobs:
        key, times = _unzip(b)
        total[key] += times
    return total


def _added(pdf: pd.DataFrame) -> pd.DataFrame:
    total = _total(pdf["counts"])
    key = np.flatnonzero(total)
    return pd.DataFrame({"shard": [pdf["shard"].iloc[0]], "part": [int(pdf["part"].iloc[0]) // FAN], "counts": [_zip(key, total[key])]})


def odds_of(counts: np.ndarray) -> np.ndarray:
    """Log-odds of slots (zeros in row 0, ones in row 1) in steps; 0 for a slot without counts."""
    return np.clip(np.rint(np.log((counts[1] + DELTA) / (counts[0] + DELTA)) * STEPS), -127, 127).astype(np.int8)


def _odds(path: str | None, pdf: pd.DataFrame) -> pd.DataFrame:
    """A shard's log-odds, from all of its counts. They go to their place in the file, where
    there is one (a task that runs again writes the same), else into the row."""
    shard, odds = int(pdf["shard"].iloc[0]), odds_of(_total(pdf["counts"]).reshape(SHARD, 2).T).tobytes()
    if path:
        with open(path, "r+b") as f:
            f.seek(SHARD * shard)
            f.write(odds)
    return pd.DataFrame({"shard": [shard], "odds": [None if path else odds]})


@dataclass
class Model:
    code: Code
    odds: np.ndarray | str  # int8 steps, all tables in a row, or the file of these
    sizes: tuple = SLOTS


def train(docs: DataFrame, byte_counts: np.ndarray) -> Model:
    """The model of all texts in ``docs``. Shards are added up FAN at a time, so no group
    holds more than FAN tasks' blobs however many tasks have counted."""
    spark = docs.sparkSession
    code = huffman(byte_counts)
    held = spark.sparkContext.broadcast(code)
    sizes = sizes_of(docs, held)
    shards = written(docs.mapInArrow(lambda it: _counted(held.value, sizes, it), "shard int, part int, counts binary"))
    parts = (shards.agg(F.max("part")).first()[0] or 0) + 1
    while parts > FAN:
        grouped = shards.withColumn("g", F.floor(F.col("part") / FAN).cast("int")).groupBy("shard", "g")
        shards, parts = written(grouped.applyInPandas(_added, "shard int, part int, counts binary")), -(-parts // FAN)
    # one step from the counts to the file: with three, each task had as many Python workers
    done = lambda file: shards.groupBy("shard").applyInPandas(lambda pdf: _odds(file, pdf), "shard int, odds binary")
    n, path = int(bases(sizes)[-1]), shared_dir(spark).removeprefix("file:")
    if "://" in path:  # no folder that can be mapped: the driver hands the tables out
        odds = np.zeros(n, np.int8)
        for r in done(None).toLocalIterator():
            odds[r["shard"] * SHARD:(r["shard"] + 1) * SHARD] = np.frombuffer(r["odds"], np.int8)
        return Model(code, odds, sizes)
    os.makedirs(path)
    path += "/odds"
    with open(path, "wb") as f:
        f.truncate(n)  # slots that nothing has shown stay zero
    done(path).agg(F.count("shard")).collect()
    return Model(code, path, sizes)


# ---------------------------------------------------------------- scoring

#: What a byte of steps (read as unsigned) adds to the gate, by context.
_known = abs(np.arange(256, dtype=np.uint8).view(np.int8) * np.float32(1 / STEPS))
GATES = {i: times * ((_known > LEVELS[0]).astype(np.uint8) + (_known > LEVELS[1])).astype(np.uint8) for i, times in ((3, np.uint8(3)), (2, np.uint8(1)))}
#: By the bit.
SIGNS = np.array([1, -1], np.float32)


class Scorer:
    """Bits of texts under a model."""

    def __init__(self, model: Model):
        self.code, self.sizes = model.code, model.sizes
        odds, at = np.memmap(model.odds, np.int8, "r") if isinstance(model.odds, str) else model.odds, bases(model.sizes)
        self.odds = [np.asarray(odds[at[i]:at[i + 1]]) for i in range(N_CTX)]

    def bits(self, texts: list[bytes], most: int = 1 << 15) -> np.ndarray:
        """Total bits of each text; texts go together up to ``most`` bytes of stream, a longer
        one in parts."""
        out, at = np.zeros(len(texts)), 0
        while at < len(texts):
            to, n = at, 0
            while to < len(texts) and (to == at or n + len(texts[to]) <= most):
                n += len(texts[to]) + PAD + 1
                to += 1
            data, places, count = stream(texts[at:to])
            ctx = contexts(data, places)
            if to == at + 1:
                state = None
                for k in range(0, len(places), most):
                    f, sign, _ = self._inputs(data, places[k:k + most], [c[k:k + most] for c in ctx])
                    cost, state = self._mix(f, sign, state)
                    out[at] += cost
            else:
                (x, gate), sign, n_bits = self._inputs(data, places, ctx)
                edge = np.concatenate([[0], np.cumsum(np.add.reduceat(n_bits, np.cumsum(count) - count))]).tolist()
                for k, (a, b) in enumerate(zip(edge[:-1], edge[1:])):
                    out[at + k] = self._mix((x[:, a:b], gate[a:b]), sign[a:b], None)[0]
            at = to
        return out

    def _inputs(self, data, places, ctx):
        """Inputs of the mixer, a row a context and one for the bias, with the gate of each bit;
        -1 for a one and 1 for a zero bit; and the bits of each place."""
        n, node, bit = bits_of(self.code, behind(data, places))
        x = np.empty((N_CTX + 1, len(node)), np.float32)
        gate = np.zeros(len(node), np.intp)
        for i in range(N_CTX):
            own = self.odds[i].take(slots(self.sizes[i], ctx[i], n, node))
            np.multiply(own, np.float32(1 / STEPS), out=x[i])
            if i in GATES:
                gate += GATES[i].take(own.view(np.uint8))
        x[N_CTX] = 1
        return (x, gate), SIGNS.take(bit), n

    def _mix(self, inputs, sign, state):
        """Cost in bits of a run of bits, and the state after it. Weights: a row a context, a
        column a gate."""
        x, gate = inputs
        w, size, seen = state or (np.array(START, np.float32).T, BLOCKS[0], 0)
        at, n, cost = 0, len(sign), 0.0
        while at < n:
            to = min(n, at + size)
            g, xs, s = gate[at:to], x[:, at:to], sign[at:to]
            z = np.einsum("ij,ij->j", w.take(g, axis=1), xs)
            np.clip(z, -12, 12, out=z)
            z *= s
            np.exp(z, out=z)  # odds of the other bit
            both = z + 1
            cost += float(np.log(both).sum(dtype=np.float64))
            z /= both
            z *= s  # what the prediction has too much, times the sign
            seen += to - at
            slope = np.array([np.bincount(g, row, N_GATE) for row in xs * z])
            w = w - (RATE / (64 + seen) ** 0.5 / (to - at) ** 0.5 * slope).astype(np.float32)
            at, size = to, min(4 * size, BLOCKS[1])
        return cost / np.log(2), (w, size, seen)


SCORED = "row long, n_tokens long, known long, log_sum double, bits double, n_bytes long, rare array<struct<token:binary,tf:long>>"


def _scored(model, common, batches):
    from collections import Counter

    scorer, held = Scorer(model), common
    for whole in batches:
        for b in pieces(whole, "text", 1 << 20):
            raw = [normal(t) for t in b.column("text").to_pylist()]
            bits = scorer.bits(raw)
            rows, tokens, times, edge = [], [], [], [0]
            for r in raw:
                words = r.split(b" ") if r else []
                words.append(b"")
                logs = list(map(held.get, words))
                found = [v for v in logs if v is not None]
                if len(found) < len(words):
                    rare = Counter([t for t, v in zip(words, logs) if v is None])
                    tokens += rare
                    times += rare.values()
                edge.append(len(tokens))
                rows.append((len(words), len(found), math.fsum(found)))
            pairs = pa.StructArray.from_arrays([pa.array(tokens, pa.binary()), pa.array(times, pa.int64())], ["token", "tf"])
            yield pa.RecordBatch.from_arrays([
                b.column("row"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.float64()),
                pa.array(bits, pa.float64()), pa.array([len(r) for r in raw], pa.int64()), pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pairs),
            ], ["row", "n_tokens", "known", "log_sum", "bits", "n_bytes", "rare"])


def score(documents: DataFrame, is_training, common: int = COMMON) -> DataFrame:
    """For each row of ``documents``: doc_id, trained (whether ``is_training``, a Column, holds
    for it), n_tokens, n_known, train_tokens, base_score, score, total_bits, bits_per_byte.

    Null texts are empty ones: the end alone is scored. Texts of any length are taken whole, in
    parts whose mixer goes on. Without training rows every token is unknown and every bit even.
    Rows without a doc_id and repeated rows are scored like others, equal texts alike; an empty
    table gives no rows. Columns other than doc_id and text are not looked at, but by
    ``is_training``. Words that only few texts have are counted by a join, the most frequent
    ones, at most ``common`` and all that share a count or none of them, from a broadcast table.
    """
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(is_training, F.lit(False)).alias("trained"))
    docs = docs.withColumn("row", F.monotonically_increasing_id())
    learn = docs.where("trained").select("text")
    counts = written(token_counts(learn))
    is_byte = F.substring("token", 1, 1) == F.lit(bytes([END]))
    byte_counts = np.zeros(1 << 16, np.int64)
    for r in counts.where(is_byte).collect():  # 2^16 rows at most
        byte_counts[r["token"][1] << 8 | r["token"][2]] = r["c"]
    words = counts.where(~is_byte)
    n, v = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    # the count from which words are common, by a histogram, so that no more rows than that are sorted or sent
    by = words.groupBy("c").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("c"))
    least = by.withColumn("s", F.sum("k").over(Window.orderBy(F.desc("c")).rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("s") <= common).agg(F.min("c")).first()[0]
    top = words.where(F.col("c") >= (least if least is not None else 1 << 62)).toPandas()
    held = spark.sparkContext.broadcast(dict(zip(map(bytes, top["token"]), np.log10(top["c"].to_numpy(np.float64) + 1).tolist())))
    model = spark.sparkContext.broadcast(train(learn, byte_counts))
    made = written(docs.select("row", "text").mapInArrow(lambda it: _scored(model.value, held.value, it), SCORED))
    rare = made.select("row", F.explode("rare").alias("r")).select("row", F.col("r.token").alias("token"), F.col("r.tf").alias("tf"))
    rare = rare.join(words, "token").groupBy("row").agg(F.sum("tf").alias("k"), F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("s"))
    out = docs.select("row", "doc_id", "trained").join(made.drop("rare"), "row").join(rare, "row", "left")
    none = float(np.log10(n + v + 1))
    return out.select(
        "doc_id", "trained", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).cast("long").alias("n_known"), F.lit(int(n)).cast("long").alias("train_tokens"),
        (F.col("log_sum") + F.coalesce("s", F.lit(0.0)) - F.col("n_tokens") * F.lit(none)).alias("base_score"),
        (-F.col("bits") * F.lit(float(np.log10(2)))).alias("score"), F.col("bits").alias("total_bits"), (F.col("bits") / (F.col("n_bytes") + 1)).alias("bits_per_byte"))


def op2_context_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score(table(spark, sf_dir, "documents"), fold("doc_id", 7) != 2)
    return out.select("doc_id", (~F.col("trained")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
