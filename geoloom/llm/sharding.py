"""Contiguous sharding with the smallest possible largest shard.

Documents of equal text form a group that is never split. Groups stand in the order of
their smallest doc_id, and a shard is a run of groups. A binary search finds the smallest
capacity with which a greedy pass needs no more than the given number of shards; the cuts
are those of that pass. A group larger than the capacity sits in a shard of its own, so that
one hot text does not set the size of all the others.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Groups in a block, a power of two; the driver holds a sum a block and the sizes of a few blocks.
BLOCK = 4096
#: Bytes of a row group in the table of groups: what a look at a block reads beside it, at most.
ROW_GROUP = 1 << 17


def greedy(sizes: np.ndarray, capacity: int, most: int) -> list[int] | None:
    """First group of each shard, or None if more than ``most`` shards are needed."""
    total = np.concatenate([[0], np.cumsum(sizes)])
    cuts, at, n = [], 0, len(sizes)
    while at < n:
        cuts.append(at)
        if len(cuts) > most:
            return None
        at = max(at + 1, int(np.searchsorted(total, total[at] + capacity, "right")) - 1)
    return cuts


class Lazy:
    """Prefix sums of group sizes of which only block sums are known until a place inside a
    block matters; ``fetch`` then gets that block's (key, size) rows."""

    def __init__(self, blocks, fetch):
        self.blocks, self.fetch, self.known = blocks, fetch, {}
        self.total = np.concatenate([[0], np.cumsum([s for _, s, _ in blocks])])
        self.largest = [m for _, _, m in blocks]

    def block(self, i: int):
        if i not in self.known:
            keys, sizes = self.fetch(self.blocks[i][0])
            self.known[i] = (keys, sizes, np.concatenate([[0], np.cumsum(sizes)]))
        return self.known[i]

    def jump(self, at: tuple[int, int], capacity: int) -> tuple[int, int]:
        """The first place that a shard from ``at`` can't reach: past one group at least, and
        before or after a group that is larger than the capacity."""
        i, j = at
        keys, sizes, inside = self.block(i)
        start = self.total[i] + inside[j]
        reach = start + capacity
        to = int(np.searchsorted(self.total, reach, "right")) - 1
        if to >= len(self.blocks):
            return len(self.blocks), 0
        own = self.block(to)
        k = int(np.searchsorted(own[2], reach - self.total[to], "right")) - 1
        if (to, k) <= (i, j):
            to, k = i, j + 1
        if to < len(self.blocks) and k >= len(self.block(to)[1]):
            to, k = to + 1, 0
        return to, k


def minimax(lazy: Lazy, shards: int) -> tuple[int, list]:
    """The smallest capacity that ``shards`` shards can keep to, single groups aside, and the
    key with which each shard begins."""

    def tried(capacity: int):
        at, cuts = (0, 0), []
        while at[0] < len(lazy.blocks):
            cuts.append(at)
            if len(cuts) > shards:
                return None
            at = lazy.jump(at, capacity)
        return cuts

    total = int(lazy.total[-1])
    lo, hi = max(1, -(-total // max(shards, 1)) // max(shards, 1)), max(total, 1)
    if tried(lo) is not None:
        lo = 0
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if tried(mid) is not None:
            hi = mid
        else:
            lo = mid
    return hi, [lazy.block(i)[0][j] for i, j in tried(hi) or []]


def shard_documents(documents: DataFrame, shards: int = 40, overhead: int = 16, block: int = BLOCK) -> DataFrame:
    """(doc_id, size, text_crc32, group, shard, slot) for each row of ``documents``.

    ``size`` is the UTF-8 length plus ``overhead``; null texts are empty ones of length 0 and
    form one group with empty texts; a text of any length is measured and hashed whole. A null
    doc_id counts as the smallest. Repeated rows are rows of their own, in one group. Groups of
    one smallest doc_id stand by their texts' digests. ``slot`` runs from 0 in each shard
    without gaps, by group and doc_id. An empty table gives no rows; extra columns are not
    looked at.
    """
    spark = documents.sparkSession
    low = -(1 << 63)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    docs = written(documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + overhead).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest")))
    groups = written(docs.groupBy("digest").agg(F.coalesce(F.min("doc_id"), F.lit(low)).alias("first"), F.sum("size").alias("total")))
    if groups.isEmpty():
        return docs.select("doc_id", "size", "text_crc32", F.lit(0).cast("long").alias("group"), F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    # groups in order and numbered where they lie, so that a block is a run of numbers: its sums
    # come to the driver, and its rows, when a place in it matters, out of the files that hold it
    order = groups.repartitionByRange("first", "digest").sortWithinPartitions("first", "digest")
    order = written(order.withColumn("at", F.monotonically_increasing_id()), **{"parquet.block.size": ROW_GROUP})
    of = F.floor(F.col("at") / block)
    sums = order.groupBy(of.alias("block")).agg(F.sum("total").alias("s"), F.max("total").alias("m")).orderBy("block").toPandas()

    def fetch(b: int):
        rows = order.where(F.col("at").between(int(b) * block, int(b) * block + block - 1)).select("at", "total").toPandas().sort_values("at")
        return rows["at"].to_numpy(), rows["total"].to_numpy().astype(np.int64)

    _, cuts = minimax(Lazy(list(sums.itertuples(index=False, name=None)), fetch), shards)
    shard = sum((F.when(F.col("at") >= int(c), 1).otherwise(0) for c in cuts[1:]), F.lit(0)).cast("int")
    placed = order.select("digest", F.col("first").alias("group"), F.col("at").alias("place"), shard.alias("shard"))
    rows = docs.join(written(placed), "digest").drop("digest")
    # ranks within shards: rows are dealt out by range, numbered where they lie, and each
    # (part, shard) starts where the parts before it end
    dealt = rows.repartitionByRange("place", "doc_id").sortWithinPartitions("place", "doc_id").withColumn("at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("part", F.shiftright("at", 33)))
    from pyspark.sql import Window

    tally = dealt.groupBy("part", "shard").agg(F.min("at").alias("first_at"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")
    tally = written(tally.select("part", "shard", (before - F.col("first_at")).alias("shift")))
    return dealt.join(tally, ["part", "shard"]).select("doc_id", "size", "text_crc32", "group", "shard", (F.col("at") + F.col("shift")).alias("slot"))


def op9_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
