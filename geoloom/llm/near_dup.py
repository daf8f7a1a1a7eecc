"""Near-duplicate groups by b-bit MinHash.

1. A document's set of word shingles, as 64-bit hashes, gives a digest and one minimum for
   each of ``perms`` hash functions. Equal sets become one class, named by its smallest id.
2. ``rows`` minima in a row make a band; classes that agree in a band share a bucket, whose
   pivot is its smallest id. Each class is paired with the PIVOTS pivots that it shares the
   most buckets with.
3. The low ``bits`` of the minima are packed into longs. The share of agreeing places, less
   those that agree by chance, estimates the similarity; only pairs far below the threshold
   are let go, and the others are confirmed on whole sets.
4. Confirmed links form components. In a bucket of more than one component, the members
   outside its largest one are strangers. A shingle that only one component has can be common
   to no pair of two components. So, with these first and the others by rarity, a text's
   head of shingles, short enough that the rest can't make a link, holds one that any linked
   text of another component has in its own head. Texts without a head are done.
5. Strangers with a head are paired with the PIVOTS most linked members of their buckets'
   largest components, and those that stay apart with the texts of other components that
   share a shingle of their heads, by the same estimate and the same confirmation. So each
   two classes that share a bucket end in one component, have been compared, or can't reach
   the threshold.

A pair of similarity s shares no bucket with probability (1 - s^rows)^bands: 1e-6 at 0.75.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import NONSPACE, Words, discard, grams, lookup, mix, pieces, stem, table, written

SHINGLE, ROWS, BANDS, BITS = 5, 5, 51, 4
PERMS = 256
#: Similarity, in hundredths, from which two documents are linked.
THRESHOLD = 75
#: Standard errors by which an estimate may fall below the threshold before a pair is let go.
SLACK = 6
#: Pivots that a class is paired with at first; step 5 compares all that this leaves apart.
PIVOTS = 4


def shingle_sets(w: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; fewer than k words make one."""
    first, out = w.first, []
    g = grams(w.hash, k)
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        if b - a >= k:
            out.append(np.unique(g[a:b - k + 1]))
        else:
            out.append(grams(w.hash[a:b], b - a) if b > a else np.zeros(0, np.uint64))
    return out


def _functions(n: int) -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return x[:n] | np.uint64(1), x[n:]


def minima(sets: list[np.ndarray], perms: int = PERMS, block: int = 1 << 15) -> np.ndarray:
    """The least value of each hash function over each set (none of them empty)."""
    a, b = _functions(perms)
    out = np.empty((len(sets), perms), np.uint64)
    lens = [len(s) for s in sets]
    at = 0
    while at < len(sets):
        to, n = at, 0
        while to < len(sets) and (to == at or n + lens[to] <= block):
            n += lens[to]
            to += 1
        x = np.concatenate(sets[at:to])
        edge = np.concatenate([[0], np.cumsum(lens[at:to])[:-1]]).astype(np.int64)
        y = np.empty_like(x)
        for j in range(perms):
            np.multiply(x, a[j], out=y)
            np.add(y, b[j], out=y)
            out[at:to, j] = np.minimum.reduceat(y, edge)
        at = to
    return out


def _pack(least: np.ndarray, bits: int) -> np.ndarray:
    """The low bits of well-mixed minima, in perms * bits / 64 longs a row."""
    low = (mix(least) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    flat = np.stack([(low >> i) & 1 for i in range(bits)], axis=2).reshape(len(low), -1)
    return np.packbits(flat, axis=1, bitorder="little").view("<i8")


SIGNED = "doc_id long, n_shingles long, digest binary, bands array<long>, sig array<long>"


def _sign(batches, rows=ROWS, bands=BANDS, bits=BITS, perms=PERMS, shingle=SHINGLE):
    import hashlib

    for whole in batches:
        for batch in pieces(whole, "text"):
            sets = shingle_sets(Words(batch.column("text"), NONSPACE), shingle)
            n = len(sets)
            full = np.array([len(s) > 0 for s in sets], bool)
            least = minima([s for s in sets if len(s)], perms) if full.any() else np.zeros((0, perms), np.uint64)
            keys = np.empty((len(least), bands), np.int64)
            for j in range(bands):
                keys[:, j] = mix(grams_of(least[:, j * rows:(j + 1) * rows]) + np.uint64(j)).view(np.int64)
            sig = _pack(least, bits) if len(least) else np.zeros((0, perms * bits // 64), np.int64)
            digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
            count = full.astype(np.int64)
            lists = lambda flat, width: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count * width)]), pa.int32()), pa.array(flat.ravel(), pa.int64()))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), lists(keys, bands), lists(sig, sig.shape[1]),
            ], ["doc_id", "n_shingles", "digest", "bands", "sig"])


def grams_of(x: np.ndarray) -> np.ndarray:
    c, out = np.uint64(0xD6E8FEB86659FD93), x[:, 0].copy()
    for j in range(1, x.shape[1]):
        out = out * c + x[:, j]
    return out


def estimated(a: Column, b: Column, bits: int = BITS, perms: int = PERMS) -> Column:
    """The collision-corrected similarity of two packed signatures."""
    every = {1: 0xFFFFFFFFFFFFFFFF, 2: 0x5555555555555555, 4: 0x1111111111111111, 8: 0x0101010101010101}[bits]
    every -= 1 << 64 if every >> 63 else 0

    def unequal(x, y):
        d, shift = x.bitwiseXOR(y), 1
        while shift < bits:
            d = d.bitwiseOR(F.shiftrightunsigned(d, shift))
            shift *= 2
        return F.bit_count(d.bitwiseAND(F.lit(every)))

    differ = sum((unequal(a[i], b[i]) for i in range(perms * bits // 64)), F.lit(0))
    chance = 0.5 ** bits
    return (1 - differ / F.lit(perms) - chance) / (1 - chance)


def let_go(threshold: int = THRESHOLD, bits: int = BITS, perms: int = PERMS, slack: float = SLACK) -> float:
    chance = 0.5 ** bits
    agree = chance + (1 - chance) * threshold / 100
    return threshold / 100 - slack * (agree * (1 - agree) / perms) ** 0.5 / (1 - chance)


SETS = "id long, size long, tokens array<long>"


def _sets(batches, shingle=SHINGLE):
    for whole in batches:
        for batch in pieces(whole, "text"):
            sets = shingle_sets(Words(batch.column("text"), NONSPACE), shingle)
            size = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64)
            tokens = pa.LargeListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)])), pa.array(flat)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), tokens], ["id", "size", "tokens"])


def _confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """Those of ``pairs`` (a, b), each once, whose whole sets reach the threshold. A row holds
    the sets of one pair; a hot ``a`` is split by Spark's skew join."""
    pairs = written(pairs.distinct())
    with_b = lookup(sets.select(F.col("id").alias("b"), F.col("size").alias("nb"), F.col("tokens").alias("tb")), pairs, ["b"], "inner")
    hubs = lookup(sets.select(F.col("id").alias("a"), F.col("size").alias("na"), F.col("tokens").alias("ta")), pairs.select("a").distinct(), ["a"], "left_semi")
    both = F.size(F.array_intersect("ta", "tb"))
    good = (both > 0) & (100 * both >= threshold * (F.col("na") + F.col("nb") - both))
    return written(with_b.join(hubs.hint("merge"), "a").where(good).select("a", "b").distinct())


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every id in ``links`` (a, b): the smallest id reachable, by
    alternating neighbourhood minima and pointer jumps; every round is written, none is
    collected."""
    both = written(links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c")).select(F.col("a").alias("id"), "c"))
    while True:
        near = both.join(label.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b").groupBy("a").agg(F.min("cb").alias("m"))
        step = label.join(near, label["id"] == near["a"]).select("id", "c", F.least("c", "m").alias("m"))
        # the old label's owner learns of the smaller one too, then everybody follows its label once
        told = step.groupBy("c").agg(F.min("m").alias("t"))
        step = written(step.join(told, "c").select("id", F.col("c").alias("old"), F.least("m", "t").alias("c")))
        far = step.select(F.col("id").alias("c"), F.col("c").alias("cc"))
        new = written(step.join(far, "c").select("id", "old", F.col("cc").alias("c")))
        done = new.where(F.col("old") != F.col("c")).isEmpty()
        discard(label, step)
        label = new.select("id", "c")
        if done:
            discard(both)
            return label.withColumnRenamed("c", "component")


def _mixed(bucket: DataFrame, comp: DataFrame) -> DataFrame:
    """(key, id, component, main) of the buckets with more than one component; main is the
    largest of these, ties by the larger name."""
    placed = bucket.select("key", F.col("b").alias("id")).join(comp, "id", "left").select("key", "id", F.coalesce("component", "id").alias("component"))
    placed = written(placed)
    parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"))
    main = parts.groupBy("key").agg(F.count(F.lit(1)).alias("k"), F.max(F.struct("n", "component")).alias("m")).where("k > 1").select("key", F.col("m.component").alias("main"))
    out = written(placed.join(main, "key"))
    discard(placed)
    return out


def _heads(mixed: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """(id, size, alone, head) of each text in a mixed bucket that may be linked with another
    component: the rarest of its shingles that more than one component has, as many as must
    hold one in common with any partner.

    Sets of x and y members are linked with t / (1 + t) * (x + y) in common at least. With a
    partner's least size in its buckets, that is ``need`` of x; all but ``need`` - 1 of its
    members hold one that the partner has among its own. Shingles that one component alone
    has come first, as they are common to no pair, then the others by the number of texts
    that have them; ``alone`` counts the former. Shingles are told apart by 32 bits here, which can only make heads longer.
    """
    owner = written(mixed.select("id", "component").distinct())
    own = lookup(sets.select("id", "size", "tokens"), owner, ["id"], "inner")
    spread = own.select("id", "size", "component", F.explode("tokens").alias("t")).select("id", "size", "component", F.shiftright("t", 32).cast("int").alias("t"))
    common = written(spread.groupBy("t").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("n")).where("x <> y").select("t", "n"))
    tokens = F.sort_array(F.collect_list(F.struct("n", "t")))
    listed = written(lookup(spread, common, ["t"], "inner").groupBy("id", "size").agg(tokens.alias("tokens")))
    size = F.col("size")
    smallest = mixed.select("key", "id").join(listed.select("id", "size"), "id").groupBy("key").agg(F.min("size").alias("lo"))
    lo = mixed.select("key", "id").join(smallest, "key").groupBy("id").agg(F.min("lo").alias("lo"))
    need = F.ceil(threshold * (size + F.greatest("lo", F.ceil(threshold * size / 100))) / (100 + threshold))
    length = (F.size("tokens") - need + 1).cast("int")
    out = written(listed.join(lo, "id").where(length > 0).select("id", "size", (size - F.size("tokens")).alias("alone"), F.slice(F.col("tokens")["t"], F.lit(1), length).alias("head")))
    discard(owner, common, listed)
    return out


def near_duplicates(documents: DataFrame, threshold: int = THRESHOLD, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``documents``.

    Null, empty and blank texts have no shingles and link with nothing. Rows that repeat a
    doc_id give a row each and are one document, linked wherever one of its texts is. A row
    with a null doc_id can't be named: it is linked with nothing, its component_id is null and
    it is kept. Ties in similarity don't matter: from ``threshold`` hundredths on two sets are
    linked. Texts of any length are taken whole; a pair's two sets are the most that a
    confirming row holds. Only doc_id and text are looked at, so further columns can't clash;
    an empty table gives no rows.
    """
    docs = stem(documents.sparkSession, documents)
    signed = written(docs.mapInArrow(lambda it: _sign(it, shingle=shingle), SIGNED))
    full = signed.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    # equal sets: one class a digest, named by its smallest id, which keeps bands and signature
    named = full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n"))
    many = written(named.where(F.col("n") > 1).select("digest", "rep"))
    other = written(full.select("doc_id", "digest").join(many, "digest").where(F.col("doc_id") != F.col("rep")).distinct())
    classes = lookup(full, other.select("doc_id", "digest"), ["doc_id", "digest"], "left_anti").select(F.col("doc_id").alias("id"), "bands", "sig")

    # buckets with two members at least, and their pivots
    rows = classes.select("id", F.explode("bands").alias("key"))
    pivots = written(rows.groupBy("key").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a <> z").select("key", "a"))
    bucket = written(lookup(rows, pivots, ["key"], "inner").select("key", "a", F.col("id").alias("b")).distinct())
    inside = written(bucket.select(F.col("b").alias("id")).distinct())
    sig = written(lookup(classes.select("id", "sig"), inside, ["id"], "left_semi"))
    sets = lookup(docs.where(F.col("text").isNotNull()), inside.withColumnRenamed("id", "doc_id"), ["doc_id"], "left_semi")
    sets = written(sets.mapInArrow(lambda it: _sets(it, shingle), SETS))
    least = let_go(threshold)

    def likely(pairs: DataFrame) -> DataFrame:
        with_b = pairs.join(sig.select(F.col("id").alias("b"), F.col("sig").alias("sb")), "b")
        with_a = with_b.join(sig.select(F.col("id").alias("a"), F.col("sig").alias("sa")), "a")
        return with_a.where(estimated(F.col("sa"), F.col("sb")) >= least).select("a", "b")

    shared = bucket.where("a <> b").groupBy("b", "a").agg(F.count(F.lit(1)).alias("n"))
    best = F.slice(F.sort_array(F.collect_list(F.struct(-F.col("n"), "a"))), 1, PIVOTS)
    star = shared.groupBy("b").agg(best["a"].alias("a")).select("b", F.explode("a").alias("a"))
    # a document of several texts may be a class by one and a copy by another, or a copy by two
    twofold = other.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")).join(classes.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
    first = other.groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).where("a <> z").select("doc_id", "a")
    twice = other.join(first, "doc_id").where("a <> rep").select("a", F.col("rep").alias("b"))
    links = written(_confirm(likely(star), sets, threshold).unionAll(twofold).unionAll(twice))
    comp = components(links)

    mixed = _mixed(bucket, comp)
    heads = _heads(mixed, sets, threshold)
    alive = written(mixed.where("component <> main").select("id").distinct().join(heads.select("id"), "id", "left_semi"))
    if not alive.isEmpty():
        # the members of the largest components that hold the fewest shingles of their own, then the most linked
        degree = links.select(F.col("a").alias("id")).unionAll(links.select(F.col("b").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("d"))
        rank = F.struct(F.col("alone"), (-F.coalesce("d", F.lit(0))).alias("d"), F.col("id").alias("a"))
        hub = mixed.where("component = main").join(heads, "id").join(degree, "id", "left").groupBy("key").agg(F.min(rank).alias("h"))
        pairs = mixed.where("component <> main").join(alive, "id", "left_semi").join(hub, "key").select(F.col("id").alias("b"), "h")
        best = F.slice(F.sort_array(F.collect_set("h")), 1, PIVOTS)
        pairs = pairs.groupBy("b").agg(best["a"].alias("a")).select("b", F.explode("a").alias("a"))
        links = written(links.unionAll(_confirm(likely(pairs), sets, threshold)).distinct())
        discard(mixed)
        mixed = _mixed(bucket, components(links))
        # what is still apart: against those that share a shingle of their heads
        still = written(mixed.where("component <> main").select("id").distinct())
        placed = written(heads.join(mixed.select("id", "component").distinct(), "id").join(sig, "id"))
        side = lambda k: [F.col("id").alias(k), F.col("component").alias(f"c{k}"), F.col("sig").alias(f"g{k}"), F.col("size").alias(f"z{k}"), F.col("alone").alias(f"n{k}"), F.posexplode("head").alias(f"i{k}", f"t{k}")]
        # the first shingle in common has at most so many of either text from it on
        most = F.least(F.col("za") - F.col("na") - F.col("ia"), F.col("zb") - F.col("nb") - F.col("ib"))
        near = (F.col("ta") == F.col("tb")) & (F.col("ca") != F.col("cb")) & (100 * most >= threshold * (F.col("za") + F.col("zb") - most)) & (estimated(F.col("ga"), F.col("gb")) >= least)
        more = lookup(placed, still, ["id"], "left_semi").select(*side("a")).join(placed.select(*side("b")).hint("merge"), near)
        links = written(links.unionAll(_confirm(more.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), sets, threshold)).distinct())
        comp = components(links)
        discard(still, placed)
    moved = comp.where("id <> component").select(F.col("id").alias("rep"), "component")
    copies = other.select("doc_id", "rep").join(moved, "rep", "left").select("doc_id", F.coalesce("component", "rep").alias("component"))
    known = written(moved.select(F.col("rep").alias("doc_id"), "component").unionAll(copies).groupBy("doc_id").agg(F.min("component").alias("component")))
    discard(many, other, pivots, bucket, inside, sig, sets, links, mixed, heads, alive)
    out = lookup(signed.select("doc_id", "n_shingles"), known, ["doc_id"], "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def one_of_each(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` that stand for their group, all columns kept.

    Of rows that repeat both doc_id and text one stays; rows of one doc_id with different
    texts stay or go together. A row with a null doc_id stays, as does one without words. An
    empty table gives no rows.
    """
    found = written(near_duplicates(documents).select("doc_id", "kept"))
    gone = written(found.where(~F.col("kept")).select("doc_id").distinct())
    stays = lookup(documents, gone, ["doc_id"], "left_anti")
    twice = written(found.where("kept and doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    if twice.isEmpty():
        return stays
    once = lookup(stays, twice, ["doc_id"], "left_semi").dropDuplicates(["doc_id", "text"])
    return lookup(stays, twice, ["doc_id"], "left_anti").unionByName(once)


OP8_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g
       FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - least(5, len(w)) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, edge.b FROM reach JOIN edge ON edge.a = reach.r),
comp AS (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, comp.c AS component_id, d.doc_id = comp.c AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN comp USING (doc_id)
"""
