"""Filters, aggregates, clusters and searches over points."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crs import CHINA
from ..functions.geodesy import R, haversine
from .durable import durable


def bounds(df: DataFrame, *axes: str) -> DataFrame:
    """One row of min_/max_ per axis; zeros for no rows."""
    return df.agg(*(F.coalesce(f(a), F.lit(0.0)).alias(f"{n}_{a}") for a in axes for n, f in (("min", F.min), ("max", F.max))))


def centroid(df: DataFrame, *axes: str) -> DataFrame:
    return df.agg(*(F.coalesce(F.avg(a), F.lit(0.0)).alias(f"c_{a}") for a in axes))


def cloud_stats(df: DataFrame) -> DataFrame:
    """Count, bounds, centroid, density and population deviations of (x, y, z)."""
    ext = [F.greatest(F.max(a) - F.min(a), F.lit(0.001)) for a in "xyz"]
    return df.agg(F.count(F.lit(1)).alias("n"), *(f(a).alias(f"{n}_{a}") for a in "xyz" for n, f in (("min", F.min), ("max", F.max), ("avg", F.avg), ("std", F.stddev_pop))),
                  (F.count(F.lit(1)) / (ext[0] * ext[1] * ext[2])).alias("density"))


def in_box(df: DataFrame, **box: tuple[float, float]) -> DataFrame:
    for axis, (lo, hi) in box.items():
        df = df.where(F.col(axis).between(lo, hi))
    return df


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


LIMITS = {"wgs84": (-180.0, 180.0, -90.0, 90.0), "mercator": (-20037508.342789244, 20037508.342789244, -20037508.342789244, 20037508.342789244), "china": CHINA}


def valid(lng: Column, lat: Column, crs: str = "wgs84", tol: float = 1e-10) -> Column:
    x0, x1, y0, y1 = LIMITS[crs]
    return finite(lng) & finite(lat) & lng.between(x0 - tol, x1 + tol) & lat.between(y0 - tol, y1 + tol)


def clean(df: DataFrame, strategy: str, crs: str = "wgs84") -> DataFrame:
    """``remove`` drops invalid rows, ``clamp`` moves finite ones to the range and drops others,
    ``snap`` also takes those that aren't finite to 0; anything else changes nothing."""
    x0, x1, y0, y1 = LIMITS[crs]
    clamp = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi))
    lng, lat = F.col("lng"), F.col("lat")
    if strategy == "remove":
        return df.where(valid(lng, lat, crs))
    if strategy == "clamp":
        return df.where(finite(lng) & finite(lat)).withColumns({"lng": clamp(lng, x0, x1), "lat": clamp(lat, y0, y1)})
    if strategy == "snap":
        whole = lambda c: F.when(finite(c), c).otherwise(0.0)
        return df.withColumns({"lng": clamp(whole(lng), x0, x1), "lat": clamp(whole(lat), y0, y1)})
    return df


def dedup(df: DataFrame) -> DataFrame:
    """The first row, by idx, of each exact position."""
    return df.groupBy("lng", "lat").agg(F.min("idx").alias("idx"))


def cluster_by_grid(df: DataFrame, metres: float, min_points: int) -> DataFrame:
    """Mean position and size of every cell of ``metres`` (degrees at the mean latitude) with
    ``min_points`` at least. The mean is one row, broadcast."""
    mean = df.agg(F.round(F.avg("lat"), 6).alias("mean_lat"))
    d_lat = math.degrees(metres / R)
    joined = df.crossJoin(F.broadcast(mean))
    d_lng = F.degrees(F.lit(metres) / (F.greatest(F.cos(F.radians("mean_lat")), F.lit(1e-10)) * R))
    cells = joined.groupBy(F.floor(F.col("lng") / d_lng).alias("cx"), F.floor(F.col("lat") / d_lat).alias("cy"))
    return cells.agg(F.avg("lng").alias("lng"), F.avg("lat").alias("lat"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_points)


def grid_index(df: DataFrame, size: float) -> DataFrame:
    """Row-major cell numbers over the bounds of all rows."""
    b = df.agg(F.min("lng").alias("x0"), F.min("lat").alias("y0"), (F.ceil((F.max("lng") - F.min("lng")) / size) + 1).alias("cols"))
    cell = F.floor((F.col("lat") - F.col("y0")) / size) * F.col("cols") + F.floor((F.col("lng") - F.col("x0")) / size)
    return df.crossJoin(F.broadcast(b)).select("idx", cell.alias("cell"))


def voxel(df: DataFrame, size: float) -> DataFrame:
    """The first point, by idx, of each cube of ``size``; nothing for a size of 0 or less."""
    if size <= 0:
        return df.limit(0)
    keys = [F.floor(F.col(a).cast("float") / F.lit(size).cast("float")).alias(f"v{a}") for a in "xyz"]
    rest = [c for c in df.columns if c != "idx"]
    first = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), "idx").alias("p"), F.min("idx").alias("idx"))
    return first.select("idx", *(F.col(f"p.{c}").alias(c) for c in rest))


def auto_voxel(df: DataFrame, target: int) -> DataFrame:
    """Cubes whose size makes about ``target`` of them in the bounds."""
    b = df.agg(*(F.greatest(F.max(a) - F.min(a), F.lit(0.001)) for a in "xyz")).first()
    return voxel(df, (b[0] * b[1] * b[2] / target) ** (1 / 3))


def affine(df: DataFrame, m: list[float]) -> DataFrame:
    """A column-major 4x4 matrix, without division by w."""
    return df.withColumns({a: F.col("x") * m[i] + F.col("y") * m[4 + i] + F.col("z") * m[8 + i] + m[12 + i] for i, a in enumerate("xyz")})


def rotate(df: DataFrame, axis: tuple[float, float, float], angle: float) -> DataFrame:
    """Rodrigues' rotation about a unit axis, in radians."""
    c, s = math.cos(angle), math.sin(angle)
    k, v = axis, [F.col(a) for a in "xyz"]
    dot = v[0] * k[0] + v[1] * k[1] + v[2] * k[2]
    cross = [v[2] * k[1] - v[1] * k[2], v[0] * k[2] - v[2] * k[0], v[1] * k[0] - v[0] * k[1]]
    return df.withColumns({a: v[i] * c + cross[i] * s + dot * (k[i] * (1 - c)) for i, a in enumerate("xyz")})


def merge(a: DataFrame, b: DataFrame) -> DataFrame:
    """All points of both; a side without colours is grey if the other has some."""
    grey = lambda df, other: df.withColumns({c: F.lit(128) for c in ("r", "g", "b") if c in other.columns and c not in df.columns})
    return grey(a, b).unionByName(grey(b, a), allowMissingColumns=True)


def translate(df: DataFrame, dx: float, dy: float, dz: float) -> DataFrame:
    return df.withColumns({a: F.col(a) + d for a, d in zip("xyz", (dx, dy, dz))})


def scale(df: DataFrame, sx: float, sy: float, sz: float) -> DataFrame:
    return df.withColumns({a: F.col(a) * k for a, k in zip("xyz", (sx, sy, sz))})


def _extent(df: DataFrame, *axes: str) -> DataFrame:
    """One row of lo_/hi_ per axis, to be broadcast."""
    return df.agg(*(f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))))


def normalize(df: DataFrame, *axes: str) -> DataFrame:
    """Axes brought to 0..1 by the bounds of all rows; a flat axis is 0.5."""
    span = lambda a: F.col(f"hi_{a}") - F.col(f"lo_{a}")
    out = df.crossJoin(F.broadcast(_extent(df, *axes)))
    return out.withColumns({a: F.when(F.abs(span(a)) < 1e-12, 0.5).otherwise((F.col(a) - F.col(f"lo_{a}")) / F.nullif(span(a), F.lit(0.0))) for a in axes}).select(*df.columns)


def denormalize(df: DataFrame, **limits: tuple[float, float]) -> DataFrame:
    """Axes in 0..1 brought to their limits; the lower one for a flat axis."""
    return df.withColumns({a: F.lit(float(lo)) if abs(hi - lo) < 1e-12 else F.col(a) * (hi - lo) + lo for a, (lo, hi) in limits.items()})


def bounds_multi(df: DataFrame, *axes: str) -> DataFrame:
    """One row of bounds over all buffers; nulls are passed over, without any value they are
    +inf and -inf."""
    inf = float("inf")
    return df.agg(*(F.coalesce(f(a), F.lit(none)).alias(f"{n}_{a}") for a in axes for n, f, none in (("min", F.min, inf), ("max", F.max, -inf))))


def ranked(df: DataFrame, *keys: str) -> DataFrame:
    """``rank``: the place of each row in the order of ``keys``, from 0. Rows are dealt out by
    range, sorted and numbered where they lie; the parts' sizes give where each begins."""
    dealt = durable(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = dealt.groupBy(part.alias("_part")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select("_part", (before - F.col("_first")).alias("_shift"))  # a row a partition
    return dealt.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn("rank", F.col("_at") + F.col("_shift")).select(*df.columns, "rank")


def random_indices(n: int, k: int, seed: int = 12345):
    """The first k places of a shuffle of 0..n-1 by the fixed linear congruential generator:
    a step a place, holding only the places that have moved."""
    moved: dict[int, int] = {}
    for i in range(min(n, k)):
        seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
        j = min(i + int(seed / 0x7FFFFFFF * (n - i)), n - 1)
        yield moved.get(j, j)
        moved[j] = moved.get(i, i)


def decimate_random(df: DataFrame, target: int, seed: int = 12345) -> DataFrame:
    """The rows whose idx (dense, from 0) the generator draws first, with their ``place``. The
    draw is a chain of ``target`` steps, so one task makes it, a few bytes a place; the rows
    themselves stay distributed."""
    spark, n = df.sparkSession, df.count()

    def draw(_):
        import pandas as pd

        places = []
        for place, idx in enumerate(random_indices(n, target, seed)):
            places.append((idx, place))
            if len(places) == 100_000:
                yield pd.DataFrame(places, columns=["idx", "place"])
                places = []
        yield pd.DataFrame(places, columns=["idx", "place"])

    return df.join(spark.range(1, numPartitions=1).mapInPandas(draw, "idx long, place long"), "idx")


def quantize(df: DataFrame, bits: int = 16) -> DataFrame:
    """Positions as integers of ``bits`` between the bounds, in single precision; a flat axis is 0."""
    most = float(2 ** bits - 1)
    b = df.agg(*(f(F.col(a).cast("float")).alias(f"{n}_{a}") for a in "xyz" for n, f in (("lo", F.min), ("hi", F.max))))
    f32 = lambda c: c.cast("float")

    def q(a):
        span = f32(F.col(f"hi_{a}") - F.col(f"lo_{a}"))
        t = f32(f32(f32(F.col(a)) - F.col(f"lo_{a}")) / span)
        return F.when(span < 1e-10, 0).otherwise(F.least(F.floor(f32(t * F.lit(most).cast("float"))), F.lit(int(most)))).cast("int")

    return df.crossJoin(F.broadcast(b)).select("idx", *(q(a).alias(f"q{a}") for a in "xyz"))


def dequantize(df: DataFrame, low: tuple, high: tuple, bits: int = 16) -> DataFrame:
    """Integers of ``bits`` (qx, qy, qz) back to positions between the bounds, in single precision."""
    most = F.lit(float(2 ** bits - 1)).cast("float")
    f32 = lambda c: c.cast("float")
    back = lambda a, lo, hi: f32(F.lit(float(lo)).cast("float") + f32(f32(f32(F.col(f"q{a}")) / most) * F.lit(float(hi) - float(lo)).cast("float")))
    return df.select("idx", *(back(a, lo, hi).alias(a) for a, lo, hi in zip("xyz", low, high)))


def flip_normals(df: DataFrame) -> DataFrame:
    """Normals (nx, ny, nz) that point towards the centroid of all points are turned round."""
    c = df.agg(*(F.avg(a).alias(f"c{a}") for a in "xyz"))
    out = df.crossJoin(F.broadcast(c))
    inward = sum(F.col(f"n{a}") * (F.col(a) - F.col(f"c{a}")) for a in "xyz") < 0
    return out.withColumns({f"n{a}": F.when(inward, -F.col(f"n{a}")).otherwise(F.col(f"n{a}")) for a in "xyz"}).select(*df.columns)


# ---------------------------------------------------------------- searches

def _covered(boxes: DataFrame, cell: float, most: int = 4, kinds: list[int] | None = None) -> DataFrame:
    """Boxes with the cells they meet, of the level (cell size doubled ``level`` times) at which
    a side is ``most`` cells at most, so a box of any size meets at most (most + 1)^2. With
    ``kinds``, a row set for each of these levels of things that lie in the cell of their lower
    corner and are as long as a cell of their own level (``kind``): the cells, on the higher
    level of both, from which they reach the box."""
    side = F.greatest(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.lit(cell))
    level = F.greatest(F.ceil(F.log2(side / (cell * most))), F.lit(0)).cast("int")
    out = boxes.withColumn("level", level).withColumn("kind", F.lit(0) if kinds is None else F.explode(F.array(*[F.lit(i) for i in kinds or [0]])))
    out = out.withColumn("w", F.lit(float(cell)) * F.pow(F.lit(2.0), F.greatest("level", "kind")))
    reach = F.lit(0.0) if kinds is None else F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("kind"))
    for axis, lo, hi in (("cx", "x0", "x1"), ("cy", "y0", "y1")):
        out = out.where(F.col(lo) <= F.col(hi)).withColumn(axis, F.explode(F.sequence(F.floor((F.col(lo) - reach) / F.col("w")), F.floor(F.col(hi) / F.col("w")))))
    return out.drop("kind") if kinds is None else out


def _cells(points: DataFrame, levels: list[int], cell: float) -> DataFrame:
    """A row of each point for each level, with its cell there."""
    out = points.withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels])))
    w = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("level"))
    return out.withColumns({"cx": F.floor(F.col("lng") / w), "cy": F.floor(F.col("lat") / w)})


def bbox_join(points: DataFrame, boxes: DataFrame, cell: float) -> DataFrame:
    """(box, idx) for every point in a closed box (box, x0, y0, x1, y1), by cells: a box goes
    to the cells that it meets, on the level that its size asks for, a point to its own on
    the levels that boxes have, so this is an equi-join, then a check. Few boxes are broadcast;
    with many, Spark's skew join splits a hot cell."""
    spread = durable(_covered(boxes, cell))
    levels = [r["level"] for r in spread.select("level").distinct().collect()]  # one for each doubling of the box size
    own = _cells(points.select("idx", "lng", "lat"), levels or [0], cell)
    return own.join(spread.drop("w"), ["level", "cx", "cy"]).where(F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1"))).select("box", "idx")


def knn(points: DataFrame, queries: DataFrame, k: int, cell: float | None = None, axes: tuple = ("lng", "lat"), at: tuple = ("qx", "qy")) -> DataFrame:
    """The k nearest points (ties by idx) of each query (qid and its place in the ``at``
    columns): (qid, idx, d2, rank).

    Cells double in size from level to level, and a query looks at those around its own: a
    level is an equi-join of nine rows a query (27 in space), whatever the distance. A query is
    done when k hits are nearer than the rim of its cells; the others go on to the next level.
    At a level whose cells cover all points every query is done, so none is left out. Without
    ``cell`` the first size is such that a cell holds about k points on average.
    """
    spark = points.sparkSession
    none = spark.createDataFrame([], "qid long, idx long, d2 double, rank int")
    lo = lambda c, i: F.min(c).alias(f"lo{i}")
    hi = lambda c, i: F.max(c).alias(f"hi{i}")
    p = points.agg(F.count(F.lit(1)).alias("n"), *(f(c, i) for i, c in enumerate(axes) for f in (lo, hi))).first()
    q = queries.agg(F.count(F.lit(1)).alias("n"), *(f(c, i) for i, c in enumerate(at) for f in (lo, hi))).first()
    if not p["n"] or not q["n"]:
        return none
    total, dims = min(k, p["n"]), range(len(axes))
    if cell is None:
        sides = [max(p[f"hi{i}"] - p[f"lo{i}"], 1e-9) for i in dims]
        cell = max((math.prod(sides) * k / p["n"]) ** (1 / len(axes)), max(sides) * 1e-6)
    reach = max(max(p[f"hi{i}"], q[f"hi{i}"]) - min(p[f"lo{i}"], q[f"lo{i}"]) for i in dims)
    last = max(0, math.ceil(math.log2(max(reach, cell) / cell)) + 1)
    keys, todo, found, level = [f"_c{i}" for i in dims], queries.select("qid", *at), None, 0
    while True:
        w = cell * 2.0 ** level
        cells = todo
        for key, c in zip(keys, at):
            cells = cells.withColumn(key, F.explode(F.sequence(F.floor(F.col(c) / w) - 1, F.floor(F.col(c) / w) + 1)))
        if q["n"] * 3 ** len(axes) <= 500_000:  # few queries go to the points
            cells = F.broadcast(cells)
        own = points.select("idx", *axes, *(F.floor(F.col(c) / w).alias(key) for key, c in zip(keys, axes)))
        d2 = sum((F.col(a) - F.col(b)) ** 2 for a, b in zip(axes, at))
        inside = [F.col(c) - F.floor(F.col(c) / w) * w for c in at]
        rim = F.least(*(F.least(i, F.lit(w) - i) for i in inside)) + w
        hits = cells.join(own, keys).select("qid", "idx", d2.alias("d2"), rim.alias("rim"))
        best = durable(hits.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "idx"))).where(F.col("rank") <= k))
        safe = best.groupBy("qid").agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("worst"), F.first("rim").alias("rim")).where((F.col("n") >= total) & ((F.sqrt("worst") < F.col("rim")) | F.lit(level >= last))).select("qid")
        done = best.join(safe, "qid", "left_semi").select("qid", "idx", "d2", "rank")
        found = done if found is None else found.unionAll(done)
        todo = durable(todo.join(safe, "qid", "left_anti"))
        if todo.isEmpty():
            return found
        level += 1


def nearest_spacing(points: DataFrame, cell: float | None = None) -> DataFrame:
    """Mean planar distance of every point to its nearest other, exact."""
    q = points.select(F.col("idx").alias("qid"), F.col("lng").alias("qx"), F.col("lat").alias("qy"))
    # of equal positions the point itself may come second
    two = knn(points, q, 2, cell).groupBy("qid").agg(F.min(F.when(F.col("idx") != F.col("qid"), F.col("d2"))).alias("d2"))
    return two.agg(F.avg(F.sqrt("d2")).alias("spacing"))


# ---------------------------------------------------------------- density clusters

def _local_clusters(pdf, box: tuple, side: float, c: float, metres: float, min_points: int):
    """(idx, kind, label) of one block of ``dbscan``: its cores (0), cores of other blocks in reach
    (1, one a cell and block), and border points with each cluster in their reach (2). A label is
    the least idx of the cores that hang together here. Points of one cell, whose diagonal is
    the reach, are neighbours without a look at their distance."""
    import itertools

    import numpy as np
    import pandas as pd

    idx, place = pdf["idx"].to_numpy(), pdf[["px", "py", "pz"]].to_numpy()
    lng, lat = (np.radians(pdf[n].to_numpy()) for n in ("lng", "lat"))
    block = np.floor(place / side).astype(np.int64)
    low = np.array(box) * side
    own, inner = (block == np.array(box)).all(axis=1), ((place >= low - c * 1.000001) & (place <= low + side + c * 1.000001)).all(axis=1)
    cells = np.floor(place / (c / math.sqrt(3) * (1 - min(0.5, 1e-6 + 1e-14 / c)))).astype(np.int64)
    names, cell = np.unique(cells, axis=0, return_inverse=True)
    order = np.argsort(cell.ravel(), kind="stable")
    members = np.split(order, np.cumsum(np.bincount(cell.ravel()))[:-1])
    number = {n: i for i, n in enumerate(map(tuple, names.tolist()))}
    steps = list(itertools.product((-2, -1, 0, 1, 2), repeat=3))
    around = [[k for dx, dy, dz in steps if (k := number.get((x + dx, y + dy, z + dz))) is not None] for x, y, z in names.tolist()]
    band = 1e-9 + 1e-15 / c

    def near(i, j):
        """Which of the points i are in reach of which of j; near the limit by the haversine."""
        d = sum((place[i, k][:, None] - place[j, k][None]) ** 2 for k in range(3))
        out = d <= c * c
        for u, v in zip(*np.nonzero(np.abs(d - c * c) <= 2 * band * c * c)):
            p, q = i[u], j[v]
            h = math.sin((lat[q] - lat[p]) / 2) ** 2 + math.cos(lat[p]) * math.cos(lat[q]) * math.sin((lng[q] - lng[p]) / 2) ** 2
            out[u, v] = 2 * R * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0.0))) <= metres
        return out

    def slices(i, j):
        step = max(1, 2_000_000 // max(len(j), 1))
        return (i[k:k + step] for k in range(0, len(i), step))

    core = np.zeros(len(idx), bool)
    for k, m in enumerate(members):
        if len(m) > min_points:
            core[m] = True
        elif len(m := m[inner[m]]):
            other = np.concatenate([members[o] for o in around[k]])
            for i in slices(m, other):
                core[i] = near(i, other).sum(axis=1) - 1 >= min_points
    core &= inner
    cores, up = [m[core[m]] for m in members], list(range(len(members)))

    def root(k):
        while up[k] != k:
            up[k] = k = up[up[k]]
        return k

    for k, m in enumerate(cores):
        for o in around[k] if len(m) else ():
            if o > k and len(cores[o]) and root(k) != root(o) and any(near(i, cores[o]).any() for i in slices(m, cores[o])):
                up[root(o)] = root(k)
    roots = np.array([root(k) for k in range(len(members))])
    least = np.full(len(members), np.iinfo(np.int64).max)
    for k, m in enumerate(cores):
        if len(m):
            least[roots[k]] = min(least[roots[k]], idx[m].min())
    label, out = least[roots], []
    for k, m in enumerate(cores):
        out += [(int(i), 0, int(label[k])) for i in idx[m[own[m]]]]
        there = m[~own[m]]
        if len(there):
            first = pd.DataFrame({"i": idx[there], **{n: block[there, a] for a, n in enumerate("xyz")}}).groupby(["x", "y", "z"])["i"].min()
            out += [(int(i), 1, int(label[k])) for i in first]
        if len(rest := members[k][own[members[k]] & ~core[members[k]]]):
            for o in around[k]:
                if len(cores[o]):
                    for i in slices(rest, cores[o]):
                        out += [(int(p), 2, int(label[o])) for p in idx[i[near(i, cores[o]).any(axis=1)]]]
    return pd.DataFrame(out, columns=["idx", "kind", "label"]).drop_duplicates()


def dbscan(points: DataFrame, metres: float, min_points: int) -> DataFrame:
    """(idx, cluster): density clusters by great-circle distance, -1 for noise.

    A point with ``min_points`` others within ``metres`` is a core; cores in reach of each
    other are one cluster, numbered by the smallest idx of its cores, from 0. A border point
    goes to the first of the clusters in its reach. Clusters are found in blocks of space (cubes
    about the sphere, each with the points twice the reach around it); those of different blocks
    that share a core are joined by minima of labels and jumps, a durable round at a time, over
    pairs of labels and not of points; nothing is collected.
    """
    if metres <= 0:
        return points.select("idx", F.lit(-1).cast("long").alias("cluster"))
    c = 2 * math.sin(metres / R / 2) if metres < math.pi * R else 2.1
    x, y = F.radians("lng"), F.radians("lat")
    at = points.where(finite(F.col("lng")) & finite(F.col("lat"))).select("idx", "lng", "lat", (F.cos(y) * F.cos(x)).alias("px"), (F.cos(y) * F.sin(x)).alias("py"), F.sin(y).alias("pz"))
    b = at.agg(F.count(F.lit(1)).alias("n"), *((F.max(a) - F.min(a)).alias(a) for a in ("px", "py", "pz"))).first()
    if not b["n"]:
        return points.select("idx", F.lit(-1).cast("long").alias("cluster"))
    spans, h = sorted(b[a] for a in ("px", "py", "pz")), 2 * c * 1.000001
    side = max(8 * h, math.sqrt(spans[1] * spans[2] * 5000 / b["n"]))  # a few thousand points at least, where they are even
    for n, a in (("bx", "px"), ("by", "py"), ("bz", "pz")):
        at = at.withColumn(n, F.explode(F.sequence(F.floor((F.col(a) - h) / side), F.floor((F.col(a) + h) / side))))

    def run(key, pdf):
        return _local_clusters(pdf, key, side, c, metres, min_points)

    found = durable(at.groupBy("bx", "by", "bz").applyInPandas(run, "idx long, kind int, label long"))
    own = found.where("kind = 0").select("idx", F.col("label").alias("c"))
    pairs = found.where("kind = 1").join(own, "idx").where("label <> c").select(F.col("label").alias("idx"), F.col("c").alias("j"))
    edges = durable(pairs.unionAll(pairs.select("j", "idx")).distinct())
    label = durable(found.where("kind < 2").select(F.col("label").alias("idx")).distinct().withColumn("c", F.col("idx")))
    while True:
        least = edges.join(label.select(F.col("idx").alias("j"), "c"), "j").groupBy("idx").agg(F.min("c").alias("m"))
        step = durable(label.join(least, "idx", "left").select("idx", F.col("c").alias("old"), F.least("c", F.coalesce("m", "c")).alias("c")))
        jump = step.select(F.col("idx").alias("c"), F.col("c").alias("up"))
        new = durable(step.join(jump, "c").select("idx", "old", F.col("up").alias("c")))
        label = new.select("idx", "c")
        if new.where("old <> c").isEmpty():
            break
    named = durable(found.where("kind <> 1").join(label.select(F.col("idx").alias("label"), "c"), "label").groupBy("idx").agg(F.min("c").alias("c")))
    numbers = ranked(label.select("c").distinct(), "c").select("c", F.col("rank").alias("cluster"))
    return points.select("idx").join(named.join(numbers, "c").select("idx", "cluster"), "idx", "left").select("idx", F.coalesce("cluster", F.lit(-1)).cast("long").alias("cluster"))


# ---------------------------------------------------------------- octree

MORTON = 21


def _digits(cloud: DataFrame, b, depth: int) -> DataFrame:
    """Cloud rows with ``code``: the octants from the root down, three bits a level."""
    out = cloud
    for a in "xyz":
        lo, hi = float(b[f"lo_{a}"]), float(b[f"hi_{a}"])
        # halving the bounds ``depth`` times is one division, but for points on the very edge of a cell
        cells = F.floor((F.col(a) - lo) / ((hi - lo) or 1.0) * float(2 ** depth)) if hi > lo else F.lit(2 ** depth - 1)
        out = out.withColumn(f"_c{a}", F.least(F.greatest(cells, F.lit(0)), F.lit(2 ** depth - 1)).cast("long"))
    bit = lambda c, k: F.shiftright(c, k).bitwiseAND(F.lit(1).cast("long"))
    code = F.lit(0).cast("long")
    for k in range(depth - 1, -1, -1):
        code = F.shiftleft(code, 3).bitwiseOR(F.shiftleft(bit(F.col("_cx"), k), 2)).bitwiseOR(F.shiftleft(bit(F.col("_cy"), k), 1)).bitwiseOR(bit(F.col("_cz"), k))
    return out.withColumn("code", code).drop("_cx", "_cy", "_cz")


def octree(cloud: DataFrame, max_points: int, max_depth: int) -> DataFrame:
    """(path, level, n, leaf, min_x .. max_z) of every node, empty ones too.

    Rows that aren't finite are left out. A node of more than ``max_points`` is split in eight
    while its level is below ``max_depth`` and its points lie in two octants at least. The
    octants of a point come from its place within the root's bounds, once; a level then is a
    count of code prefixes, of one row for each distinct code and not for each point. No points
    make one empty root of zero bounds.
    """
    rows = cloud.where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z"))).select("x", "y", "z")
    b = _extent(rows, *"xyz").first()
    spark, names = cloud.sparkSession, ["min_x", "min_y", "min_z", "max_x", "max_y", "max_z"]
    schema = "path string, level int, n long, leaf boolean, " + ", ".join(f"{n} double" for n in names)
    if b["lo_x"] is None:
        return spark.createDataFrame([("", 0, 0, True, *([0.0] * 6))], schema)
    depth = min(max_depth, MORTON)
    codes = durable(_digits(rows, b, depth).groupBy("code").agg(F.count(F.lit(1)).alias("n")))
    prefix = lambda level: F.shiftright("code", 3 * (depth - level))
    alive, out = codes, None
    for level in range(depth + 1):
        nodes = alive.groupBy(prefix(level).alias("node")).agg(F.sum("n").alias("n"))
        if level:  # of each split node all eight
            eight = parents.select(F.shiftleft("node", 3).alias("base"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("d")).select((F.col("base") + F.col("d")).cast("long").alias("node"))  # noqa: F821
            nodes = eight.join(nodes, "node", "left").select("node", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        nodes = durable(nodes)
        if level < depth:
            octants = alive.groupBy(prefix(level).alias("node")).agg(F.count_distinct(prefix(level + 1)).alias("k"))
            parents = durable(nodes.where(F.col("n") > max_points).join(octants.where("k > 1"), "node", "left_semi").select("node"))
            told = nodes.join(parents.withColumn("split", F.lit(True)), "node", "left").select("node", "n", F.col("split").isNull().alias("leaf"))
        else:
            parents, told = nodes.limit(0).select("node"), nodes.select("node", "n", F.lit(True).alias("leaf"))
        rows_ = told.withColumn("level", F.lit(level))
        out = rows_ if out is None else out.unionByName(rows_)
        if level == depth or parents.isEmpty():
            break
        alive = durable(alive.join(parents.withColumnRenamed("node", "_node"), prefix(level) == F.col("_node"), "left_semi"))
    path = F.concat(*[F.when(F.col("level") > k, F.expr(f"cast(shiftright(node, 3 * (level - 1 - {k})) & 7 as string)")).otherwise("") for k in range(depth)]) if depth else F.lit("")
    sides = {}
    for shift, a in ((2, "x"), (1, "y"), (0, "z")):
        at = sum((F.when(F.col("level") > k, F.expr(f"(shiftright(node, 3 * (level - 1 - {k}) + {shift}) & 1) / pow(2.0, {k + 1})")).otherwise(0.0) for k in range(depth)), F.lit(0.0))
        lo, hi = float(b[f"lo_{a}"]), float(b[f"hi_{a}"])
        sides[f"min_{a}"] = F.lit(lo) + at * (hi - lo)
        sides[f"max_{a}"] = F.lit(lo) + (at + F.pow(F.lit(0.5), F.col("level"))) * (hi - lo)
    return out.withColumns(sides).select(path.alias("path"), F.col("level").cast("int"), "n", "leaf", *names)


def octree_counts(cloud: DataFrame, max_points: int, max_depth: int) -> DataFrame:
    """(path, level, n) of every node of ``octree``."""
    return octree(cloud, max_points, max_depth).select("path", "level", "n")


def geometric_error(level: Column) -> Column:
    """Of a node with min_/max_ columns: half its diagonal over 2^level, 20 levels at most."""
    diagonal = F.sqrt(sum((F.col(f"max_{a}") - F.col(f"min_{a}")) ** 2 for a in "xyz"))
    return diagonal * 0.5 / F.pow(F.lit(2.0), F.least(level, F.lit(20)))


def visible_tiles(nodes: DataFrame, camera: tuple, fov: float, height: float, threshold: float = 1.0) -> DataFrame:
    """The nodes of an ``octree`` to load for a camera: a node is reached if every node above
    it has a screen error of ``threshold`` pixels at least, and shown if its own is below or
    it is a leaf, and it has points. Reaching is a count of ancestors that qualify, by a join
    on path prefixes, so no walk from the root is needed."""
    from ..functions.geodesy import screen_space_error

    distance = F.sqrt(sum(((F.col(f"min_{a}") + F.col(f"max_{a}")) / 2 - c) ** 2 for a, c in zip("xyz", camera)))
    told = nodes.withColumn("sse", screen_space_error(geometric_error(F.col("level")), distance, fov, height))
    above = told.where((F.col("sse") >= threshold) & ~F.col("leaf")).select(F.col("path").alias("up"))
    stop = (F.col("sse") < threshold) | F.col("leaf")
    shown = told.where(stop & (F.col("n") > 0))
    ups = shown.select("path", F.explode(F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.struct(i.alias("i"), F.substring(F.col("path"), F.lit(1), i).alias("up")))).alias("u")).where(F.col("u.i") < F.length("path")).select("path", "u.up")
    reached = ups.join(above, "up").groupBy("path").agg(F.count(F.lit(1)).alias("k"))
    return shown.join(reached, "path", "left").where(F.coalesce("k", F.lit(0)) == F.length("path")).select("path", "level", "n", "sse")
