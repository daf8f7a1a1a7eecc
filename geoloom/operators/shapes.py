"""Lines, rings and elevation grids by windows and higher-order functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geodesy import R, haversine
from .durable import durable
from .points import _cells, _covered


def polyline_length(df: DataFrame, key: str) -> DataFrame:
    w = Window.partitionBy(key).orderBy("seq")
    d = haversine(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat"))
    return df.withColumn("d", d).groupBy(key).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("length"))


def track_stats(df: DataFrame, key: str) -> DataFrame:
    """Distance, ascent, descent and number of points of each track."""
    w = Window.partitionBy(key).orderBy("seq")
    d = haversine(F.lag("lng").over(w), F.lag("lat").over(w), F.col("lng"), F.col("lat"))
    up = F.col("ele") - F.lag("ele").over(w)
    rows = df.withColumns({"d": d, "up": up})
    return rows.groupBy(key).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("distance"), F.coalesce(F.sum(F.when(F.col("up") > 0, F.col("up"))), F.lit(0.0)).alias("ascent"),
                                 F.coalesce(F.sum(F.when(F.col("up") < 0, -F.col("up"))), F.lit(0.0)).alias("descent"), F.count(F.lit(1)).alias("n"))


def polygon_area(df: DataFrame, key: str) -> DataFrame:
    """Spherical area of closed rings, in square metres."""
    w = Window.partitionBy(key).orderBy("seq")
    lng, lat = F.lead("lng").over(w), F.lead("lat").over(w)
    part = (F.radians(lng) - F.radians("lng")) * (2 + F.sin(F.radians("lat")) + F.sin(F.radians(lat)))
    return df.withColumn("a", part).groupBy(key).agg((F.abs(F.sum("a")) / 2 * (R * R)).alias("area"))


def area_with_holes(df: DataFrame, key: str, ring: str) -> DataFrame:
    """The spherical area of ring 0 of each key less that of its other rings."""
    w = Window.partitionBy(key, ring).orderBy("seq")
    lng, lat = F.lead("lng").over(w), F.lead("lat").over(w)
    part = (F.radians(lng) - F.radians("lng")) * (2 + F.sin(F.radians("lat")) + F.sin(F.radians(lat)))
    each = df.withColumn("a", part).groupBy(key, ring).agg((F.abs(F.sum("a")) / 2 * (R * R)).alias("a"))
    return each.groupBy(key).agg(F.sum(F.when(F.col(ring) == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def points_in_rings(points: DataFrame, rings: DataFrame, cell: float = 10.0) -> DataFrame:
    """(geom_id, idx) of even-odd containment. Rings are arrays; a point meets only the rings
    whose bounds cover its cell, on the level that a ring's size asks for."""
    arr = rings.groupBy("geom_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lng", "lat"))), lambda v: F.struct(v["lng"].alias("x"), v["lat"].alias("y"))).alias("ring"),
                                       F.min("lng").alias("x0"), F.max("lng").alias("x1"), F.min("lat").alias("y0"), F.max("lat").alias("y1"))
    spread = durable(_covered(arr, cell).drop("w"))
    levels = [r["level"] for r in spread.select("level").distinct().collect()]  # one for each doubling of the ring size
    own = _cells(points, levels or [0], cell)
    near = own.join(spread, ["level", "cx", "cy"]).where(F.col("lng").between(F.col("x0"), F.col("x1")) & F.col("lat").between(F.col("y0"), F.col("y1")))
    return near.where(in_ring(F.col("lng"), F.col("lat"), F.col("ring"))).select("geom_id", "idx")


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    n = F.size(ring)

    def toggles(i: Column) -> Column:
        a, b = F.element_at(ring, i + 1), F.element_at(ring, F.when(i == 0, n).otherwise(i))
        return ((a["y"] > y) != (b["y"] > y)) & (x < (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"])

    # the division is only reached where the edge crosses, so its divisor is not 0
    safe = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (F.element_at(ring, i + 1)["y"] > y) != (F.element_at(ring, F.when(i == 0, n).otherwise(i))["y"] > y))
    return (n >= 3) & (F.size(F.filter(safe, toggles)) % 2 == 1)


def circle(lng: Column, lat: Column, metres: float, segments: int = 64) -> Column:
    """A closed n-gon about a point, as an array of points."""
    n = max(segments, 8)
    r_lat = math.degrees(metres / R)
    r_lng = F.degrees(F.lit(metres) / (F.cos(F.radians(lat)) * R))
    at = lambda i: (i % n) * (2 * math.pi / n)
    return F.transform(F.sequence(F.lit(0), F.lit(n)), lambda i: F.struct((lng + r_lng * F.cos(at(i))).alias("x"), (lat + F.sin(at(i)) * r_lat).alias("y")))


# ---------------------------------------------------------------- elevation grids (row, col, z)

#: Cells of a raster row or column that one window holds; a window's rim is copied to the next.
BLOCK = 256


def _beside(df: DataFrame, along: str, across: str, before: dict, after: dict) -> DataFrame:
    """``df`` with columns from the cells one before and one after in ``along``: names to
    their source columns. A window holds a block of a line and its rim, whatever the length of
    the line; a cell that isn't there gives null."""
    at = F.col(along)
    b = F.floor(at / BLOCK)
    own = F.array(b)
    rim = F.when(F.pmod(at, F.lit(BLOCK)) == 0, F.array(b, b - 1)).when(F.pmod(at, F.lit(BLOCK)) == BLOCK - 1, F.array(b, b + 1)).otherwise(own)
    rows = df.withColumn("_b", F.explode(rim))
    w = Window.partitionBy(across, "_b").orderBy(along)
    sides = {n: F.when(F.lag(along).over(w) == at - 1, F.lag(c).over(w)) for n, c in before.items()} | {n: F.when(F.lead(along).over(w) == at + 1, F.lead(c).over(w)) for n, c in after.items()}
    return rows.withColumns(sides).where(F.col("_b") == b).drop("_b")


def _neighbours(df: DataFrame) -> DataFrame:
    """Cells with those on their left, right, above and below; the cell itself beyond the rim."""
    out = _beside(df.select("row", "col", "z"), "col", "row", {"l": "z"}, {"r": "z"})
    out = _beside(out, "row", "col", {"u": "z"}, {"d": "z"})
    return out.withColumns({c: F.coalesce(c, "z") for c in "lrud"})


def hillshade(df: DataFrame, azimuth: float = 315.0, altitude: float = 45.0) -> DataFrame:
    """(row, col, shade 0..255): central differences, the edge repeated."""
    df = _neighbours(df)
    left, right, above, below = map(F.col, "lrud")
    zen, az = math.radians(90 - altitude), math.radians(450 - azimuth)
    dx, dy = (right - left) / 2, (below - above) / 2
    slope, aspect = F.atan(F.sqrt(dx * dx + dy * dy)), F.atan2(-dy, dx)
    shade = math.cos(zen) * F.cos(slope) + math.sin(zen) * F.sin(slope) * (math.cos(az) * F.cos(aspect) + math.sin(az) * F.sin(aspect))
    return df.select("row", "col", F.round(F.greatest(shade, F.lit(0.0)) * 255).cast("int").alias("shade"))


def terrain_normals(df: DataFrame) -> DataFrame:
    df = _neighbours(df)
    left, right, above, below = map(F.col, "lrud")
    nx, ny = (left - right) / 2, (above - below) / 2
    n = F.sqrt(nx * nx + ny * ny + 1)
    return df.select("row", "col", (nx / n).alias("nx"), (ny / n).alias("ny"), (1 / n).alias("nz"))


def contour_lines(df: DataFrame, interval: float) -> DataFrame:
    """(level, x1, y1, x2, y2) of marching squares at multiples of ``interval`` above the least."""
    rows = _beside(df.select("row", "col", "z"), "col", "row", {}, {"z10": "z"})
    rows = _beside(rows, "row", "col", {}, {"z01": "z", "z11": "z10"})
    rows = rows.where("z10 is not null and z01 is not null and z11 is not null").withColumnRenamed("z", "z00")
    least = df.agg(F.min("z").alias("lo"))
    first = F.floor(F.col("lo") / interval) + 1
    lo, hi = F.least("z00", "z10", "z01", "z11"), F.greatest("z00", "z10", "z01", "z11")
    k0 = F.greatest(F.ceil(lo / interval), first)
    rows = rows.crossJoin(F.broadcast(least)).withColumn("k0", k0).withColumn("k1", F.floor(hi / interval)).where("k0 <= k1")
    rows = rows.withColumn("k", F.explode(F.sequence("k0", "k1"))).withColumn("level", F.col("k") * F.lit(float(interval)))
    on = lambda z: F.when(F.col(z) >= F.col("level"), 1).otherwise(0)
    rows = rows.withColumn("case", on("z00") + on("z10") * 2 + on("z11") * 4 + on("z01") * 8)

    def cut(a, b, p):
        d = F.col(b) - F.col(a)
        return p + F.when(F.abs(d) < 1e-10, 0.5).otherwise((F.col("level") - F.col(a)) / F.nullif(d, F.lit(0.0)))

    x, y = F.col("col").cast("double"), F.col("row").cast("double")
    pt = lambda px, py: F.struct(px.alias("x"), py.alias("y"))
    bottom, top, left, right = pt(cut("z00", "z10", x), y), pt(cut("z01", "z11", x), y + 1), pt(x, cut("z00", "z01", y)), pt(x + 1, cut("z10", "z11", y))
    seg = lambda a, b: F.array(F.struct(a.alias("a"), b.alias("b")))
    c = F.col("case")
    lines = (F.when(c.isin(1, 14), seg(bottom, left)).when(c.isin(2, 13), seg(bottom, right)).when(c.isin(3, 12), seg(left, right)).when(c.isin(4, 11), seg(right, top))
             .when(c == 5, F.concat(seg(bottom, left), seg(right, top))).when(c.isin(6, 9), seg(bottom, top)).when(c.isin(7, 8), seg(left, top)).when(c == 10, F.concat(seg(bottom, right), seg(left, top))))
    return rows.where(~c.isin(0, 15)).select("level", F.explode(lines).alias("s")).select("level", F.col("s.a.x").alias("x1"), F.col("s.a.y").alias("y1"), F.col("s.b.x").alias("x2"), F.col("s.b.y").alias("y2"))
