"""Queries over hulls, lines, triangles, rings, segments and neighbours, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.geodesy import R
from ..operators import planar, points, shapes
from . import fixtures
from .catalogue import _add, _round, _src
from .texts import _rings


def _lines(s, d):
    """The tracks in blocks of 16 positions that follow each other: many small groups."""
    t = fixtures.spark(s, d, "tracks")
    return t.select((F.col("track_id") * 100000 + F.floor((F.col("seq") - 1) / 16)).alias("grp"), "seq", F.col("lng").alias("x"), F.col("lat").alias("y"), F.col("ele").alias("z"))


_L = f"(SELECT track_id * 100000 + (seq - 1) // 16 AS grp, seq, lng AS x, lat AS y, ele AS z FROM {_src('tracks')})"
_CROSS = "((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))"
_HULL = f"""SELECT a.grp, a.x, a.y FROM {{p}} a JOIN {{p}} b ON a.grp = b.grp AND (a.x <> b.x OR a.y <> b.y) JOIN {{p}} c ON c.grp = a.grp
GROUP BY a.grp, a.x, a.y, b.x, b.y HAVING min({_CROSS}) >= 0 AND min(CASE WHEN {_CROSS} = 0 THEN (c.x-a.x)*(b.x-a.x)+(c.y-a.y)*(b.y-a.y) ELSE 0 END) >= 0"""
# on whole numbers, on which positions in a row are so exactly
_WHOLE = ["CAST(round((x - 116) * 997) AS DOUBLE) AS x", "CAST(round((y - 39) * 997) AS DOUBLE) AS y"]
_add("convex_hull", lambda s, d: planar.convex_hull(_lines(s, d).selectExpr("grp", *_WHOLE), "grp").where("seq > 0").select("grp", "x", "y"),
     f"SELECT DISTINCT * FROM (WITH p AS (SELECT DISTINCT grp, {', '.join(_WHOLE)} FROM {_L} l) " + _HULL.format(p="p") + " UNION ALL SELECT grp, min(x), min(y) FROM p GROUP BY grp HAVING count(*) = 1) h")
_add("concave_hull", lambda s, d: _round(planar.concave_hull(_lines(s, d), "grp", 0.5), 6, ("grp", "seq")))


def _buffers(s, d):
    t = _lines(s, d).select("grp", F.col("x").alias("lng"), F.col("y").alias("lat"))
    return _round(planar.buffer_line(t, "grp", 1000.0, 8).groupBy("grp").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")), 6, ("grp",))


_DX = "degrees(1000/(6371000*cos(radians(y))))"
_add("buffer_line", _buffers, f"SELECT grp, round(min(x-{_DX}),6) AS x0, round(max(x+{_DX}),6) AS x1, round(min(y)-degrees(1000/6371000e0),6) AS y0, round(max(y)+degrees(1000/6371000e0),6) AS y1 FROM {_L} l GROUP BY grp")
_add("simplify", lambda s, d: planar.simplify(_lines(s, d).select("grp", "seq", "x", "y"), "grp", "seq", 0.2).select("grp", "seq"), f"""WITH RECURSIVE p AS (SELECT * FROM {_L} l),
run AS (SELECT grp, min(seq) AS a, max(seq) AS b FROM p GROUP BY grp
 UNION ALL SELECT grp, unnest([a, m]) AS a, unnest([m, b]) AS b FROM (SELECT r.grp, r.a, r.b, arg_max(p.seq, (d2, -p.seq)) AS m, max(d2) AS d FROM (SELECT r.grp, r.a, r.b, p.seq,
  round(CASE WHEN n > 0 THEN power(p.x-(a.x+t*dx),2)+power(p.y-(a.y+t*dy),2) ELSE power(p.x-a.x,2)+power(p.y-a.y,2) END, 12) AS d2 FROM run r JOIN (SELECT grp, seq, x, y FROM p) a ON a.grp = r.grp AND a.seq = r.a JOIN (SELECT grp, seq, x, y FROM p) b ON b.grp = r.grp AND b.seq = r.b,
  LATERAL (SELECT b.x-a.x AS dx, b.y-a.y AS dy, power(b.x-a.x,2)+power(b.y-a.y,2) AS n) e JOIN p ON p.grp = r.grp AND p.seq > r.a AND p.seq < r.b, LATERAL (SELECT CASE WHEN n > 0 THEN least(greatest(((p.x-a.x)*dx+(p.y-a.y)*dy)/n,0e0),1e0) ELSE 0 END AS t) f) q
  JOIN run r USING (grp, a, b) JOIN p ON p.grp = r.grp AND p.seq = q.seq GROUP BY r.grp, r.a, r.b) z WHERE d > 0.04e0)
SELECT DISTINCT grp, unnest([a, b]) AS seq FROM run""")

# ---------------------------------------------------------------- triangles
_CIRCLE = "((a.x-p.x)*((b.y-p.y)*(power(c.x-p.x,2)+power(c.y-p.y,2))-(c.y-p.y)*(power(b.x-p.x,2)+power(b.y-p.y,2)))-(a.y-p.y)*((b.x-p.x)*(power(c.x-p.x,2)+power(c.y-p.y,2))-(c.x-p.x)*(power(b.x-p.x,2)+power(b.y-p.y,2)))+(power(a.x-p.x,2)+power(a.y-p.y,2))*((b.x-p.x)*(c.y-p.y)-(c.x-p.x)*(b.y-p.y)))"
_TIN = f"""SELECT a.grp, a.seq AS a, b.seq AS b, c.seq AS c FROM p a JOIN p b ON b.grp = a.grp AND b.seq > a.seq JOIN p c ON c.grp = a.grp AND c.seq > b.seq AND abs({_CROSS}) > 1e-12 LEFT JOIN p ON p.grp = a.grp AND p.seq NOT IN (a.seq, b.seq, c.seq)
GROUP BY ALL HAVING coalesce(max(sign({_CROSS})*{_CIRCLE}), -1) <= 0"""
_FIRST = f"p AS (SELECT grp, min(seq) AS seq, x, y, arg_min(z, seq) AS z FROM {_L} l GROUP BY grp, x, y)"
_add("tin", lambda s, d: planar.tin(_lines(s, d), "grp", "seq"), f"WITH {_FIRST} {_TIN}")


def _interpolated(s, d):
    l = _lines(s, d)
    q = l.groupBy("grp").agg(F.avg("x").alias("qx"), F.avg("y").alias("qy")).withColumn("qid", F.lit(0))
    first = l.groupBy("grp", "x", "y").agg(F.min("seq").alias("seq"), F.min_by("z", "seq").alias("z"))
    return _round(planar.tin_interpolate(planar.tin(l, "grp", "seq"), first, q, "grp", "seq").select("grp", "z"), 6, ("grp",))


_add("tin_interpolate", _interpolated, f"""WITH {_FIRST}, t AS ({_TIN}), q AS (SELECT grp, avg(x) AS qx, avg(y) AS qy FROM {_L} l GROUP BY grp),
h AS (SELECT t.grp, t.a, t.b, t.c, a.z AS za, b.z AS zb, c.z AS zc, ((b.y-c.y)*(qx-c.x)+(c.x-b.x)*(qy-c.y))/((b.y-c.y)*(a.x-c.x)+(c.x-b.x)*(a.y-c.y)) AS u, ((c.y-a.y)*(qx-c.x)+(a.x-c.x)*(qy-c.y))/((b.y-c.y)*(a.x-c.x)+(c.x-b.x)*(a.y-c.y)) AS v
 FROM t JOIN q USING (grp) JOIN p a ON a.grp = t.grp AND a.seq = t.a JOIN p b ON b.grp = t.grp AND b.seq = t.b JOIN p c ON c.grp = t.grp AND c.seq = t.c),
i AS (SELECT grp, arg_min(u*za+v*zb+(1-u-v)*zc, (a, b, c)) AS z FROM h WHERE u >= -1e-10 AND v >= -1e-10 AND u+v <= 1+1e-10 GROUP BY grp),
n AS (SELECT q.grp, arg_min(p.z, (power(p.x-qx,2)+power(p.y-qy,2), p.seq)) AS z FROM q JOIN p USING (grp) GROUP BY q.grp)
SELECT n.grp, round(coalesce(i.z, n.z),6)+0.0 AS z FROM n LEFT JOIN i USING (grp)""")

# ---------------------------------------------------------------- rings



def _with_holes(s, d):
    """Each ring with a hole, the ring drawn in to half its size about its centre."""
    r = fixtures.spark(s, d, "rings")
    c = r.where("seq < 12").groupBy("geom_id").agg(F.avg("lng").alias("cx"), F.avg("lat").alias("cy"))
    hole = r.join(c, "geom_id").select("geom_id", "seq", ((F.col("lng") + F.col("cx")) / 2).alias("lng"), ((F.col("lat") + F.col("cy")) / 2).alias("lat"), F.lit(1).alias("ring"))
    return _round(shapes.area_with_holes(r.withColumn("ring", F.lit(0)).unionByName(hole), "geom_id", "ring"), 0, ("geom_id",))


_AREA = "abs(sum((radians(nx)-radians(lng))*(2+sin(radians(lat))+sin(radians(ny)))))/2*6371000*6371000"
_add("area_with_holes", _with_holes, f"""WITH r AS (SELECT * FROM {_src('rings')}), c AS (SELECT geom_id, avg(lng) AS cx, avg(lat) AS cy FROM r WHERE seq < 12 GROUP BY geom_id),
u AS (SELECT geom_id, 0 AS ring, seq, lng, lat FROM r UNION ALL SELECT geom_id, 1, seq, (lng+cx)/2, (lat+cy)/2 FROM r JOIN c USING (geom_id)),
a AS (SELECT geom_id, ring, {_AREA} AS a FROM (SELECT *, lead(lng) OVER w AS nx, lead(lat) OVER w AS ny FROM u WINDOW w AS (PARTITION BY geom_id, ring ORDER BY seq)) t GROUP BY 1, 2)
SELECT geom_id, round(sum(CASE WHEN ring = 0 THEN a ELSE -a END),0)+0.0 AS area FROM a GROUP BY geom_id""")


def _squares(s, d):
    """A box about every order's point, and the one a step to the right and up of it."""
    p = fixtures.spark(s, d, "china").select("idx", (1 + F.col("idx") % 5).cast("double").alias("a"), (F.col("idx") % 7).cast("double").alias("dx"), (F.col("idx") % 4).cast("double").alias("dy"))
    box = lambda x0, y0, w: F.array(*(F.struct((x0 + w * i).alias("x"), (y0 + w * j).alias("y")) for i, j in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))))
    return p.select("idx", box(F.lit(0.0), F.lit(0.0), F.col("a")).alias("s"), box(F.col("dx"), F.col("dy"), F.lit(2.0)).alias("t"))


_SQUARE = f"(SELECT idx, CAST(1 + idx % 5 AS DOUBLE) AS a, CAST(idx % 7 AS DOUBLE) AS dx, CAST(idx % 4 AS DOUBLE) AS dy FROM {_src('china')})"
_W, _H = "(least(a, dx+2)-dx)", "(least(a, dy+2)-dy)"
_add("polygon_relate", lambda s, d: _squares(s, d).select("idx", planar.relate(F.col("s"), F.col("t")).alias("r")).select("idx", "r.*"),
     f"SELECT idx, {_W} >= 0 AND {_H} >= 0 AS intersects, least({_W}, {_H}) = 0 AS touches, NOT ({_W} >= 0 AND {_H} >= 0) AS disjoint FROM {_SQUARE} q")


def _ring_area(ring):
    """Twice the signed area of a closed ring of x, y."""
    return F.aggregate(F.sequence(F.lit(1), F.size(ring) - 1), F.lit(0.0), lambda t, i: t + F.element_at(ring, i)["x"] * F.element_at(ring, i + 1)["y"] - F.element_at(ring, i + 1)["x"] * F.element_at(ring, i)["y"])


def _overlaid(union):
    def run(s, d):
        o = _squares(s, d).select("idx", planar.overlaid(F.col("s"), F.col("t"), union).alias("rings"))
        total = F.aggregate("rings", F.lit(0.0), lambda t, r: t + _ring_area(r))
        return _round(o.select("idx", (total / 2).alias("area")), 6)
    return run


_BOTH = f"(CASE WHEN {_W} > 0 AND {_H} > 0 THEN {_W}*{_H} ELSE 0 END)"
_add("polygon_intersection", _overlaid(False), f"SELECT idx, round({_BOTH},6)+0.0 AS area FROM {_SQUARE} q")
_add("polygon_union", _overlaid(True), f"SELECT idx, round(a*a+4-{_BOTH},6)+0.0 AS area FROM {_SQUARE} q")


def _held(s, d):
    p = _squares(s, d)
    return p.select("idx", planar.holds(F.col("s"), F.col("t")[0]["x"], F.col("t")[0]["y"]).alias("held"))


_add("polygon_contains", _held, f"SELECT idx, dx > 0 AND dx < a AND dy > 0 AND dy < a AS held FROM {_SQUARE} q")

# ---------------------------------------------------------------- segments and neighbours
_SEG = f"(SELECT idx AS id, lng AS x1, lat AS y1, lng+CAST(1+idx%7 AS DOUBLE)/CAST(7 AS DOUBLE) AS x2, lat+CAST(1+idx%11 AS DOUBLE)/CAST(11 AS DOUBLE) AS y2 FROM {_src('china')})"


def _segments(s, d):
    p = fixtures.spark(s, d, "china")
    return p.select(F.col("idx").alias("id"), F.col("lng").alias("x1"), F.col("lat").alias("y1"), (F.col("lng") + (1 + F.col("idx") % 7).cast("double") / 7.0).alias("x2"), (F.col("lat") + (1 + F.col("idx") % 11).cast("double") / 11.0).alias("y2"))


def _edge_boxes(within):
    def run(s, d):
        p = fixtures.spark(s, d, "china").where("idx % 100 = 0")
        return planar.segments_in_boxes(_segments(s, d), p.select(F.col("idx").alias("box"), (F.col("lng") - 1.5).alias("x0"), (F.col("lat") - 1.5).alias("y0"), (F.col("lng") + 1.5).alias("x1"), (F.col("lat") + 1.5).alias("y1")), 1.0, within)
    return run


_EDGE = f"WITH s AS (SELECT * FROM {_SEG} g), q AS (SELECT idx AS box, lng-1.5e0 AS bx0, lat-1.5e0 AS by0, lng+1.5e0 AS bx1, lat+1.5e0 AS by1 FROM {_src('china')} WHERE idx % 100 = 0) SELECT box, id FROM s JOIN q ON "
_add("edge_bbox", _edge_boxes(True), _EDGE + "x1 >= bx0 AND x2 <= bx1 AND y1 >= by0 AND y2 <= by1")
_add("edge_bbox_meets", _edge_boxes(False), _EDGE + "x2 >= bx0 AND x1 <= bx1 AND y2 >= by0 AND y1 <= by1")


def _edge_nearest(s, d):
    q = fixtures.spark(s, d, "china").where("idx % 100 = 0").select(F.col("idx").alias("qid"), (F.col("lng") + 0.37).alias("qx"), (F.col("lat") - 0.21).alias("qy"))
    return planar.nearest_segment(_segments(s, d), q, 0.5).select("qid", F.round("d2", 9).alias("d2"))


_add("edge_nearest", _edge_nearest, f"""WITH s AS (SELECT * FROM {_SEG} g), q AS (SELECT idx AS qid, lng+0.37e0 AS qx, lat-0.21e0 AS qy FROM {_src('china')} WHERE idx % 100 = 0)
SELECT qid, round(min(power(qx-(x1+t*(x2-x1)),2)+power(qy-(y1+t*(y2-y1)),2)),9) AS d2 FROM (SELECT qid, qx, qy, x1, y1, x2, y2, least(greatest(((qx-x1)*(x2-x1)+(qy-y1)*(y2-y1))/(power(x2-x1,2)+power(y2-y1,2)),0e0),1e0) AS t FROM s, q) z GROUP BY qid""")
_add("point_spacing", lambda s, d: _round(points.nearest_spacing(fixtures.spark(s, d, "china")), 6, ()),
     f"WITH p AS (SELECT * FROM {_src('china')}) SELECT round(avg(sqrt(d2)),6)+0.0 AS spacing FROM (SELECT a.idx, min(power(a.lng-b.lng,2)+power(a.lat-b.lat,2)) AS d2 FROM p a JOIN p b ON a.idx <> b.idx GROUP BY a.idx) t")
_add("estimate_normals", lambda s, d: _round(planar.normals(fixtures.spark(s, d, "cloud").select("idx", *"xyz"), 8), 6))
