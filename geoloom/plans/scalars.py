"""More queries over points, clouds and coordinates, with their SQL."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import crs, geodesy, limits
from ..operators import points, shapes
from . import fixtures
from .catalogue import _BX, _BY, _add, _ENDS, _G, _SQ, _bd, _gh_sql, _merc, _nested, _prev, _round, _src  # noqa: F401

_nested("crs_bd09_mercator", lambda x, y: crs.to_mercator(*crs.wgs84_to_bd09(x, y)), _G, _merc(*_bd("lng", "lat")), 3)
_add("crs_normalize", lambda s, d: _round(points.normalize(fixtures.spark(s, d, "geo"), "lng", "lat"), 9), f"WITH p AS (SELECT * FROM {_src('geo')}), b AS (SELECT min(lng) AS x0, max(lng) AS x1, min(lat) AS y0, max(lat) AS y1 FROM p) SELECT idx, round((lng-x0)/(x1-x0),9)+0.0 AS lng, round((lat-y0)/(y1-y0),9)+0.0 AS lat FROM p, b")


def _denormalize(s, d):
    unit = points.normalize(fixtures.spark(s, d, "geo"), "lng", "lat")
    return _round(points.denormalize(unit, lng=(100.0, 110.0), lat=(20.0, 20.0)), 6)


_add("crs_denormalize", _denormalize, f"WITH p AS (SELECT * FROM {_src('geo')}), b AS (SELECT min(lng) AS x0, max(lng) AS x1 FROM p) SELECT idx, round((lng-x0)/(x1-x0)*10+100,6)+0.0 AS lng, 20.0e0 AS lat FROM p, b")
_add("crs_supported", lambda s, d: crs.supported(s).select("code", "name", "unit"),
     "SELECT * FROM (VALUES ('EPSG:4326', 'WGS 84', 'degree'), ('EPSG:3857', 'Web Mercator', 'meter'), ('EPSG:4490', 'CGCS2000', 'degree'), ('GCJ-02', 'GCJ-02 (Mars)', 'degree'), ('BD-09', 'BD-09', 'degree')) t(code, name, unit)")


def _regions(s, d):
    p = fixtures.spark(s, d, "geo")
    w = (F.col("idx") % 13).cast("double")
    return p.select("idx", crs.best_region(F.col("lng"), F.col("lat"), F.col("lng") + w, F.col("lat") + w / 2).alias("code"))


_add("crs_best_region", _regions, f"SELECT idx, CASE WHEN lng + w / 2 BETWEEN 73.66e0 AND 135.05e0 AND lat + w / 4 BETWEEN 3.86e0 AND 53.55e0 THEN 'GCJ-02' WHEN lng + w - lng > 10 OR lat + w / 2 - lat > 10 THEN 'EPSG:3857' ELSE 'EPSG:4326' END AS code FROM (SELECT *, CAST(idx % 13 AS DOUBLE) AS w FROM {_src('geo')}) t")

# ---------------------------------------------------------------- geodesy
_PAIR = "(SELECT idx, lng AS x1, lat AS y1, lng + 0.5e0 + (idx % 7) / 7e0 AS x2, lat + (idx % 11) / 11e0 AS y2 FROM {s}) p"


def _vincenty(s, d):
    p = fixtures.spark(s, d, "china")
    return _round(p.select("idx", geodesy.vincenty(F.col("lng"), F.col("lat"), F.col("lng") + 0.5 + (F.col("idx") % 7) / F.lit(7.0), F.col("lat") + (F.col("idx") % 11) / F.lit(11.0)).alias("metres")), 3)


_add("geo_vincenty", _vincenty, f"""WITH RECURSIVE k AS (SELECT 6378137e0 AS a, 1/298.257223563e0 AS f, 6378137e0*(1-1/298.257223563e0) AS b),
p AS (SELECT idx, atan((1-f)*tan(radians(y1))) AS u1, atan((1-f)*tan(radians(y2))) AS u2, radians(x2-x1) AS l FROM {_PAIR.format(s=_src('china'))}, k),
it AS (SELECT idx, u1, u2, l, l AS lam, 0 AS n, 1e0 AS step, 0e0 AS ss, 0e0 AS cs, 0e0 AS ca, 0e0 AS cm FROM p
 UNION ALL
 SELECT idx, u1, u2, l, l + (1-c)*f*sa*(atan2(ss,cs)+c*ss*(cm+c*cs*(2*cm*cm-1))), n+1, abs(l + (1-c)*f*sa*(atan2(ss,cs)+c*ss*(cm+c*cs*(2*cm*cm-1))) - lam), ss, cs, ca, cm
 FROM (SELECT *, f/16*ca*(4+f*(4-3*ca)) AS c FROM (SELECT *, CASE WHEN abs(ca) < 1e-15 THEN 0 ELSE cs-2*sin(u1)*sin(u2)/ca END AS cm FROM (SELECT *, 1-sa*sa AS ca FROM
  (SELECT *, cos(u1)*cos(u2)*sin(lam)/ss AS sa FROM (SELECT idx, u1, u2, l, lam, n, f, sqrt(power(cos(u2)*sin(lam),2)+power(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(lam),2)) AS ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(lam) AS cs FROM it, k WHERE step >= 1e-12 AND n < 200) q1) q2) q3) q4) q5)
SELECT idx, round(b*ka*(atan2(ss,cs)-kb*ss*(cm+kb/4*(cs*(2*cm*cm-1)-kb/6*cm*(4*ss*ss-3)*(4*cm*cm-3)))),3)+0.0 AS metres FROM
(SELECT *, 1+uu/16384*(4096+uu*(-768+uu*(320-175*uu))) AS ka, uu/1024*(256+uu*(-128+uu*(74-47*uu))) AS kb FROM (SELECT it.*, b, ca*(a*a-b*b)/(b*b) AS uu FROM it, k WHERE n > 0 AND step < 1e-12) r) r2""")


def _gh_near(s, d):
    p = fixtures.spark(s, d, "geo").select("idx", geodesy.geohash(F.col("lng"), F.col("lat"), 5).alias("hash"))
    return geodesy.geohash_neighbors(p, "hash", 5).drop("hash")


def _gh_near_sql() -> str:
    n, nx, ny = 5, 13, 12
    w, h = 360.0 / 2 ** nx, 180.0 / 2 ** ny
    cx, cy = f"((floor((x0+180)/360*{2**nx})+0.5)*{w!r}e0-180)", f"((floor((y0+90)/180*{2**ny})+0.5)*{h!r}e0-90)"
    out = []
    for k, (x, y) in {"n": (0, 1), "ne": (1, 1), "e": (1, 0), "se": (1, -1), "s": (0, -1), "sw": (-1, -1), "w": (-1, 0), "nw": (-1, 1)}.items():
        px, py = f"({cx}+{x}*({w / 2!r}e0+1e-10))", f"({cy}+{y}*({h / 2!r}e0+1e-10))"
        out.append(f"(SELECT {_gh_sql(n)} FROM (SELECT {px} AS lng, {py} AS lat) z) AS {k}")
    return f"SELECT idx, {', '.join(out)} FROM (SELECT idx, lng AS x0, lat AS y0 FROM {_src('geo')}) t"


_add("geohash_neighbors", _gh_near, _gh_near_sql())
_add("segment_distance", lambda s, d: _round(_prev(s, d).select("idx", geodesy.segment_distance_sq(F.lit(10.0), F.lit(20.0), *map(F.col, _ENDS)).alias("d2")), 6),
     f"SELECT idx, round(power(10-(x1+t*dx),2)+power(20-(y1+t*dy),2),6)+0.0 AS d2 FROM (SELECT *, least(greatest(((10-x1)*dx+(20-y1)*dy)/(dx*dx+dy*dy),0e0),1e0) AS t FROM (SELECT *, x2-x1 AS dx, y2-y1 AS dy FROM {_SQ}) q) q2")


def _unit(s, d):
    c = fixtures.spark(s, d, "cloud")
    v = {"x": F.col("x") - 25.3, "y": F.col("y") - 5.1, "z": F.col("z") - 40.7}
    n = F.sqrt(sum(e * e for e in v.values()))
    return c.select("idx", *((e / n).alias(a) for a, e in v.items()))


_UNIT = f"(SELECT idx, (x-25.3e0)/n AS x, (y-5.1e0)/n AS y, (z-40.7e0)/n AS z FROM (SELECT *, sqrt(power(x-25.3e0,2)+power(y-5.1e0,2)+power(z-40.7e0,2)) AS n FROM {_src('cloud')}) t)"
_OCT = f"""(SELECT idx, CAST(round(least(greatest(fx*0.5e0+0.5e0,0e0),0.99999e0)*255)*256+round(least(greatest(fy*0.5e0+0.5e0,0e0),0.99999e0)*255) AS INT) AS code FROM
(SELECT idx, CASE WHEN z<0 THEN (1-abs(oy))*(CASE WHEN ox>=0 THEN 1 ELSE -1 END) ELSE ox END AS fx, CASE WHEN z<0 THEN (1-abs(ox))*(CASE WHEN oy>=0 THEN 1 ELSE -1 END) ELSE oy END AS fy FROM
(SELECT idx, z, x/(abs(x)+abs(y)+greatest(abs(z),1e-10)) AS ox, y/(abs(x)+abs(y)+greatest(abs(z),1e-10)) AS oy FROM {_UNIT} u) o) f)"""
_add("oct16_encode", lambda s, d: _unit(s, d).select("idx", geodesy.oct16(*map(F.col, "xyz")).alias("code")), f"SELECT * FROM {_OCT} e")


def _oct_back(s, d):
    e = _unit(s, d).select("idx", geodesy.oct16(*map(F.col, "xyz")).alias("code"))
    return _round(e.select("idx", *(c.alias(a) for a, c in zip("xyz", geodesy.oct16_decode(F.col("code"))))), 6)


_add("oct16_decode", _oct_back, f"""SELECT idx, round(ux/n,6)+0.0 AS x, round(uy/n,6)+0.0 AS y, round(z/n,6)+0.0 AS z FROM (SELECT *, sqrt(ux*ux+uy*uy+z*z) AS n FROM
(SELECT idx, z, CASE WHEN z<0 THEN (1-abs(b))*(CASE WHEN a<-1e-10 THEN -1 ELSE 1 END) ELSE a END AS ux, CASE WHEN z<0 THEN (1-abs(a))*(CASE WHEN b<-1e-10 THEN -1 ELSE 1 END) ELSE b END AS uy FROM
(SELECT idx, a, b, 1-abs(a)-abs(b) AS z FROM (SELECT idx, (code >> 8)/255e0*2-1 AS a, (code & 255)/255e0*2-1 AS b FROM {_OCT} e) t) t2) t3) t4""")
_add("rhumb_true", lambda s, d: _round(_prev(s, d).select("idx", geodesy.rhumb_distance(*map(F.col, _ENDS), compat=False).alias("v")), 3),
     f"""SELECT idx, round(6371000*sqrt(dp*dp+power((CASE WHEN abs(psi)<1e-12 THEN cos((radians(y1)+radians(y2))/2) ELSE abs(dp)/abs(psi) END)*turn,2)),3)+0.0 AS v FROM
(SELECT *, radians(y2)-radians(y1) AS dp, ln(tan(radians(y2)/2+pi()/4))-ln(tan(radians(y1)/2+pi()/4)) AS psi, radians(x2-x1)+pi()-2*pi()*floor((radians(x2-x1)+pi())/(2*pi()))-pi() AS turn FROM {_SQ}) q""")

# ---------------------------------------------------------------- clouds
_add("translate", lambda s, d: _round(points.translate(fixtures.spark(s, d, "cloud"), 1.5, -2.0, 100.0).select("idx", *"xyz"), 6), f"SELECT idx, round(x+1.5e0,6)+0.0 AS x, round(y-2,6)+0.0 AS y, round(z+100,6)+0.0 AS z FROM {_src('cloud')}")
_add("scale", lambda s, d: _round(points.scale(fixtures.spark(s, d, "cloud"), 2.0, 0.5, -1.0).select("idx", *"xyz"), 6), f"SELECT idx, round(x*2,6)+0.0 AS x, round(y*0.5e0,6)+0.0 AS y, round(-z,6)+0.0 AS z FROM {_src('cloud')}")
_add("cloud_centroid", lambda s, d: _round(points.centroid(fixtures.spark(s, d, "cloud"), *"xyz"), 5, ()), f"SELECT round(avg(x),5)+0.0 AS c_x, round(avg(y),5)+0.0 AS c_y, round(avg(z),5)+0.0 AS c_z FROM {_src('cloud')}")
_add("cloud_colour_means", lambda s, d: _round(fixtures.spark(s, d, "cloud").agg(*(F.avg(c).alias(f"avg_{c}") for c in "rgb")), 6, ()), f"SELECT round(avg(r),6)+0.0 AS avg_r, round(avg(g),6)+0.0 AS avg_g, round(avg(b),6)+0.0 AS avg_b FROM {_src('cloud')}")
_add("bounds_multi", lambda s, d: points.bounds_multi(fixtures.spark(s, d, "geo").select("lng", "lat").unionAll(fixtures.spark(s, d, "china").select("lng", "lat")), "lng", "lat"),
     f"SELECT min(lng) AS min_lng, max(lng) AS max_lng, min(lat) AS min_lat, max(lat) AS max_lat FROM (SELECT lng, lat FROM {_src('geo')} UNION ALL SELECT lng, lat FROM {_src('china')}) t")
_add("clean_snap", lambda s, d: points.clean(fixtures.spark(s, d, "geo").withColumn("lng", F.when(F.col("idx") % 5 == 0, float("nan")).otherwise(F.col("lng"))), "snap", "china"),
     f"SELECT idx, CASE WHEN idx % 5 = 0 THEN 73.66e0 ELSE least(greatest(lng,73.66e0),135.05e0) END AS lng, least(greatest(lat,3.86e0),53.55e0) AS lat FROM {_src('geo')}")
_add("invalid_indices", lambda s, d: fixtures.spark(s, d, "geo").where(~points.valid(F.col("lng"), F.col("lat"), "china")).select("idx"), f"SELECT idx FROM {_src('geo')} WHERE NOT (lng BETWEEN 73.66e0 AND 135.05e0 AND lat BETWEEN 3.86e0 AND 53.55e0)")
_add("finite_positions", lambda s, d: fixtures.spark(s, d, "cloud").withColumn("x", F.when(F.col("idx") % 9 == 0, float("inf")).otherwise(F.col("x"))).where(points.finite(F.col("x"))).select("idx"), f"SELECT idx FROM {_src('cloud')} WHERE idx % 9 <> 0")
for _axis in ("lng", "lat"):
    _add(f"sort_{_axis}", lambda s, d, a=_axis: points.ranked(fixtures.spark(s, d, "geo"), a, "idx").select("idx", "rank"), f"SELECT idx, row_number() OVER (ORDER BY {_axis}, idx) - 1 AS rank FROM {_src('geo')}")


def _dequantize(s, d):
    q = points.quantize(fixtures.spark(s, d, "cloud"))
    out = points.dequantize(q, (0.0, 0.0, 0.0), (100.0, 10.0, 1.0))
    return _round(out.select("idx", *(F.col(a).cast("double").alias(a) for a in "xyz")), 3)


_Q = lambda a: f"CAST(least(floor(CAST(CAST(CAST(CAST({a} AS REAL)-l{a} AS REAL)/CAST(h{a}-l{a} AS REAL) AS REAL)*CAST(65535 AS REAL) AS REAL)),65535) AS INT) AS q{a}"
_DQ = lambda a, hi: f"round(CAST(CAST(CAST(q{a} AS REAL)/CAST(65535 AS REAL) AS REAL)*CAST({hi} AS REAL) AS REAL)::DOUBLE,3)+0.0 AS {a}"
_add("dequantize", _dequantize, f"WITH p AS (SELECT * FROM {_src('cloud')}), b AS (SELECT {', '.join(f'min(CAST({a} AS REAL)) AS l{a}, max(CAST({a} AS REAL)) AS h{a}' for a in 'xyz')} FROM p), q AS (SELECT idx, {', '.join(map(_Q, 'xyz'))} FROM p, b) SELECT idx, {_DQ('x', 100)}, {_DQ('y', 10)}, {_DQ('z', 1)} FROM q")


def _flip(s, d):
    c = fixtures.spark(s, d, "cloud").select("idx", *"xyz", F.lit(0.6).alias("nx"), F.lit(0.0).alias("ny"), F.lit(0.8).alias("nz"))
    return points.flip_normals(c).select("idx", "nx", "nz")


_add("flip_normals", _flip, f"WITH p AS (SELECT * FROM {_src('cloud')}), c AS (SELECT avg(x) AS cx, avg(z) AS cz FROM p) SELECT idx, CASE WHEN 0.6e0*(x-cx)+0.8e0*(z-cz) < 0 THEN -0.6e0 ELSE 0.6e0 END AS nx, CASE WHEN 0.6e0*(x-cx)+0.8e0*(z-cz) < 0 THEN -0.8e0 ELSE 0.8e0 END AS nz FROM p, c")
_add("auto_decimate", lambda s, d: points.auto_voxel(fixtures.spark(s, d, "cloud"), 1000).select("idx"),
     f"WITH p AS (SELECT * FROM {_src('cloud')}), k AS (SELECT CAST(power(greatest(max(x)-min(x),0.001e0)*greatest(max(y)-min(y),0.001e0)*greatest(max(z)-min(z),0.001e0)/1000, 1/3e0) AS REAL) AS c FROM p) SELECT min(idx) AS idx FROM p, k GROUP BY floor(CAST(x AS REAL)/c), floor(CAST(y AS REAL)/c), floor(CAST(z AS REAL)/c)")


def _random(s, d):
    return points.decimate_random(fixtures.spark(s, d, "cloud"), 500).select("idx", "place")


_add("decimate_random", _random, f"""WITH RECURSIVE n AS (SELECT count(*) AS n FROM {_src('cloud')}),
r AS (SELECT 0 AS place, (CAST(12345 AS BIGINT)*1103515245+12345) & 2147483647 AS seed UNION ALL SELECT place+1, (seed*1103515245+12345) & 2147483647 FROM r WHERE place+1 < 500),
j AS (SELECT place, place + CAST(floor(seed/2147483647e0*(n-place)) AS BIGINT) AS j FROM r, n),
w AS (SELECT place, j AS spot, place AS step FROM j UNION ALL SELECT w.place, l.place, l.place FROM w JOIN LATERAL (SELECT max(place) AS place FROM j WHERE j.j = w.spot AND j.place < w.step) l ON l.place IS NOT NULL)
SELECT arg_min(spot, step) AS idx, place FROM w GROUP BY place""")

# ---------------------------------------------------------------- colours
_T = "least(greatest((z-10)/80,0e0),1e0)"


def _heights(s, d):
    c = geodesy.height_colour(F.col("z"), 10.0, 90.0, (0, 64, 255), (255, 128, 0))
    return _round(fixtures.spark(s, d, "cloud").select("idx", *(v.alias(n) for n, v in zip("rgba", c))), 6)


_add("colorize_height", _heights, f"SELECT idx, round({_T}*255/255e0,6)+0.0 AS r, round((64+{_T}*64)/255e0,6)+0.0 AS g, round((255-{_T}*255)/255e0,6)+0.0 AS b, 1.0e0 AS a FROM {_src('cloud')}")


def _intensities(s, d):
    i = F.when(F.col("idx") % 10 == 0, None).otherwise((F.col("idx") % 300).cast("double"))
    return _round(fixtures.spark(s, d, "cloud").select("idx", *(v.alias(n) for n, v in zip("rgba", geodesy.intensity_colour(i)))), 6)


_I = "round(least(greatest(CASE WHEN idx % 10 = 0 THEN 128 ELSE idx % 300 END/255e0,0e0),1e0),6)+0.0"
_add("colorize_intensity", _intensities, f"SELECT idx, {_I} AS r, {_I} AS g, {_I} AS b, 1.0e0 AS a FROM {_src('cloud')}")
_add("colorize_classification", lambda s, d: fixtures.spark(s, d, "cloud").select("idx", *(c.alias(n) for n, c in zip("rgb", geodesy.class_colour(F.col("cls"))))),
     f"SELECT idx, coalesce(t.r, 128) AS r, coalesce(t.g, 128) AS g, coalesce(t.b, 128) AS b FROM {_src('cloud')} LEFT JOIN (VALUES {', '.join(f'({i}, {r}, {g}, {b})' for i, (r, g, b) in enumerate(geodesy.CLASSES))}) t(c, r, g, b) ON t.c = s.cls")


def _padded(s, d):
    own = lambda c: F.when(F.col("idx") % 3 > 0, F.col(c) / F.lit(255.0))
    return _round(fixtures.spark(s, d, "cloud").select("idx", *(c.alias(n) for n, c in zip("rgba", geodesy.padded_colour(own("r"), own("g"), own("b"), F.when(F.col("idx") % 3 > 0, 0.5))))), 6)


_add("apply_colours", _padded, f"SELECT idx, {', '.join(f'round(CASE WHEN idx % 3 > 0 THEN {c}/255e0 ELSE 0.5e0 END,6)+0.0 AS {c}' for c in 'rgb')}, CASE WHEN idx % 3 > 0 THEN 0.5e0 ELSE 1.0e0 END AS a FROM {_src('cloud')}")
_add("build_colour_ramp", lambda s, d: geodesy.colour_ramp(s, [(0, 0, 255), (0, 255, 0), (255, 0, 0)], 11),
     "SELECT CAST(i AS BIGINT) AS step, CAST(floor((1-l)*a[1]+l*b[1]) AS INT) AS r, CAST(floor((1-l)*a[2]+l*b[2]) AS INT) AS g, CAST(floor((1-l)*a[3]+l*b[3]) AS INT) AS b FROM (SELECT i, i/10e0*2-k AS l, c[k+1] AS a, c[k+2] AS b FROM (SELECT i, CAST(least(floor(i/10e0*2),1) AS INT) AS k, [[0,0,255],[0,255,0],[255,0,0]] AS c FROM range(11) r(i)) t) t2")

# ---------------------------------------------------------------- memory estimates
_N = "SELECT n_nationkey AS idx, CAST(n_nationkey AS BIGINT) * 123456 AS n FROM nation"


def _estimates(s, d):
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("idx"), (F.col("n_nationkey").cast("long") * 123456).alias("n"))
    c = F.col("n")
    return n.select("idx", limits.octree_bytes(c).alias("octree"), limits.points_bytes(c, F.col("idx") % 2 == 0, F.col("idx") % 3 == 0).alias("points"), limits.octree_used(c, F.floor(c / 9), c * 10).alias("used"))


_add("memory_estimates", _estimates, f"SELECT CAST(idx AS BIGINT) AS idx, CAST(n*26+greatest(n//50000,1)*9*140+1024 AS BIGINT) AS octree, CAST(n*26+CASE WHEN idx%2=0 THEN n*3 ELSE 0 END+CASE WHEN idx%3=0 THEN n*12 ELSE 0 END+greatest(n//50000,1)*9*64+1024 AS BIGINT) AS points, CAST((n//9)*140+(n-n//9)*72+n*10*12+64 AS BIGINT) AS used FROM ({_N}) t")

# ---------------------------------------------------------------- octree
_DEPTH, _MOST = 21, 500
_CODE = "(" + "+".join(f"(((cx >> {k}) & 1) * {4 * 8 ** k} + ((cy >> {k}) & 1) * {2 * 8 ** k} + ((cz >> {k}) & 1) * {8 ** k})" for k in range(_DEPTH)) + ")"
_CELL = lambda a: f"CAST(least(greatest(floor(({a}-l{a})/(h{a}-l{a})*2097152e0),0),2097151) AS BIGINT) AS c{a}"
_OCTREE = f"""WITH RECURSIVE p AS (SELECT * FROM {_src('cloud')}), b AS (SELECT {', '.join(f'min({a}) AS l{a}, max({a}) AS h{a}' for a in 'xyz')} FROM p),
c AS (SELECT {_CODE} AS code FROM (SELECT {', '.join(map(_CELL, 'xyz'))} FROM p, b) t),
lv AS (SELECT l AS level, code >> (3*({_DEPTH}-l)) AS node, count(*) AS n, count(DISTINCT code >> (3*({_DEPTH}-l-1))) AS k FROM c, range({_DEPTH + 1}) r(l) WHERE l < {_DEPTH} GROUP BY 1, 2),
t AS (SELECT 0 AS level, CAST(0 AS BIGINT) AS node, '' AS path UNION ALL SELECT t.level+1, t.node*8+d.d, t.path || d.d FROM t JOIN lv ON lv.level = t.level AND lv.node = t.node AND lv.n > {_MOST} AND lv.k > 1, range(8) d(d))
SELECT t.path, t.level, CAST(coalesce(lv.n, 0) AS BIGINT) AS n, NOT coalesce(lv.n > {_MOST} AND lv.k > 1, false) AS leaf FROM t LEFT JOIN lv USING (level, node)"""


def _octree(s, d):
    return points.octree(fixtures.spark(s, d, "cloud"), _MOST, _DEPTH)


_add("octree_nodes", lambda s, d: _octree(s, d).select("path", "level", "n", "leaf"), _OCTREE)
_add("octree_leaves", lambda s, d: _octree(s, d).where("leaf and n > 0").select("path", "n"), f"SELECT path, n FROM ({_OCTREE}) o WHERE leaf AND n > 0")
_BOX = f"""WITH o AS ({_OCTREE}), p AS (SELECT * FROM {_src('cloud')}), b AS (SELECT {', '.join(f'min({a}) AS l{a}, max({a}) AS h{a}' for a in 'xyz')} FROM p),
f AS (SELECT o.*, coalesce((SELECT sum(((CAST(substr(path, i, 1) AS INT) >> 2) & 1)/power(2e0, i)) FROM range(1, 22) r(i) WHERE i <= length(path)), 0) AS ax, coalesce((SELECT sum(((CAST(substr(path, i, 1) AS INT) >> 1) & 1)/power(2e0, i)) FROM range(1, 22) r(i) WHERE i <= length(path)), 0) AS ay,
 coalesce((SELECT sum((CAST(substr(path, i, 1) AS INT) & 1)/power(2e0, i)) FROM range(1, 22) r(i) WHERE i <= length(path)), 0) AS az FROM o),
x AS (SELECT path, level, n, leaf, {', '.join(f'l{a}+a{a}*(h{a}-l{a}) AS min_{a}, l{a}+(a{a}+power(0.5e0,level))*(h{a}-l{a}) AS max_{a}' for a in 'xyz')} FROM f, b)"""


def _errors(s, d):
    return _round(_octree(s, d).select("path", points.geometric_error(F.col("level")).alias("error"), "min_x", "max_z"), 6, ("path",))


_ERR = "sqrt(power(max_x-min_x,2)+power(max_y-min_y,2)+power(max_z-min_z,2))*0.5e0/power(2e0,least(level,20))"
_add("tileset_nodes", _errors, f"{_BOX} SELECT path, round({_ERR},6)+0.0 AS error, round(min_x,6)+0.0 AS min_x, round(max_z,6)+0.0 AS max_z FROM x")


def _visible(s, d):
    return points.visible_tiles(_octree(s, d), (30.0, 5.0, 120.0), math.radians(60), 1080.0, 90.0).select("path", "n")


_add("visible_tiles", _visible, f"""{_BOX}, e AS (SELECT *, ({_ERR})/(greatest(sqrt(power((min_x+max_x)/2-30,2)+power((min_y+max_y)/2-5,2)+power((min_z+max_z)/2-120,2)),1e-10)*2*tan({math.radians(60)!r}e0/2)/1080) AS sse FROM x)
SELECT path, n FROM e WHERE (sse < 90 OR leaf) AND n > 0 AND NOT EXISTS (SELECT 1 FROM e u WHERE length(u.path) < length(e.path) AND starts_with(e.path, u.path) AND u.sse < 90)""")

# ---------------------------------------------------------------- density clusters
_NEAR = "2*6371000*atan2(sqrt(h),sqrt(1-h)) <= 40000"
_SIDE = {"b": ("c+(level-z0)/(z1-z0)", "r"), "t": ("c+(level-z2)/(z3-z2)", "r+1"), "l": ("c", "r+(level-z0)/(z2-z0)"), "r": ("c+1", "r+(level-z1)/(z3-z1)")}
_END = lambda k, n: f"round(CASE substr(p, {k}, 1) " + " ".join(f"WHEN '{c}' THEN {v[n]}" for c, v in _SIDE.items()) + " END, 6)+0.0"
_add("contour_lines", lambda s, d: _round(shapes.contour_lines(fixtures.spark(s, d, "grid"), 10.0), 6, ()),
     f"""WITH g AS (SELECT * FROM {_src('grid')}), m AS (SELECT min(z) AS lo FROM g), c AS (SELECT a."row" AS r, a.col AS c, a.z AS z0, b.z AS z1, e.z AS z2, f.z AS z3 FROM g a JOIN g b ON b."row" = a."row" AND b.col = a.col + 1 JOIN g e ON e."row" = a."row" + 1 AND e.col = a.col JOIN g f ON f."row" = a."row" + 1 AND f.col = a.col + 1),
l AS (SELECT *, k * 10e0 AS level, (z0 >= k*10)::INT + 2*(z1 >= k*10)::INT + 4*(z3 >= k*10)::INT + 8*(z2 >= k*10)::INT AS v FROM (SELECT c.*, unnest(generate_series(CAST(greatest(ceil(least(z0,z1,z2,z3)/10), floor(lo/10)+1) AS BIGINT), CAST(floor(greatest(z0,z1,z2,z3)/10) AS BIGINT))) AS k FROM c, m) t),
s AS (SELECT *, CASE WHEN v IN (1,14) THEN ['bl'] WHEN v IN (2,13) THEN ['br'] WHEN v IN (3,12) THEN ['lr'] WHEN v IN (4,11) THEN ['rt'] WHEN v = 5 THEN ['bl','rt'] WHEN v IN (6,9) THEN ['bt'] WHEN v IN (7,8) THEN ['lt'] WHEN v = 10 THEN ['br','lt'] END AS p FROM l WHERE v NOT IN (0, 15)),
u AS (SELECT level, unnest(p) AS p, r, c, z0, z1, z2, z3 FROM s)
SELECT level+0.0 AS level, {_END(1, 0)} AS x1, {_END(1, 1)} AS y1, {_END(2, 0)} AS x2, {_END(2, 1)} AS y2 FROM u""")
_add("dbscan", lambda s, d: points.dbscan(fixtures.spark(s, d, "china"), 40000.0, 8), f"""WITH RECURSIVE p AS (SELECT * FROM {_src('china')}),
nb AS (SELECT a.idx, b.idx AS j FROM p a JOIN p b ON a.idx <> b.idx AND b.lat BETWEEN a.lat-0.37e0 AND a.lat+0.37e0 AND floor(b.lat/0.4e0) BETWEEN floor(a.lat/0.4e0)-1 AND floor(a.lat/0.4e0)+1
 WHERE 2*6371000*atan2(sqrt(power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lng-a.lng)/2),2)),sqrt(1-(power(sin(radians(b.lat-a.lat)/2),2)+cos(radians(a.lat))*cos(radians(b.lat))*power(sin(radians(b.lng-a.lng)/2),2)))) <= 40000),
core AS (SELECT idx FROM nb GROUP BY idx HAVING count(*) >= 8),
e AS (SELECT nb.idx, nb.j FROM nb JOIN core USING (idx) JOIN core c2 ON c2.idx = nb.j),
reach AS (SELECT idx, idx AS r FROM core UNION SELECT reach.idx, e.j FROM reach JOIN e ON e.idx = reach.r),
lab AS (SELECT idx, min(r) AS c FROM reach GROUP BY idx),
every AS (SELECT * FROM lab UNION ALL SELECT nb.idx, min(lab.c) FROM nb JOIN lab ON lab.idx = nb.j WHERE nb.idx NOT IN (SELECT idx FROM core) GROUP BY nb.idx),
num AS (SELECT c, row_number() OVER (ORDER BY c)-1 AS k FROM (SELECT DISTINCT c FROM lab) t)
SELECT p.idx, CAST(coalesce(num.k, -1) AS BIGINT) AS cluster FROM p LEFT JOIN every USING (idx) LEFT JOIN num ON num.c = every.c""")
_add("buffer_point", lambda s, d: _round(fixtures.spark(s, d, "china").select("idx", F.posexplode(shapes.circle(F.col("lng"), F.col("lat"), 5000.0, 8)).alias("seq", "p")).select("idx", "seq", F.col("p.x").alias("lng"), F.col("p.y").alias("lat")), 6, ("idx", "seq")),
     f"SELECT idx, CAST(i AS INT) AS seq, round(lng+degrees(5000/(6371000*cos(radians(lat))))*cos((i%8)*2*pi()/8),6)+0.0 AS lng, round(lat+degrees(5000/6371000e0)*sin((i%8)*2*pi()/8),6)+0.0 AS lat FROM {_src('china')}, range(9) r(i)")
