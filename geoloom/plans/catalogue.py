"""Queries by name, and the SQL that each is compared with."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import crs, geodesy
from ..operators import points, shapes
from . import fixtures

QUERIES: dict = {}
ORACLE_SQL: dict = {}
_PI = "pi()"


def _add(name: str, run, sql: str | None = None):
    QUERIES[name] = run
    if sql:
        ORACLE_SQL[name] = sql


def _src(name: str) -> str:
    return f"({fixtures.duckdb(name)}) s"


def _round(df, digits: int, keep: tuple = ("idx",)):
    """Doubles rounded; -0.0 becomes 0.0."""
    return df.select(*(F.col(c) if c in keep else (F.round(c, digits) + 0.0).alias(c) for c in df.columns))


def _pair(name: str, source: str, fn, x: str, y: str, digits: int):
    """A coordinate pair mapped to another one; x and y are the SQL of the same."""
    def run(spark, sf):
        a, b = fn(F.col("lng"), F.col("lat"))
        return _round(fixtures.spark(spark, sf, source).select("idx", a.alias("lng"), b.alias("lat")), digits)
    _add(name, run, f"SELECT idx, round({x}, {digits}) + 0.0 AS lng, round({y}, {digits}) + 0.0 AS lat FROM {_src(source)}")


# SQL of the formulas, written out in full and on their own
def _gcj(x: str, y: str) -> tuple[str, str]:
    dx, dy = f"(({x})-105.0e0)", f"(({y})-35.0e0)"
    s = f"((20*sin(6*{_PI}*{dx})+20*sin(2*{_PI}*{dx}))*2/3)"
    t_lat = f"(-100+2*{dx}+3*{dy}+0.2e0*{dy}*{dy}+0.1e0*{dx}*{dy}+0.2e0*sqrt(abs({dx}))+{s}+(20*sin({_PI}*{dy})+40*sin({_PI}*{dy}/3))*2/3+(160*sin({_PI}*{dy}/12)+320*sin({_PI}*{dy}/30))*2/3)"
    t_lng = f"(300+{dx}+2*{dy}+0.1e0*{dx}*{dx}+0.1e0*{dx}*{dy}+0.1e0*sqrt(abs({dx}))+{s}+(20*sin({_PI}*{dx})+40*sin({_PI}*{dx}/3))*2/3+(150*sin({_PI}*{dx}/12)+300*sin({_PI}*{dx}/30))*2/3)"
    m = f"(1-0.00669342162e0*sin(radians({y}))*sin(radians({y})))"
    d_lat = f"({t_lat}*180/((6378245e0*(1-0.00669342162e0))/({m}*sqrt({m}))*{_PI}))"
    d_lng = f"({t_lng}*180/(6378245e0/sqrt({m})*cos(radians({y}))*{_PI}))"
    inside = f"({x}) BETWEEN 73.66e0 AND 135.05e0 AND ({y}) BETWEEN 3.86e0 AND 53.55e0"
    return f"(CASE WHEN {inside} THEN ({x})+{d_lng} ELSE {x} END)", f"(CASE WHEN {inside} THEN ({y})+{d_lat} ELSE {y} END)"


_XP = f"({_PI}*3000/180)"


def _bd(x: str, y: str) -> tuple[str, str]:
    z = f"(sqrt(({x})*({x})+({y})*({y}))+0.00002e0*sin(({y})*{_XP}))"
    t = f"(atan2({y},{x})+0.000003e0*cos(({x})*{_XP}))"
    return f"({z}*cos({t})+0.0065e0)", f"({z}*sin({t})+0.006e0)"


def _unbd(x: str, y: str) -> tuple[str, str]:
    x, y = f"(({x})-0.0065e0)", f"(({y})-0.006e0)"
    z, t = f"(sqrt({x}*{x}+{y}*{y})-0.00002e0*sin({y}*{_XP}))", f"(atan2({y},{x})-0.000003e0*cos({x}*{_XP}))"
    return f"({z}*cos({t}))", f"({z}*sin({t}))"


def _merc(x: str, y: str) -> tuple[str, str]:
    return f"(radians({x})*6378137)", f"(ln(tan({_PI}/4+radians({y})/2))*6378137)"


_G = _gcj("lng", "lat")
_INV = (f"(2*lng-{_G[0]})", f"(2*lat-{_G[1]})")
_pair("crs_wgs84_gcj02", "china", crs.wgs84_to_gcj02, *_G, 6)
_pair("crs_gcj02_wgs84", "china", crs.gcj02_to_wgs84, *_INV, 6)
_pair("crs_gcj02_bd09", "china", crs.gcj02_to_bd09, *_bd("lng", "lat"), 6)
_pair("crs_bd09_gcj02", "china", crs.bd09_to_gcj02, *_unbd("lng", "lat"), 6)
_pair("crs_mercator", "geo", crs.to_mercator, *_merc("lng", "lat"), 3)
_pair("crs_mercator_inverse", "geo", lambda x, y: crs.from_mercator(x * 100000.0, y * 100000.0), "degrees(lng*100000/6378137)", f"degrees(2*atan(exp(lat*100000/6378137))-{_PI}/2)", 6)


def _nested(name, fn, first, second, digits):
    """Two steps, the first in a subquery."""
    def run(spark, sf):
        a, b = fn(F.col("lng"), F.col("lat"))
        return _round(fixtures.spark(spark, sf, "china").select("idx", a.alias("lng"), b.alias("lat")), digits)
    _add(name, run, f"SELECT idx, round({second[0]}, {digits}) + 0.0 AS lng, round({second[1]}, {digits}) + 0.0 AS lat FROM (SELECT idx, {first[0]} AS lng, {first[1]} AS lat FROM {_src('china')}) q")


_nested("crs_wgs84_bd09", crs.wgs84_to_bd09, _G, _bd("lng", "lat"), 6)
_nested("crs_bd09_wgs84", crs.bd09_to_wgs84, _unbd("lng", "lat"), _INV, 6)
_nested("crs_gcj02_mercator", lambda x, y: crs.to_mercator(*crs.wgs84_to_gcj02(x, y)), _G, _merc("lng", "lat"), 3)
_add("crs_cgcs2000", lambda s, d: fixtures.spark(s, d, "china").withColumn("compatible", F.lit(True)), f"SELECT idx, lng, lat, true AS compatible FROM {_src('china')}")
_add("crs_in_china", lambda s, d: fixtures.spark(s, d, "geo").select("idx", crs.in_china(F.col("lng"), F.col("lat")).alias("inside")), f"SELECT idx, lng BETWEEN 73.66e0 AND 135.05e0 AND lat BETWEEN 3.86e0 AND 53.55e0 AS inside FROM {_src('geo')}")


def _ecef(s, d):
    x, y, z = crs.wgs84_to_ecef(F.col("lng"), F.col("lat"), F.lit(0.0))
    return _round(fixtures.spark(s, d, "geo").select("idx", x.alias("x"), y.alias("y"), z.alias("z")), 3)


_add("crs_ecef", _ecef, f"""WITH p AS (SELECT idx, radians(lat) AS f, radians(lng) AS l, 1-(6356752.314245179e0*6356752.314245179e0)/(6378137e0*6378137e0) AS e2 FROM {_src('geo')}), q AS (SELECT *, 6378137e0/sqrt(1-e2*sin(f)*sin(f)) AS n FROM p)
SELECT idx, round(n*cos(f)*cos(l), 3) + 0.0 AS x, round(n*cos(f)*sin(l), 3) + 0.0 AS y, round(n*(1-e2)*sin(f), 3) + 0.0 AS z FROM q""")


def _utm(s, d):
    return _round(fixtures.spark(s, d, "geo").select("idx", *(c.alias(k) for k, c in crs.wgs84_to_utm(F.col("lng"), F.col("lat")).items())), 3, ("idx", "zone", "is_north"))


_add("crs_utm", _utm, f"""WITH p AS (SELECT idx, lat, radians(lat) AS f, radians(lng - ((least(greatest(CAST(floor((lng+180)/6) AS INT)+1, 1), 60) - 1) * 6 - 177)) AS dl, least(greatest(CAST(floor((lng+180)/6) AS INT)+1, 1), 60) AS zone,
 1-(6356752.314245179e0*6356752.314245179e0)/(6378137e0*6378137e0) AS e FROM {_src('geo')}),
q AS (SELECT *, e/(1-e) AS ep, 6378137e0/sqrt(1-e*sin(f)*sin(f)) AS n, tan(f)*tan(f) AS t, cos(f)*cos(f)*e/(1-e) AS c, cos(f)*dl AS a,
 6378137e0*((1-e/4-3*e*e/64-5*e*e*e/256)*f-(3*e/8+3*e*e/32+45*e*e*e/1024)*sin(2*f)+(15*e*e/256+45*e*e*e/1024)*sin(4*f)-(35*e*e*e/3072)*sin(6*f)) AS m FROM p)
SELECT idx, zone, round(0.9996e0*n*(a+(1-t+c)*a*a*a/6+(5-18*t+t*t+72*c-58*ep)*a*a*a*a*a/120)+500000, 3) + 0.0 AS easting,
 round(0.9996e0*(m+n*tan(f)*(a*a/2+(5-t+9*c+4*c*c)*a*a*a*a/24+(61-58*t+t*t+600*c-330*ep)*a*a*a*a*a*a/720)) + CASE WHEN lat < 0 THEN 10000000 ELSE 0 END, 3) + 0.0 AS northing, lat >= 0 AS is_north FROM q""")



def _utm_back(s, d):
    """There and back: the point again."""
    p = fixtures.spark(s, d, "geo")
    p = p.select("idx", *(c.alias(k) for k, c in crs.wgs84_to_utm(F.col("lng"), F.col("lat")).items()))
    lng, lat = crs.utm_to_wgs84(F.col("zone"), F.col("easting"), F.col("northing"), F.col("is_north"))
    return _round(p.select("idx", lng.alias("lng"), lat.alias("lat")), 4)


_add("crs_utm_inverse", _utm_back, f"SELECT idx, round(lng, 4) + 0.0 AS lng, round(lat, 4) + 0.0 AS lat FROM {_src('geo')}")

# ---------------------------------------------------------------- geodesy: each point with the one before it
_PREV = "(SELECT idx, lng AS x2, lat AS y2, lag(lng) OVER (ORDER BY idx) AS x1, lag(lat) OVER (ORDER BY idx) AS y1 FROM {s}) p WHERE x1 IS NOT NULL"


def _prev(s, d):
    """Pairs of points whose idx follow each other, by an equi-join."""
    p = fixtures.spark(s, d, "geo")
    q = p.select((F.col("idx") + 1).alias("idx"), F.col("lng").alias("x1"), F.col("lat").alias("y1"))
    return p.select("idx", F.col("lng").alias("x2"), F.col("lat").alias("y2")).join(q, "idx")


_ENDS = ("x1", "y1", "x2", "y2")
_SQ = _PREV.format(s=_src("geo"))
_A = "(power(sin((radians(y2)-radians(y1))/2),2)+cos(radians(y1))*cos(radians(y2))*power(sin(radians(x2-x1)/2),2))"


def _measure(name, fn, sql, digits):
    _add(name, lambda s, d: _round(_prev(s, d).select("idx", fn(*map(F.col, _ENDS)).alias("v")), digits), f"SELECT idx, round({sql}, {digits}) + 0.0 AS v FROM {_SQ}")


_measure("geo_haversine", geodesy.haversine, f"2*6371000*atan2(sqrt({_A}),sqrt(1-{_A}))", 3)
_BR = "degrees(atan2(sin(radians(x2-x1))*cos(radians(y2)),cos(radians(y1))*sin(radians(y2))-sin(radians(y1))*cos(radians(y2))*cos(radians(x2-x1))))"
_measure("geo_bearing", geodesy.bearing, f"fmod({_BR}+360,360)", 6)
_PSI = "((1-1/298.257223563e0)*(ln(tan(radians(y2)/2+pi()/4))-ln(tan(radians(y1)/2+pi()/4))))"
_TURN = "(radians(x2-x1)+pi()-2*pi()*floor((radians(x2-x1)+pi())/(2*pi()))-pi())"
_measure("geo_rhumb", geodesy.rhumb_distance, f"6371000*sqrt(power({_PSI},2)+power((CASE WHEN abs({_PSI})<1e-15 THEN cos((radians(y1)+radians(y2))/2) ELSE abs(radians(y2)-radians(y1))/abs({_PSI}) END)*{_TURN},2))", 3)
_measure("geo_rhumb_bearing", geodesy.rhumb_bearing, f"fmod(degrees(atan2({_TURN},{_PSI}))+360,360)", 6)


def _mid(s, d):
    a, b = geodesy.midpoint(*map(F.col, _ENDS))
    return _round(_prev(s, d).select("idx", a.alias("lng"), b.alias("lat")), 6)


_BX, _BY = "cos(radians(y2))*cos(radians(x2-x1))", "cos(radians(y2))*sin(radians(x2-x1))"
_add("geo_midpoint", _mid, f"SELECT idx, round(x1+degrees(atan2({_BY},cos(radians(y1))+{_BX})),6)+0.0 AS lng, round(degrees(atan2(sin(radians(y1))+sin(radians(y2)),sqrt(power(cos(radians(y1))+{_BX},2)+power({_BY},2)))),6)+0.0 AS lat FROM {_SQ}")
_pair("geo_destination", "geo", lambda x, y: geodesy.destination(x, y, F.lit(77.0), F.lit(250000.0)),
      "lng+degrees(atan2(sin(radians(77e0))*sin(250000/6371000e0)*cos(radians(lat)),cos(250000/6371000e0)-sin(radians(lat))*(sin(radians(lat))*cos(250000/6371000e0)+cos(radians(lat))*sin(250000/6371000e0)*cos(radians(77e0)))))",
      "degrees(asin(sin(radians(lat))*cos(250000/6371000e0)+cos(radians(lat))*sin(250000/6371000e0)*cos(radians(77e0))))", 6)


def _gh_sql(n: int) -> str:
    nx, ny = (5 * n + 1) // 2, 5 * n // 2
    x, y = f"CAST(floor((lng+180)/360*{2**nx}) AS BIGINT)", f"CAST(floor((lat+90)/180*{2**ny}) AS BIGINT)"
    chars = []
    for k in range(n):
        bit = lambda j: f"(({x} >> {nx - 1 - j // 2}) & 1)" if j % 2 == 0 else f"(({y} >> {ny - 1 - j // 2}) & 1)"
        chars.append(f"substr('{geodesy.BASE32}', CAST({'+'.join(f'{bit(5 * k + i)}*{16 >> i}' for i in range(5))} AS INT)+1, 1)")
    return "||".join(chars)


_add("geohash_encode", lambda s, d: fixtures.spark(s, d, "geo").select("idx", geodesy.geohash(F.col("lng"), F.col("lat"), 7).alias("hash")), f"SELECT idx, {_gh_sql(7)} AS hash FROM {_src('geo')}")


def _gh_decode(s, d):
    p = fixtures.spark(s, d, "geo")
    return _round(p.select("idx", *(c.alias(k) for k, c in geodesy.geohash_decode(geodesy.geohash(F.col("lng"), F.col("lat"), 7), 7).items())), 6)


_add("geohash_decode", _gh_decode, f"SELECT idx, round((floor((lng+180)/360*262144)+0.5)*360/262144-180,6)+0.0 AS lng, round((floor((lat+90)/180*131072)+0.5)*180/131072-90,6)+0.0 AS lat, round(180/262144e0,6) AS err_lng, round(90/131072e0,6) AS err_lat FROM {_src('geo')}")

# ---------------------------------------------------------------- points
_add("bounds_2d", lambda s, d: points.bounds(fixtures.spark(s, d, "geo"), "lng", "lat"), f"SELECT min(lng) AS min_lng, max(lng) AS max_lng, min(lat) AS min_lat, max(lat) AS max_lat FROM {_src('geo')}")
_add("bounds_3d", lambda s, d: points.bounds(fixtures.spark(s, d, "cloud"), *"xyz"), f"SELECT {', '.join(f'{f}({a}) AS {f}_{a}' for a in 'xyz' for f in ('min', 'max'))} FROM {_src('cloud')}")
_add("centroid", lambda s, d: _round(points.centroid(fixtures.spark(s, d, "geo"), "lng", "lat"), 6), f"SELECT round(avg(lng),6)+0.0 AS c_lng, round(avg(lat),6)+0.0 AS c_lat FROM {_src('geo')}")
_add("cloud_stats", lambda s, d: _round(points.cloud_stats(fixtures.spark(s, d, "cloud")), 4, ("n",)),
     f"SELECT count(*) AS n, {', '.join(f'round({f}({a}),4)+0.0 AS {n}_{a}' for a in 'xyz' for n, f in (('min', 'min'), ('max', 'max'), ('avg', 'avg'), ('std', 'stddev_pop')))}, round(count(*)/({'*'.join(f'greatest(max({a})-min({a}),0.001e0)' for a in 'xyz')}),4)+0.0 AS density FROM {_src('cloud')}")
_add("filter_bounds", lambda s, d: points.in_box(fixtures.spark(s, d, "cloud"), x=(10.0, 30.0), y=(2.0, 8.0), z=(5.0, 50.0)).select("idx", "r", "g", "b"), f"SELECT idx, r, g, b FROM {_src('cloud')} WHERE x BETWEEN 10 AND 30 AND y BETWEEN 2 AND 8 AND z BETWEEN 5 AND 50")
_add("filter_classification", lambda s, d: fixtures.spark(s, d, "cloud").where(F.col("cls").isin(2, 6, 9)).select("idx", "cls"), f"SELECT idx, cls FROM {_src('cloud')} WHERE cls IN (2, 6, 9)")
_add("validate", lambda s, d: fixtures.spark(s, d, "geo").agg(F.count_if(points.valid(F.col("lng"), F.col("lat"), "china")).alias("valid"), F.count_if(~points.valid(F.col("lng"), F.col("lat"), "china")).alias("invalid")),
     f"SELECT count(*) FILTER (lng BETWEEN 73.66e0 AND 135.05e0 AND lat BETWEEN 3.86e0 AND 53.55e0) AS valid, count(*) FILTER (NOT (lng BETWEEN 73.66e0 AND 135.05e0 AND lat BETWEEN 3.86e0 AND 53.55e0)) AS invalid FROM {_src('geo')}")
_add("clean_remove", lambda s, d: points.clean(fixtures.spark(s, d, "geo"), "remove", "china"), f"SELECT * FROM {_src('geo')} WHERE lng BETWEEN 73.66e0 AND 135.05e0 AND lat BETWEEN 3.86e0 AND 53.55e0")
_add("clean_clamp", lambda s, d: points.clean(fixtures.spark(s, d, "geo"), "clamp", "china"), f"SELECT idx, least(greatest(lng,73.66e0),135.05e0) AS lng, least(greatest(lat,3.86e0),53.55e0) AS lat FROM {_src('geo')}")
_add("dedup_exact", lambda s, d: points.dedup(fixtures.spark(s, d, "geo")), f"SELECT min(idx) AS idx, lng, lat FROM {_src('geo')} GROUP BY lng, lat")
_add("cluster_grid", lambda s, d: _round(points.cluster_by_grid(fixtures.spark(s, d, "geo"), 500000.0, 5).select("lng", "lat", "n"), 6, ("n",)),
     f"""WITH p AS (SELECT * FROM {_src('geo')}), m AS (SELECT round(avg(lat),6) AS mean_lat FROM p)
SELECT round(avg(lng),6)+0.0 AS lng, round(avg(lat),6)+0.0 AS lat, count(*) AS n FROM p, m GROUP BY floor(lng/degrees(500000/(6371000*greatest(cos(radians(mean_lat)),1e-10)))), floor(lat/degrees(500000/6371000e0)) HAVING count(*) >= 5""")
_add("grid_index", lambda s, d: points.grid_index(fixtures.spark(s, d, "geo"), 0.7), f"WITH p AS (SELECT * FROM {_src('geo')}), b AS (SELECT min(lng) AS x0, min(lat) AS y0, ceil((max(lng)-min(lng))/0.7e0)+1 AS c FROM p) SELECT idx, CAST(floor((lat-y0)/0.7e0)*c+floor((lng-x0)/0.7e0) AS BIGINT) AS cell FROM p, b")
_add("voxel_decimate", lambda s, d: _round(points.voxel(fixtures.spark(s, d, "cloud"), 2.5).select("idx", "x", "y", "z", "r", "g", "b"), 6, ("idx", "r", "g", "b")), f"SELECT min(idx) AS idx, round(arg_min(x, idx), 6) + 0.0 AS x, round(arg_min(y, idx), 6) + 0.0 AS y, round(arg_min(z, idx), 6) + 0.0 AS z, arg_min(r, idx) AS r, arg_min(g, idx) AS g, arg_min(b, idx) AS b FROM {_src('cloud')} GROUP BY floor(CAST(x AS REAL)/CAST(2.5 AS REAL)), floor(CAST(y AS REAL)/CAST(2.5 AS REAL)), floor(CAST(z AS REAL)/CAST(2.5 AS REAL))")
_M = [0.5, 1.0, 0.0, 0.0, -1.0, 0.5, 0.25, 0.0, 0.0, 0.0, 2.0, 0.0, 10.0, 20.0, 30.0, 1.0]
_add("transform_affine", lambda s, d: _round(points.affine(fixtures.spark(s, d, "cloud"), _M).select("idx", *"xyz"), 6), f"SELECT idx, round(0.5e0*x-y+10,6)+0.0 AS x, round(x+0.5e0*y+20,6)+0.0 AS y, round(0.25e0*y+2*z+30,6)+0.0 AS z FROM {_src('cloud')}")
_add("rotate", lambda s, d: _round(points.rotate(fixtures.spark(s, d, "cloud"), (0.0, 0.0, 1.0), 0.7).select("idx", *"xyz"), 6), f"SELECT idx, round(x*cos(0.7e0)-y*sin(0.7e0),6)+0.0 AS x, round(x*sin(0.7e0)+y*cos(0.7e0),6)+0.0 AS y, round(z,6)+0.0 AS z FROM {_src('cloud')}")


def _merge(s, d):
    c = fixtures.spark(s, d, "cloud")
    xyz = [F.round(a, 6).alias(a) for a in "xyz"]
    return points.merge(c.where("cls < 6").select("idx", *xyz, "r", "g", "b"), c.where("cls > 20").select("idx", *xyz))


_XYZ = "round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z"
_add("merge_clouds", _merge, f"SELECT idx, {_XYZ}, r, g, b FROM {_src('cloud')} WHERE cls < 6 UNION ALL SELECT idx, {_XYZ}, 128, 128, 128 FROM {_src('cloud')} WHERE cls > 20")
_Q = lambda a: f"CAST(least(floor(CAST(CAST(CAST(CAST({a} AS REAL)-l{a} AS REAL)/CAST(h{a}-l{a} AS REAL) AS REAL)*CAST(65535 AS REAL) AS REAL)),65535) AS INT) AS q{a}"
_add("quantize", lambda s, d: points.quantize(fixtures.spark(s, d, "cloud")), f"WITH p AS (SELECT * FROM {_src('cloud')}), b AS (SELECT {', '.join(f'min(CAST({a} AS REAL)) AS l{a}, max(CAST({a} AS REAL)) AS h{a}' for a in 'xyz')} FROM p) SELECT idx, {', '.join(map(_Q, 'xyz'))} FROM p, b")


def _ramp_query(name: str, stops, rounded=True):
    def run(s, d):
        g = fixtures.spark(s, d, "grid")
        t = F.least(F.greatest((F.col("z") + 40) / 80, F.lit(0.0)), F.lit(1.0))
        r, gr, b = geodesy.ramp(t, stops, rounded)
        return g.select("row", "col", r.alias("r"), gr.alias("g"), b.alias("b"))

    def chan(c):
        parts = " ".join(f"WHEN t <= {q} THEN {a[c]} + (t - {p}) / {q - p}e0 * {b[c] - a[c]}" for (p, a), (q, b) in zip(stops, stops[1:]))
        return f"CAST({'round' if rounded else 'floor'}(CASE {parts} END) AS INT)"
    _add(name, run, f"SELECT \"row\", col, {chan(0)} AS r, {chan(1)} AS g, {chan(2)} AS b FROM (SELECT \"row\", col, least(greatest((z+40)/80,0e0),1e0) AS t FROM {_src('grid')}) q")


for _n, _s, _r in (("terrain", geodesy.TERRAIN, True), ("heat", geodesy.HEAT, True), ("ocean", geodesy.OCEAN, True), ("grey", geodesy.GREY, True)):
    _ramp_query(f"ramp_{_n}", _s, _r)
_ramp_query("colorize_heatmap", geodesy.HEAT, False)

# ---------------------------------------------------------------- lines, rings, grids
_TR = f"(SELECT *, lag(lng) OVER w AS px, lag(lat) OVER w AS py, lag(ele) OVER w AS pe FROM {_src('tracks')} WINDOW w AS (PARTITION BY track_id ORDER BY seq)) t"
_TA = "(power(sin((radians(lat)-radians(py))/2),2)+cos(radians(py))*cos(radians(lat))*power(sin(radians(lng-px)/2),2))"
_TD = f"2*6371000*atan2(sqrt({_TA}),sqrt(1-{_TA}))"
_add("polyline_length", lambda s, d: _round(shapes.polyline_length(fixtures.spark(s, d, "tracks"), "track_id"), 3, ("track_id",)), f"SELECT track_id, round(coalesce(sum({_TD}),0),3)+0.0 AS length FROM {_TR} GROUP BY track_id")
_add("track_stats", lambda s, d: _round(shapes.track_stats(fixtures.spark(s, d, "tracks"), "track_id"), 3, ("track_id", "n")),
     f"SELECT track_id, round(coalesce(sum({_TD}),0),3)+0.0 AS distance, round(coalesce(sum(CASE WHEN ele>pe THEN ele-pe END),0),3)+0.0 AS ascent, round(coalesce(sum(CASE WHEN ele<pe THEN pe-ele END),0),3)+0.0 AS descent, count(*) AS n FROM {_TR} GROUP BY track_id")
_add("polygon_area", lambda s, d: _round(shapes.polygon_area(fixtures.spark(s, d, "rings"), "geom_id"), 0, ("geom_id",)),
     f"SELECT geom_id, round(abs(sum((radians(nx)-radians(lng))*(2+sin(radians(lat))+sin(radians(ny)))))/2*6371000*6371000,0)+0.0 AS area FROM (SELECT *, lead(lng) OVER w AS nx, lead(lat) OVER w AS ny FROM {_src('rings')} WINDOW w AS (PARTITION BY geom_id ORDER BY seq)) t GROUP BY geom_id")
_add("point_in_ring_join", lambda s, d: shapes.points_in_rings(fixtures.spark(s, d, "geo"), fixtures.spark(s, d, "rings")),
     f"""WITH r AS (SELECT * FROM {_src('rings')}), e AS (SELECT a.geom_id, a.lng AS xi, a.lat AS yi, b.lng AS xj, b.lat AS yj FROM r a JOIN r b ON a.geom_id = b.geom_id AND b.seq = CASE WHEN a.seq = 0 THEN 12 ELSE a.seq - 1 END)
SELECT geom_id, idx FROM e JOIN {_src('geo')} ON (yi > lat) <> (yj > lat) AND lng < (xj-xi)*(lat-yi)/(yj-yi)+xi GROUP BY geom_id, idx HAVING count(*) % 2 = 1""")
_NB = f"(SELECT \"row\", col, z, coalesce(lag(z) OVER a, z) AS l, coalesce(lead(z) OVER a, z) AS r, coalesce(lag(z) OVER d, z) AS u, coalesce(lead(z) OVER d, z) AS b FROM {_src('grid')} WINDOW a AS (PARTITION BY \"row\" ORDER BY col), d AS (PARTITION BY col ORDER BY \"row\")) n"
_ZEN, _AZ = math.radians(45), math.radians(135)
_add("hillshade", lambda s, d: shapes.hillshade(fixtures.spark(s, d, "grid")),
     f"SELECT \"row\", col, CAST(round(255*greatest(cos({_ZEN!r}e0)*cos(sl)+sin({_ZEN!r}e0)*sin(sl)*(cos({_AZ!r}e0)*cos(asp)+sin({_AZ!r}e0)*sin(asp)),0)) AS INT) AS shade FROM (SELECT \"row\", col, atan(sqrt(power((r-l)/2,2)+power((b-u)/2,2))) AS sl, atan2(-(b-u)/2,(r-l)/2) AS asp FROM {_NB}) q")
_add("terrain_normals", lambda s, d: _round(shapes.terrain_normals(fixtures.spark(s, d, "grid")), 6, ("row", "col")),
     f"SELECT \"row\", col, round((l-r)/2/sqrt(power((l-r)/2,2)+power((u-b)/2,2)+1),6)+0.0 AS nx, round((u-b)/2/sqrt(power((l-r)/2,2)+power((u-b)/2,2)+1),6)+0.0 AS ny, round(1/sqrt(power((l-r)/2,2)+power((u-b)/2,2)+1),6)+0.0 AS nz FROM {_NB}")

# ---------------------------------------------------------------- searches: every 100th point against all


def _boxes(s, d, every=100):
    p = fixtures.spark(s, d, "china").where(F.col("idx") % every == 0)
    return points.bbox_join(fixtures.spark(s, d, "china"), p.select(F.col("idx").alias("box"), (F.col("lng") - 1).alias("x0"), (F.col("lat") - 1).alias("y0"), (F.col("lng") + 1).alias("x1"), (F.col("lat") + 1).alias("y1")), 2.0)


_add("bbox_join", _boxes, f"WITH p AS (SELECT * FROM {_src('china')}) SELECT q.idx AS box, p.idx FROM p JOIN p q ON q.idx % 100 = 0 AND p.lng BETWEEN q.lng-1 AND q.lng+1 AND p.lat BETWEEN q.lat-1 AND q.lat+1")


def _knn(s, d, every=100):
    p = fixtures.spark(s, d, "china")
    q = p.where(F.col("idx") % every == 0).select(F.col("idx").alias("qid"), F.col("lng").alias("qx"), F.col("lat").alias("qy"))
    return points.knn(p, q, 5, 0.5).select("qid", "idx", F.round("d2", 9).alias("d2"))


_add("knn", _knn, f"WITH p AS (SELECT * FROM {_src('china')}) SELECT qid, idx, round(d2, 9) AS d2 FROM (SELECT q.idx AS qid, p.idx, power(p.lng-q.lng,2)+power(p.lat-q.lat,2) AS d2 FROM p, p q WHERE q.idx % 100 = 0) t QUALIFY row_number() OVER (PARTITION BY qid ORDER BY t.d2, idx) <= 5")
_add("screen_space_error", lambda s, d: _round(fixtures.spark(s, d, "cloud").select("idx", geodesy.screen_space_error(F.col("z"), F.col("x") + 1.0, math.radians(60), 1080.0).alias("sse")), 3),
     f"SELECT idx, round(z / ((x + 1) * 2 * tan(radians(30e0)) / 1080), 3) + 0.0 AS sse FROM {_src('cloud')}")
