"""Queries over GeoJSON, WKT and WKB: texts written from rows and read back, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import geojson as out
from ..sources import geojson, wkt
from . import fixtures
from .catalogue import _add, _round, _src

# ---------------------------------------------------------------- GeoJSON: a collection a track, a point feature a row and a line of all


def _tracks(s, d):
    t = fixtures.spark(s, d, "tracks")
    return t.select("track_id", "seq", F.round("lng", 6).alias("x"), F.round("lat", 6).alias("y"))


def _texts(s, d):
    t = _tracks(s, d)
    here = F.array(F.struct("x", "y"))
    points = t.select("track_id", "seq", out.feature(here, "Point", F.struct((F.col("seq") % 5).alias("k"), F.concat(F.lit("n"), (F.col("seq") % 3).cast("string")).alias("name"), (F.col("seq") % 2 == 0).alias("even"))).alias("feature"))
    line = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    lines = t.groupBy("track_id").agg(line.alias("c")).select("track_id", F.lit(1 << 40).cast("long").alias("seq"), out.feature(F.col("c"), "LineString").alias("feature"))
    return out.collection(points.unionAll(lines), "track_id", "seq", "feature")


def _features(s, d):
    return geojson.read(_texts(s, d), "track_id", "text")


_T = f"(SELECT track_id, seq, seq - 1 AS feature, round(lng, 6) AS x, round(lat, 6) AS y, count(*) OVER (PARTITION BY track_id) AS n FROM {_src('tracks')})"
_add("geojson_coords", lambda s, d: geojson.coordinates(_features(s, d), "track_id"),
     f"SELECT track_id, feature, CAST(0 AS INT) AS pos, x AS lng, y AS lat FROM {_T} t UNION ALL SELECT track_id, n AS feature, CAST(feature AS INT), x, y FROM {_T} t")
_add("geojson_features", lambda s, d: geojson.offsets(_features(s, d), "track_id"),
     f"SELECT track_id, feature, 'Point' AS type, CAST(1 AS BIGINT) AS count, feature AS offset FROM {_T} t UNION ALL SELECT DISTINCT track_id, n, 'LineString', n, n FROM {_T} t")
_add("geojson_properties", lambda s, d: _features(s, d).select("track_id", "feature", "properties"),
     f"""SELECT track_id, feature, '{{"k":' || seq % 5 || ',"name":"n' || seq % 3 || '","even":' || CASE WHEN seq % 2 = 0 THEN 'true' ELSE 'false' END || '}}' AS properties FROM {_T} t UNION ALL SELECT DISTINCT track_id, n, '{{}}' FROM {_T} t""")
_add("geojson_count", lambda s, d: geojson.count(_features(s, d), "track_id"), f"SELECT track_id, count(*) + 1 AS n FROM {_T} t GROUP BY track_id")
_add("geojson_chunks", lambda s, d: geojson.chunked(_features(s, d), 100).groupBy("track_id", "chunk").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("coords")).alias("positions")),
     f"SELECT track_id, feature // 100 AS chunk, count(*) AS n, CAST(sum(c) AS BIGINT) AS positions FROM (SELECT track_id, feature, 1 AS c FROM {_T} t UNION ALL SELECT DISTINCT track_id, n, n FROM {_T} t) u GROUP BY 1, 2")
_add("geojson_filter_property", lambda s, d: geojson.where_property(_features(s, d), "k", 3).select("track_id", "feature"), f"SELECT track_id, feature FROM {_T} t WHERE seq % 5 = 3")
_add("geojson_filter_text", lambda s, d: geojson.where_property(geojson.where_property(_features(s, d), "name", "n1"), "even", True).select("track_id", "feature"), f"SELECT track_id, feature FROM {_T} t WHERE seq % 3 = 1 AND seq % 2 = 0")
_add("geojson_filter_bbox", lambda s, d: geojson.in_box(_features(s, d), 116.2, 39.1, 116.5, 39.4).select("track_id", "feature"),
     f"SELECT track_id, feature FROM {_T} t WHERE x BETWEEN 116.2 AND 116.5 AND y BETWEEN 39.1 AND 39.4 UNION ALL SELECT DISTINCT track_id, n FROM {_T} t WHERE x BETWEEN 116.2 AND 116.5 AND y BETWEEN 39.1 AND 39.4")
_add("geojson_count_by", lambda s, d: geojson.count_by_property(_features(s, d), "name"), f"SELECT 'n' || seq % 3 AS value, count(*) AS n FROM {_T} t GROUP BY 1")


def _edited(s, d):
    f = geojson.rename_property(geojson.remove_property(geojson.add_property(_features(s, d), "src", "t"), "even"), "k", "key")
    return f.where("type = 'Point'").select("track_id", "feature", *(F.get_json_object("properties", f"$.{k}").alias(k) for k in ("key", "name", "src", "even")))


_add("geojson_edit", _edited, f"SELECT track_id, feature, CAST(seq % 5 AS VARCHAR) AS key, 'n' || seq % 3 AS name, 't' AS src, CAST(NULL AS VARCHAR) AS even FROM {_T} t")
_add("geojson_write", lambda s, d: _tracks(s, d).select("track_id", "seq", out.feature(F.array(F.struct("x", "y")), "Point", F.struct((F.col("seq") % 5).alias("k"))).alias("text")),
     f"""SELECT track_id, seq, '{{"type":"Feature","geometry":{{"type":"Point","coordinates":[' || x || ',' || y || ']}},"properties":{{"k":' || seq % 5 || '}}}}' AS text FROM {_T} t""")


def _rings(s, d):
    r = fixtures.spark(s, d, "rings").select("geom_id", "seq", F.round("lng", 6).alias("x"), F.round("lat", 6).alias("y"))
    ring = F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda v: F.struct(v["x"].alias("x"), v["y"].alias("y")))
    return r.groupBy("geom_id").agg(ring.alias("ring"))


def _split(s, d):
    """Both rings of two following nations, one after the other, taken apart again."""
    r = _rings(s, d)
    two = r.join(r.select((F.col("geom_id") - 1).alias("geom_id"), F.col("ring").alias("next")), "geom_id").select("geom_id", out.split_rings(F.concat("ring", "next")).alias("rings"))
    return two.select("geom_id", F.posexplode("rings").alias("part", "ring")).select("geom_id", "part", F.size("ring").alias("n"), F.round(F.col("ring")[1]["x"], 6).alias("x"))


_add("geojson_split_rings", _split, f"WITH r AS (SELECT geom_id, seq, round(lng, 6) AS x FROM {_src('rings')}) SELECT a.geom_id, CAST(p AS INT) AS part, CAST(13 AS INT) AS n, b.x FROM (SELECT DISTINCT geom_id FROM r WHERE geom_id < 24) a, range(2) t(p), r b WHERE b.geom_id = a.geom_id + p AND b.seq = 1")

# ---------------------------------------------------------------- WKT and WKB
_RING = f"(SELECT geom_id, seq, round(lng, 6) AS x, round(lat, 6) AS y FROM {_src('rings')})"


def _shapes(s, d):
    """Each ring as a polygon, a line, a multipoint and a point."""
    r = _rings(s, d)
    kinds = (("POLYGON", F.array("ring")), ("LINESTRING", F.array("ring")), ("MULTIPOINT", F.array("ring")), ("POINT", F.array(F.slice("ring", 1, 1))))
    each = None
    for kind, parts in kinds:
        one = r.select("geom_id", wkt.geometry(kind, parts).alias("g"))
        each = one if each is None else each.unionAll(one)
    return each


def _positions(df):
    flat = df.select("geom_id", F.col("g.type").alias("type"), F.posexplode(wkt.flat(F.col("g"))).alias("pos", "p"))
    return flat.select("geom_id", "type", "pos", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"))


_KINDS = "(VALUES ('POLYGON'), ('LINESTRING'), ('MULTIPOINT'), ('POINT')) k(type)"
_POS = f"SELECT geom_id, type, CAST(seq AS INT) AS pos, x, y FROM {_RING} r, {_KINDS} WHERE type <> 'POINT' OR seq = 0"
_add("wkt_write", lambda s, d: _shapes(s, d).select("geom_id", F.col("g.type").alias("type"), wkt.to_wkt(F.col("g"), 3).alias("wkt")),
     f"SELECT geom_id, type, type || CASE WHEN type = 'POLYGON' THEN '((' ELSE '(' END || string_agg(printf('%.3f %.3f', x, y), ', ' ORDER BY seq) || CASE WHEN type = 'POLYGON' THEN '))' ELSE ')' END AS wkt FROM {_RING} r, {_KINDS} WHERE type <> 'POINT' OR seq = 0 GROUP BY geom_id, type")
_add("wkt_round_trip", lambda s, d: _positions(_shapes(s, d).select("geom_id", wkt.from_wkt(wkt.to_wkt(F.col("g"))).alias("g"))), _POS)
_add("wkb_round_trip", lambda s, d: _positions(_shapes(s, d).select("geom_id", wkt.from_wkb(wkt.to_wkb(F.col("g"))).alias("g"))), _POS)


def _sizes(s, d):
    return _shapes(s, d).select("geom_id", F.col("g.type").alias("type"), F.octet_length(wkt.to_wkb(F.col("g"))).alias("n"))


_add("wkb_write", _sizes, f"SELECT geom_id, type, CAST(CASE type WHEN 'POINT' THEN 21 WHEN 'LINESTRING' THEN 9 + 16 * 13 WHEN 'POLYGON' THEN 13 + 16 * 13 ELSE 9 + 21 * 13 END AS INT) AS n FROM (SELECT DISTINCT geom_id FROM {_RING} r) t, {_KINDS}")
