"""Queries over files: rows written to a format and read back, compared by SQL with the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sinks import geotiff as tiff_out
from ..sinks import las as las_out
from ..sinks import meshes as mesh_out
from ..sinks import mvt as mvt_out
from ..sinks import tiles as tile_out
from ..sources import geotiff, las, meshes, mvt, tiles, tracks
from . import fixtures
from .catalogue import _add, _round, _src
from .texts import _features, _rings, _T

# ---------------------------------------------------------------- clouds in 24 files, one a class
_FILE = f"(SELECT *, row_number() OVER (PARTITION BY cls ORDER BY idx) - 1 AS i FROM {_src('cloud')})"
def _las(s, d):
    return las_out.write(fixtures.spark(s, d, "cloud").withColumn("file", F.col("cls")), "file", "idx")


_STEP = lambda a: f"round(floor(l{a})+round(({a}-floor(l{a}))/0.001e0)*0.001e0, 3) AS {a}"
_add("las_round_trip", lambda s, d: las.read(_las(s, d), "file", "content").select("file", "idx", *(F.round(a, 3).alias(a) for a in "xyz"), "cls", "r", "g", "b"),
     f"SELECT cls AS file, i AS idx, {', '.join(map(_STEP, 'xyz'))}, cls, r, g, b FROM (SELECT *, {', '.join(f'min({a}) OVER (PARTITION BY cls) AS l{a}' for a in 'xyz')} FROM {_FILE} f0) f")
_add("las_headers", lambda s, d: _round(las.headers(_las(s, d), "file", "content").select("file", "version", "point_format", "compressed", "record_length", "point_offset", "n_points", "min_x", "max_z"), 6, ("file", "version", "point_format", "compressed", "record_length", "point_offset", "n_points")),
     f"SELECT cls AS file, '1.2' AS version, CAST(2 AS INT) AS point_format, false AS compressed, CAST(26 AS INT) AS record_length, CAST(227 AS BIGINT) AS point_offset, count(*) AS n_points, round(min(x),6)+0.0 AS min_x, round(max(z),6)+0.0 AS max_z FROM {_FILE} f GROUP BY cls")
_add("las_point_at", lambda s, d: las.point_at(_las(s, d), "file", "content", F.col("file") * 3).select("file", "idx", "cls", "r"), f"SELECT cls AS file, i AS idx, cls, r FROM {_FILE} f WHERE i = cls * 3")


def _offsets(s, d):
    h = las.headers(_las(s, d), "file", "content")
    o, n = F.col("point_offset"), F.col("record_length").cast("long")
    return h.select("file", las.point_offset(o, n, F.col("n_points") - 1).alias("last"), las.byte_range(o, n, F.lit(10), F.lit(5)).alias("r")).select("file", "last", F.col("r.start").alias("start"), F.col("r.end").alias("end"))


_add("las_offsets", _offsets, f"SELECT cls AS file, 227 + 26 * (count(*) - 1) AS last, CAST(487 AS BIGINT) AS start, CAST(617 AS BIGINT) AS \"end\" FROM {_FILE} f GROUP BY cls")
_add("cloud_formats", lambda s, d: _las(s, d).select("file", F.when(F.substring("content", 1, 8) == F.lit(b"ASTM-E57"), "e57").when((F.substring("content", 1, 4) == F.lit(b"LASF")) & (F.substring("content", 105, 1) < F.lit(bytes([128]))), "las").alias("format")), f"SELECT DISTINCT cls AS file, 'las' AS format FROM {_src('cloud')}")


def _copc(s, d):
    t = s.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("long").alias("id"))
    c = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.struct((F.col("id") * 10 + i * 1000).alias("offset"), F.when(i == 1, 0).otherwise(F.col("id") + 100).alias("size")))
    return t.select("id", c.alias("chunks"), F.lit(2500).cast("long").alias("n"))


_C = "(SELECT id, i, id*10+i*1000 AS o, CASE WHEN i = 1 THEN 0 ELSE id+100 END AS z FROM (SELECT CAST(s_suppkey AS BIGINT) AS id FROM supplier) t, range(4) r(i))"
_add("copc_ranges", lambda s, d: las.copc_ranges(_copc(s, d), "id", "chunks", "n").select("id", F.array_join("ranges", ",").alias("ranges"), "total"),
     f"SELECT id, coalesce(string_agg('bytes=' || o || '-' || (least(o+z, 2500)-1), ',' ORDER BY i) FILTER (z > 0 AND o < 2500), '') AS ranges, CAST(coalesce(sum(least(o+z, 2500)-o) FILTER (z > 0 AND o < 2500), 0) AS BIGINT) AS total FROM {_C} c GROUP BY id")
_add("copc_download", lambda s, d: _copc(s, d).select("id", las.copc_download(F.lit(375), F.col("chunks")).alias("bytes")), f"SELECT id, CAST(375 + sum(z) AS BIGINT) AS bytes FROM {_C} c GROUP BY id")
_F32 = "round(CAST({a} AS REAL)::DOUBLE, 4)+0.0 AS {a}"


def _mesh(name, encode, read):
    def run(s, d):
        files = mesh_out.write(fixtures.spark(s, d, "cloud").withColumn("file", F.col("cls")), "file", "idx", encode)
        return read(files, "file", "content").select("file", "idx", *(F.round(F.col(a).cast("double"), 4).alias(a) for a in "xyz"), "r", "g", "b")
    _add(name, run, f"SELECT cls AS file, i AS idx, {', '.join(_F32.format(a=a) for a in 'xyz')}, r, g, b FROM {_FILE} f")


_mesh("ply_round_trip", mesh_out.ply, meshes.read_ply)
_mesh("pcd_round_trip", mesh_out.pcd, meshes.read_pcd)


def _pcd_ascii(s, d):
    files = mesh_out.pcd_parts(fixtures.spark(s, d, "cloud").withColumn("file", F.col("cls")), "file", "idx", False)
    return meshes.read_pcd(files, "file", "content", "part").select("file", "idx", *(F.round(F.col(a).cast("double"), 4).alias(a) for a in "xyz"), "r", "g", "b")


_add("pcd_ascii_round_trip", _pcd_ascii, f"SELECT cls AS file, i AS idx, {', '.join(_F32.format(a=a) for a in 'xyz')}, r, g, b FROM {_FILE} f")


def _obj(s, d):
    c = fixtures.spark(s, d, "cloud").select(F.col("cls").alias("file"), "idx", *(F.col(a).cast("float").alias(a) for a in "xyz"), F.lit(0.0).alias("nx"), F.lit(0.6).alias("ny"), (F.lit(0.8) * F.when(F.col("idx") % 2 == 0, 1).otherwise(-1)).alias("nz"))
    o = meshes.read_obj(mesh_out.obj(c, "file", "idx", True), "file", "text", "part")
    return o.select("file", "idx", *(F.round(F.col(a).cast("double"), 4).alias(a) for a in ("x", "y", "z", "nz")))


_add("obj_round_trip", _obj, f"SELECT cls AS file, i AS idx, {', '.join(_F32.format(a=a) for a in 'xyz')}, CASE WHEN idx % 2 = 0 THEN 0.8e0 ELSE -0.8e0 END AS nz FROM {_FILE} f")
_add("ply_faces", lambda s, d: meshes.ply_faces(mesh_out.write(fixtures.spark(s, d, "cloud").withColumn("file", F.col("cls")), "file", "idx", mesh_out.ply), "file", "content"), f"SELECT cls AS file, count(*) AS vertices, CAST(0 AS BIGINT) AS faces FROM {_src('cloud')} GROUP BY cls")


def _buffer(s, d):
    v = fixtures.spark(s, d, "cloud").select("idx", F.posexplode(mesh_out.vertex_buffer([F.col(c) for c in "rgb"])).alias("pos", "v"))
    return v.select("idx", "pos", F.round(F.col("v").cast("double"), 4).alias("v"))


_add("vertex_buffer", _buffer, f"SELECT idx, CAST(p AS INT) AS pos, round(CAST(list_extract([x, y, z, 0e0, 0e0, 1e0, r/255e0, g/255e0, b/255e0, 1e0], CAST(p AS INT)+1) AS REAL)::DOUBLE, 4)+0.0 AS v FROM {_src('cloud')}, range(10) t(p)")
_add("indexed_geometry", lambda s, d: mesh_out.indexed(fixtures.spark(s, d, "cloud"), "cls").select("cls", F.size("indices").cast("long").alias("n"), F.array_max("indices").alias("last")), f"SELECT cls, count(*) AS n, count(*) - 1 AS last FROM {_src('cloud')} GROUP BY cls")


def _pnts(s, d):
    t = tile_out.point_tiles(fixtures.spark(s, d, "cloud"), 500, 21)
    return tiles.read_pnts(t, "path", "content").select(*(F.round(a, 2).alias(a) for a in "xyz"), "r", "g", "b")


_add("pnts_round_trip", _pnts, f"SELECT round(x, 2)+0.0 AS x, round(y, 2)+0.0 AS y, round(z, 2)+0.0 AS z, r, g, b FROM {_src('cloud')}")


def _tileset(s, d):
    from ..operators.points import octree
    return tile_out.tileset(octree(fixtures.spark(s, d, "cloud"), 500, 21)).select("path", "parent", "uri", F.round(F.col("box")[0], 6).alias("cx"), F.round("error", 6).alias("error"))


def _register_tileset():
    from .scalars import _BOX, _ERR
    _add("tileset", _tileset, f"{_BOX} SELECT path, CASE WHEN level > 0 THEN left(path, level-1) END AS parent, CASE WHEN leaf THEN 'tile_' || CASE WHEN path = '' THEN 'root' ELSE path END || '.pnts' END AS uri, round((min_x+max_x)/2,6) AS cx, round({_ERR},6) AS error FROM x WHERE n > 0")


_register_tileset()

# ---------------------------------------------------------------- grids in blocks of 32 rows
_G = "(SELECT \"row\" // 32 AS file, \"row\" % 32 AS \"row\", col, z FROM {s})"


def _blocks(s, d):
    g = fixtures.spark(s, d, "grid")
    return g.select(F.floor(F.col("row") / 32).alias("file"), (F.col("row") % 32).alias("row"), "col", "z")


for _name, _how in (("geotiff_round_trip", {}), ("geotiff_tiles", {"tile": 16, "order": ">"}), ("geotiff_plain", {"deflate": False, "rows": 5})):
    _add(_name, lambda s, d, h=_how: geotiff.read(tiff_out.write(_blocks(s, d), "file", **h), "file", "content").select("file", "row", "col", (F.round(F.col("z").cast("double"), 3) + 0.0).alias("z")),
         f"SELECT file, \"row\", col, round(CAST(z AS REAL)::DOUBLE, 3)+0.0 AS z FROM {_G.format(s=_src('grid'))} g")
_add("geotiff_block", lambda s, d: geotiff.read_block(tiff_out.write(_blocks(s, d), "file", tile=16), "file", "content", 1).select("file", "row", "col", (F.round(F.col("z").cast("double"), 3) + 0.0).alias("z")),
     f"SELECT file, \"row\", col, round(CAST(z AS REAL)::DOUBLE, 3)+0.0 AS z FROM {_G.format(s=_src('grid'))} g WHERE \"row\" < 16 AND col BETWEEN 16 AND 31")
_add("geotiff_headers", lambda s, d: geotiff.headers(tiff_out.write(_blocks(s, d), "file", bounds=(100.0, 20.0, 132.0, 30.0)), "file", "content").select("file", "width", "height", "min_x", "min_y", "max_x", "max_y", F.round("res_x", 6).alias("res_x"), F.get_json_object("crs", "$.geographicType").alias("crs")),
     f"SELECT file, CAST(64 AS BIGINT) AS width, max(\"row\") + 1 AS height, 100.0e0 AS min_x, 20.0e0 AS min_y, 132.0e0 AS max_x, 30.0e0 AS max_y, 0.5e0 AS res_x, '4326' AS crs FROM {_G.format(s=_src('grid'))} g GROUP BY file")
_add("elevation_swath", lambda s, d: geotiff.swath(_blocks(s, d), 8, 4).select("file", "row", "col"), f"SELECT file, \"row\", col FROM {_G.format(s=_src('grid'))} g WHERE \"row\" BETWEEN 8 AND 11")
_add("terrain_pyramid", lambda s, d: tile_out.pyramid(_blocks(s, d), "file", 3).select("file", "level", "row", "col", F.round("z", 6).alias("z")),
     f"SELECT file, CAST(l AS INT) AS level, CAST(\"row\" >> l AS BIGINT) AS \"row\", CAST(col >> l AS BIGINT) AS col, round(z, 6) AS z FROM {_G.format(s=_src('grid'))} g, range(4) t(l) WHERE \"row\" % (1 << CAST(l AS INT)) = 0 AND col % (1 << CAST(l AS INT)) = 0")
_add("terrain_tiles", lambda s, d: tile_out.terrain_tiles(_blocks(s, d), "file", 2).select("file", "level", "width", "height", "error", F.octet_length("content").alias("bytes")),
     f"""SELECT file, CAST(l AS INT) AS level, w AS width, h AS height, 1000/power(2e0,l) AS error, CAST(36 + 6*w*h + (4 - (36 + 6*w*h) % 4) % 4 + 4 + 24*(w-1)*(h-1) + 16 + 8*(w+h) AS INT) AS bytes FROM (SELECT file, l, CAST(ceil(64/power(2e0,l)) AS BIGINT) AS w, CAST(ceil((max("row")+1)/power(2e0,l)) AS BIGINT) AS h FROM {_G.format(s=_src('grid'))} g, range(3) t(l) GROUP BY file, l) q""")

# ---------------------------------------------------------------- tracks as GPX, rings as a topology


def _gpx(s, d):
    t = fixtures.spark(s, d, "tracks")
    p = F.concat(F.lit('<trkpt lat="'), F.format_string("%.9f", "lat"), F.lit('" lon="'), F.format_string("%.9f", "lng"), F.lit('">'), F.when(F.col("seq") % 4 > 0, F.concat(F.lit("<ele>"), F.format_string("%.3f", "ele"), F.lit("</ele>"))).otherwise(F.lit("")), F.lit("<time>2024-01-01T00:00:00Z</time></trkpt>"))
    return t.withColumn("p", p).groupBy("track_id").agg(F.concat(F.lit("<?xml version='1.0'?><gpx><trk><trkseg>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "p"))), lambda v: v["p"]), ""), F.lit("</trkseg></trk></gpx>")).alias("text"))


_add("gpx_points", lambda s, d: _round(tracks.read_gpx(_gpx(s, d), "track_id", "text").select("track_id", "seq", "lng", "lat", "ele"), 3, ("track_id", "seq")),
     f"SELECT track_id, seq - 1 AS seq, round(CAST(printf('%.9f', lng) AS DOUBLE),3)+0.0 AS lng, round(CAST(printf('%.9f', lat) AS DOUBLE),3)+0.0 AS lat, CASE WHEN seq % 4 > 0 THEN round(ele,3)+0.0 ELSE 0.0 END AS ele FROM {_src('tracks')}")


def _topology(s, d):
    """Each ring as a polygon of one arc on a grid of a thousandth, in steps."""
    r = _rings(s, d)
    grid = F.transform("ring", lambda p: F.struct(F.round(p["x"] * 1000).cast("long").alias("x"), F.round(p["y"] * 1000).cast("long").alias("y")))
    steps = F.transform("g", lambda p, i: F.when(i == 0, F.array(p["x"], p["y"])).otherwise(F.array(p["x"] - F.get(F.col("g"), i - 1)["x"], p["y"] - F.get(F.col("g"), i - 1)["y"])))
    text = F.concat(F.lit('{"type":"Topology","transform":{"scale":[0.001,0.001],"translate":[0,0]},"objects":{"o":{"type":"GeometryCollection","geometries":[{"type":"Polygon","arcs":[[0]]},{"type":"LineString","arcs":[-1]}]}},"arcs":['), F.to_json(steps), F.lit("]}"))
    return r.withColumn("g", grid).select("geom_id", text.alias("text"))


_TP = f"(SELECT geom_id, seq, round(round(round(lng, 6) * 1000) / 1000, 3)+0.0 AS x, round(round(round(lat, 6) * 1000) / 1000, 3)+0.0 AS y FROM {_src('rings')})"
_add("topojson_points", lambda s, d: _round(tracks.read_topojson(_topology(s, d), "geom_id", "text").select("geom_id", "part", "seq", "type", F.col("lng").alias("x"), F.col("lat").alias("y")), 3, ("geom_id", "part", "seq", "type")),
     f"SELECT geom_id, CAST(0 AS BIGINT) AS part, seq, 'Polygon' AS type, x, y FROM {_TP} t UNION ALL SELECT geom_id, 1, 12 - seq, 'LineString', x, y FROM {_TP} t")


def _topo_features(s, d):
    from ..sources import geojson
    g = tracks.topojson_to_geojson(_topology(s, d), "geom_id", "text")
    return geojson.offsets(geojson.read(g, "geom_id", "text"), "geom_id")


_add("topojson_features", _topo_features, "SELECT CAST(n_nationkey AS BIGINT) AS geom_id, CAST(f AS BIGINT) AS feature, CASE WHEN f = 0 THEN 'Polygon' ELSE 'LineString' END AS type, CAST(13 AS BIGINT) AS count, CAST(13 * f AS BIGINT) AS offset FROM nation, range(2) t(f)")

# ---------------------------------------------------------------- vector tiles of the tracks' points, zoom 10
_N = 1024


def _points(s, d):
    f = _features(s, d).where("type = 'Point'")
    return f.withColumn("feature", F.col("track_id") * 1000000 + F.col("feature"))


def _mvt(s, d):
    t = mvt_out.tiles(_points(s, d), 10, "points")
    return t.withColumn("key", F.col("x") * 10000 + F.col("y"))


_WX, _WY = "((x + 180) / 360 * 1024)", "((1 - ln(tan(radians(y)) + 1/cos(radians(y))) / pi()) / 2 * 1024)"
_MT = f"""(SELECT track_id * 1000000 + feature AS id, seq, tx, ty, (wx - tx) * 4096 AS px, (wy - ty) * 4096 AS py FROM (SELECT *, {_WX} AS wx, {_WY} AS wy FROM {_T} t0) t1,
 LATERAL (SELECT CAST(unnest(generate_series(CAST(floor(wx-64/4096e0) AS BIGINT), CAST(floor(wx+64/4096e0) AS BIGINT))) AS BIGINT) AS tx) a, LATERAL (SELECT CAST(unnest(generate_series(CAST(floor(wy-64/4096e0) AS BIGINT), CAST(floor(wy+64/4096e0) AS BIGINT))) AS BIGINT) AS ty) b)"""
_add("mvt_round_trip", lambda s, d: mvt.read(_mvt(s, d), "key", "content").select("key", "id", F.col("parts")[0][0]["x"].alias("px"), F.col("parts")[0][0]["y"].alias("py"), F.get_json_object("properties", "$.name").alias("name")),
     f"SELECT tx * 10000 + ty AS key, id, round_even(px, 0) AS px, round_even(py, 0) AS py, 'n' || seq % 3 AS name FROM {_MT} m")
_add("mvt_info", lambda s, d: mvt.info(mvt.read(_mvt(s, d), "key", "content"), "key"), f"SELECT tx * 10000 + ty AS key, 'points' AS layer, CAST(4096 AS INT) AS extent, CAST(2 AS INT) AS version, count(*) AS features, count(*) AS points, CAST(0 AS BIGINT) AS lines, CAST(0 AS BIGINT) AS polygons FROM {_MT} m GROUP BY 1")


def _mvt_degrees(s, d):
    f = mvt.read(_mvt(s, d), "key", "content").withColumns({"tx": F.floor(F.col("key") / 10000), "ty": F.col("key") % 10000})
    return mvt.to_wgs84(f, 10, "tx", "ty").select("key", "id", F.round(F.col("parts")[0][0]["x"], 6).alias("lng"), F.round(F.col("parts")[0][0]["y"], 6).alias("lat"))


_add("mvt_degrees", _mvt_degrees, f"SELECT tx * 10000 + ty AS key, id, round((tx + round_even(px, 0) / 4096) / 1024 * 360 - 180, 6) AS lng, round(degrees(2 * atan(exp(pi() * (1 - 2 * (ty + round_even(py, 0) / 4096) / 1024))) - pi() / 2), 6) AS lat FROM {_MT} m")
_add("mvt_geojson", lambda s, d: mvt.to_geojson(mvt.read(_mvt(s, d), "key", "content")).select("key", "id", F.get_json_object("feature", "$.geometry.type").alias("type"), F.get_json_object("feature", "$.geometry.coordinates[0]").cast("double").alias("px")),
     f"SELECT tx * 10000 + ty AS key, id, 'Point' AS type, round_even(px, 0) AS px FROM {_MT} m")

# ---------------------------------------------------------------- glTF, mesh tiles and polygons on the globe


def _each(df, key, order, work, schema):
    import pandas as pd

    kind = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)

    def run(pdf):
        out = work(pdf.sort_values(order))
        out.insert(0, key, pdf[key].iloc[0])
        return pd.DataFrame(out)

    return df.groupBy(key).applyInPandas(run, f"{key} {kind}, {schema}")


def _glb_points(s, d):
    import pandas as pd

    def work(p):
        scene, body = tiles.glb(tile_out.points_glb(p[["x", "y", "z"]].to_numpy(), p[["r", "g", "b"]].to_numpy()))
        a = scene["meshes"][0]["primitives"][0]["attributes"]
        xyz, rgba = tiles.accessor(scene, body, a["POSITION"]), tiles.accessor(scene, body, a["COLOR_0"])
        return pd.DataFrame({"i": range(len(xyz)), "x": xyz[:, 0].astype(float), "y": xyz[:, 1].astype(float), "r": rgba[:, 0].astype(int), "b": rgba[:, 2].astype(int)})

    out = _each(fixtures.spark(s, d, "cloud"), "cls", "idx", work, "i long, x double, y double, r int, b int")
    return out.select(F.col("cls").alias("file"), "i", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "r", "b")


_add("glb_points", _glb_points, f"SELECT cls AS file, i, round(CAST(x AS REAL)::DOUBLE, 4) AS x, round(CAST(y AS REAL)::DOUBLE, 4) AS y, r, b FROM {_FILE} f")


def _terrain_glb(s, d):
    import numpy as np
    import pandas as pd

    def work(p):
        h = p["z"].to_numpy().reshape(-1, 64)
        scene, body = tiles.glb(tile_out.terrain_glb(h))
        prim = scene["meshes"][0]["primitives"][0]
        n = tiles.accessor(scene, body, prim["attributes"]["NORMAL"])
        tri = tiles.accessor(scene, body, prim["indices"])
        r, c = np.indices(h.shape)
        return pd.DataFrame({"row": r.ravel(), "col": c.ravel(), "nx": n[:, 0].astype(float), "nz": n[:, 2].astype(float), "corners": len(tri)})

    out = _each(_blocks(s, d), "file", ["row", "col"], work, "row long, col long, nx double, nz double, corners long")
    return out.select("file", "row", "col", (F.round("nx", 4) + 0.0).alias("nx"), F.round("nz", 4).alias("nz"), "corners")


_add("terrain_glb", _terrain_glb, f"""SELECT file, "row", col, round(CAST((l-r)/2/n AS REAL)::DOUBLE, 4)+0.0 AS nx, round(CAST(1/n AS REAL)::DOUBLE, 4) AS nz, CAST(6*63*(h-1) AS BIGINT) AS corners FROM (SELECT *, sqrt(power((l-r)/2,2)+power((u-b)/2,2)+1) AS n FROM
(SELECT file, "row", col, max("row") OVER (PARTITION BY file) + 1 AS h, coalesce(lag(z) OVER a, z) AS l, coalesce(lead(z) OVER a, z) AS r, coalesce(lag(z) OVER d, z) AS u, coalesce(lead(z) OVER d, z) AS b FROM {_G.format(s=_src('grid'))} g WINDOW a AS (PARTITION BY file, "row" ORDER BY col), d AS (PARTITION BY file, col ORDER BY "row")) q) q2""")


def _mesh_tiles(s, d):
    """Each ring as a polygon on the globe, in a mesh tile read back: corners and triangles."""
    import json

    import pandas as pd

    def work(p):
        f = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": [p[["x", "y"]].to_numpy().tolist()]}, "properties": {"h": 100}}
        b, n = tile_out.polygon_tile([json.loads(json.dumps(f))], "h")
        table, _, content = tiles.tile(b, b"b3dm")
        scene, body = tiles.glb(content)
        prim = scene["meshes"][0]["primitives"][0]
        xyz, tri = tiles.accessor(scene, body, prim["attributes"]["POSITION"]), tiles.accessor(scene, body, prim["indices"])
        return pd.DataFrame({"seq": range(len(xyz)), "z": xyz[:, 2].astype(float), "features": table["BATCH_LENGTH"], "triangles": len(tri) // 3})

    r = fixtures.spark(s, d, "rings").select("geom_id", "seq", F.round("lng", 6).alias("x"), F.round("lat", 6).alias("y"))
    out = _each(r, "geom_id", "seq", work, "seq long, z double, features int, triangles int")
    return out.select("geom_id", "seq", (F.round(F.col("z") / 1000, 2) + 0.0).alias("z"), "features", "triangles")


_add("polygon_tiles", _mesh_tiles, f"""SELECT geom_id, seq, round(CAST(((6378137e0/sqrt(1-e2*sin(p)*sin(p)))*(1-e2)+100)*sin(p) AS REAL)::DOUBLE/1000, 2)+0.0 AS z, CAST(1 AS INT) AS features, CAST(10 AS INT) AS triangles
FROM (SELECT geom_id, seq, radians(round(lat, 6)) AS p, 1-(6356752.314245179e0*6356752.314245179e0)/(6378137e0*6378137e0) AS e2 FROM {_src('rings')}) t""")


def _instances(s, d):
    """Each class as instances of a one-triangle mesh: the tile's table read back."""
    import pandas as pd

    def work(p):
        glb = tile_out.mesh_glb([[0, 0, 0], [1, 0, 0], [0, 1, 0]], [0, 1, 2])
        quarter = [[0.0, 0.0, 0.5 ** 0.5, 0.5 ** 0.5]] * len(p)
        t, body, content = tiles.tile(tile_out.i3dm(glb, p[["x", "y", "z"]].to_numpy(), quarter, p["z"].to_numpy()), b"i3dm")
        import numpy as np
        n = t["INSTANCES_LENGTH"]
        at = lambda name, w: np.frombuffer(body, "<f4", n * w, t[name]["byteOffset"]).reshape(n, w).astype(float)
        return pd.DataFrame({"i": range(n), "x": at("POSITION", 3)[:, 0], "up": at("NORMAL_UP", 3)[:, 0], "right": at("NORMAL_RIGHT", 3)[:, 1], "scale": at("SCALE", 1)[:, 0], "whole": content == glb})

    out = _each(fixtures.spark(s, d, "cloud"), "cls", "idx", work, "i long, x double, up double, right double, scale double, whole boolean")
    return out.select(F.col("cls").alias("file"), "i", F.round("x", 4).alias("x"), F.round("up", 4).alias("up"), F.round("right", 4).alias("right_"), F.round("scale", 4).alias("scale"), "whole")


_add("instance_tiles", _instances, f"SELECT cls AS file, i, round(CAST(x AS REAL)::DOUBLE, 4) AS x, -1.0e0 AS up, 1.0e0 AS right_, round(CAST(z AS REAL)::DOUBLE, 4) AS scale, true AS whole FROM {_FILE} f")


def _pnts_normals(s, d):
    """Point tiles with normals: the packed bytes read back as codes."""
    import numpy as np
    import pandas as pd

    def work(p):
        n = p[["nx", "ny", "nz"]].to_numpy()
        t, body, _ = tiles.tile(tile_out.pnts(p[["x", "y", "z"]].to_numpy(), None, n), b"pnts")
        code = np.frombuffer(body, np.uint8, 2 * len(n), t["NORMAL_OCT16P"]["byteOffset"]).reshape(-1, 2).astype(int)
        return pd.DataFrame({"idx": p["idx"], "code": code[:, 0] * 256 + code[:, 1]})

    from .scalars import _unit
    u = _unit(s, d).select("idx", *(F.col(a).alias(f"n{a}") for a in "xyz"))
    c = fixtures.spark(s, d, "cloud").select("idx", "cls", *"xyz").join(u, "idx")
    return _each(c, "cls", "idx", work, "idx long, code int").select("idx", "code")


def _register_normals():
    from .scalars import _OCT
    _add("pnts_normals", _pnts_normals, f"SELECT * FROM {_OCT} e")


_register_normals()


def _ifc(s, d):
    """A building of one solid a nation: a rectangle of so many by half as many, extruded."""
    n = s.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("long").alias("id"))
    w = (F.col("id") + 2).cast("string")
    text = F.concat(F.lit("ISO-10303-21;\nDATA;\n#1=IFCRECTANGLEPROFILEDEF(.AREA.,'a;b',$,"), w, F.lit(".,"), (F.col("id") + 1).cast("string"), F.lit(".5);\n#2=IFCDIRECTION((0.,0.,1.));\n#3=IFCEXTRUDEDAREASOLID(#1,$,\n#2,"), w, F.lit(".25);\nENDSEC;"))
    t = tracks.read_ifc(n.select("id", text.alias("text")), "id", "text")
    return t.groupBy("id", "solid").agg(F.count(F.lit(1)).alias("corners"), F.max("x").alias("x"), F.max("y").alias("y"), F.max("z").alias("z"))


_add("ifc_solids", _ifc, "SELECT CAST(n_nationkey AS BIGINT) AS id, CAST(3 AS BIGINT) AS solid, CAST(36 AS BIGINT) AS corners, (n_nationkey + 2) / 2e0 AS x, (n_nationkey + 1.5e0) / 2e0 AS y, n_nationkey + 2.25e0 AS z FROM nation")


def _chunked(s, d):
    from ..streaming.worker import process_chunked
    import pandas as pd

    c = fixtures.spark(s, d, "cloud").select("idx", "x")
    return process_chunked(c, 1000, lambda p: pd.DataFrame({"idx": p["idx"], "twice": p["x"] * 2}), "idx long, twice double").select("idx", F.round("twice", 6).alias("twice"))


_add("process_chunked", _chunked, f"SELECT idx, round(x * 2, 6) AS twice FROM {_src('cloud')}")
