"""Formats on hand-made files: what is broken, empty, of the other byte order, or cut off."""

import json
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoloom.operators import meshing, planar
from geoloom.sinks import geotiff as tiff_out
from geoloom.sinks import las as las_out
from geoloom.sinks import meshes as mesh_out
from geoloom.functions import limits
from geoloom.sinks import mvt as mvt_out
from geoloom.sinks import tiles as tile_out
from geoloom.sources import BadFile, NoCodec, geojson, geotiff, las, meshes, mvt, tiles, tracks, wkt


def test_geojson_shapes():
    text = json.dumps({"x": {"features": [1]}, "type": "FeatureCollection", "features": [
        {"type": "Feature", "geometry": None, "properties": None}, {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1, 2, 3]}, "properties": {"a": "}],"}},
        {"type": "Feature", "geometry": {"type": "MultiPolygon", "coordinates": [[[[0, 0], [1, 0], [1, 1], [0, 0]]], [[[5, 5], [6, 5], [6, 6], [5, 5]]]]}},
        {"type": "Feature", "geometry": {"type": "GeometryCollection", "geometries": [{"type": "Point", "coordinates": [9, 9]}, {"type": "LineString", "coordinates": [[1, 1], [2, 2]]}]}, "properties": {}}]})
    rows = [r for f in geojson.parse(text, 2) for r in f.itertuples(index=False)]
    assert [r.type for r in rows] == ["Unknown", "Point", "MultiPolygon", "GeometryCollection"] and [len(r.coords) for r in rows] == [0, 1, 8, 3]
    assert rows[1].coords[0] == {"x": 1.0, "y": 2.0} and rows[0].properties is None
    assert len(list(geojson.features('{"type":"Point","coordinates":[1,2]}'))) == 1 and list(geojson.features('{"type":"FeatureCollection","features":[]}')) == []
    for bad in ("", "[1", '{"type":"FeatureCollection"}', '{"type":"FeatureCollection","features":[{"type":"Feature"}', "{}"):
        with pytest.raises(BadFile):
            list(geojson.features(bad))


def test_wkt_and_wkb():
    assert wkt.parse_wkt("POINT ZM (1 2 3 4)") == ("POINT", [[(1.0, 2.0)]])
    assert wkt.parse_wkt("MULTIPOINT((1 2),(3 4))") == wkt.parse_wkt(" multipoint ( 1 2 , 3 4 ) ") == ("MULTIPOINT", [[(1.0, 2.0), (3.0, 4.0)]])
    assert wkt.parse_wkt("POLYGON Z((0 0 9,1 0 9,1 1 9,0 0 9),(.2 .1 1,.3 .1 1,.3 .2 1,.2 .1 1))")[1][1][0] == (0.2, 0.1)
    assert wkt.parse_wkt("LINESTRING EMPTY") == ("LINESTRING", [])
    for bad in ("junk", "POINT(1)", "POINT(a b)", "POLYGON((0 0,1 1", "CIRCLE(1 2)", "POLYGON(0 0, 1 1)"):
        with pytest.raises(BadFile):
            wkt.parse_wkt(bad)
    assert wkt.parse_wkb(struct.pack(">BIIdddd", 0, 2, 2, 1, 2, 3, 4)) == ("LINESTRING", [[(1.0, 2.0), (3.0, 4.0)]])
    assert wkt.parse_wkb(struct.pack("<BIddd", 1, 0x80000001, 1, 2, 3)) == wkt.parse_wkb(struct.pack("<BIddd", 1, 1001, 1, 2, 3)) == ("POINT", [[(1.0, 2.0)]])
    for bad in (b"", b"\x05", struct.pack("<BI", 1, 9), struct.pack("<BII", 1, 2, 5), struct.pack("<BIIIdd", 1, 3, 1, 4, 1, 2)):
        with pytest.raises(BadFile):
            wkt.parse_wkb(bad)


def _cloud(n=10):
    return pd.DataFrame({"x": np.arange(n) * 1.5, "y": np.arange(n) - 3.25, "z": np.arange(n) * 0.001, "r": np.arange(n), "g": 255 - np.arange(n), "b": 7, "cls": 2})


def test_las(spark, tmp_path):
    b = las_out.encode(_cloud())
    h = las.header(b)
    assert (h.n_points, h.point_format, h.record_length) == (10, 2, 26) and las.detect(b) == "las"
    one = pd.concat(las.parse(b, chunk=3))
    assert np.allclose(one[["x", "y", "z"]], _cloud()[["x", "y", "z"]]) and one["g"].tolist() == (255 - np.arange(10)).tolist()
    assert len(pd.concat(las.parse(b[:-30]))) == 8 and [r for f in las.parse(b, 4, 3) for r in f["idx"]] == [4, 5, 6]
    assert list(las.parse(las_out.encode(_cloud(0)))) == []
    packed = bytearray(b)
    packed[104] |= 0x80
    assert las.detect(bytes(packed)) == "laz"
    with pytest.raises(NoCodec):
        list(las.parse(bytes(packed)))
    for bad in (b"", b"LASF", b"x" * 300):
        with pytest.raises(BadFile):
            las.header(bad)
    copc = bytearray(packed)
    copc[25] = 4
    assert las.detect(bytes(copc)) == "copc" and las.copc(bytes(copc))["chunkTable"][0]["offset"] == 227
    (tmp_path / "a.las").write_bytes(las_out.encode(_cloud(25)))
    (tmp_path / "b.las").write_bytes(b)
    got = las.read_ranges(spark, str(tmp_path), 4).toPandas()
    assert sorted(got.groupby("path")["idx"].apply(lambda s: sorted(s.tolist())).tolist(), key=len) == [list(range(10)), list(range(25))]


def test_las_stream(spark, tmp_path):
    from geoloom.streaming import points

    (tmp_path / "a.las").write_bytes(las_out.encode(_cloud(25)))
    reader = points._Reader({"path": str(tmp_path / "a.las"), "pointsPerBatch": "10"})
    at, seen = reader.initialOffset(), []
    for _ in range(4):
        rows, end = reader.read(at)
        seen += [r[0] for r in rows]
        assert [r[0] for r in reader.readBetweenOffsets(at, end)] == list(range(at["point"], end["point"]))
        at = end
    assert seen == list(range(25)) and at == {"point": 25}
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.las").write_bytes(las_out.encode(_cloud(7)))
    q = points.point_files(spark, str(folder)).writeStream.format("memory").queryName("las_in").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    assert spark.table("las_in").count() == 7


def test_meshes(spark):
    p = _cloud()
    for b, read in ((mesh_out.ply(p), meshes.ply), (mesh_out.pcd(p), meshes.pcd), (mesh_out.pcd(p, False), meshes.pcd)):
        got = pd.concat(read(b))
        assert np.allclose(got[["x", "y", "z"]].astype(float), p[["x", "y", "z"]], atol=1e-5) and got["g"].tolist() == p["g"].tolist()
    text = b"ply\r\nformat ascii 1.0\r\nelement vertex 2\r\nproperty float x\r\nproperty float y\r\nproperty float z\r\nelement face 3\r\nproperty list uchar int vertex_indices\r\nend_header\r\n1 2 3\r\n4 x 6\r\n3 0 1 2\r\n"
    got = pd.concat(meshes.ply(text))
    assert got[["x", "y", "z"]].astype(float).values.tolist() == [[1, 2, 3], [4, 0, 6]] and meshes.ply_header(text)["faces"] == 3 and got["r"].isna().all()
    for bad in (b"", b"ply\nformat binary_big_endian 1.0\nend_header\n", b"ply\nformat ascii 1.0\nelement vertex 1\nproperty float x\nend_header\n1\n", mesh_out.ply(p)[:-5]):
        with pytest.raises(BadFile):
            list(meshes.ply(bad))
    blank = b"# c\nFIELDS x y z\n\nPOINTS 2\nDATA ascii\n1 2 3\n4 5\nn 8 9\n"
    assert pd.concat(meshes.pcd(blank))[["x", "y", "z"]].astype(float).values.tolist() == [[1, 2, 3], [0, 8, 9]]
    with pytest.raises(BadFile):
        list(meshes.pcd(b"FIELDS a b\nDATA ascii\n"))
    with pytest.raises(NoCodec):
        meshes.e57(b"ASTM-E57" + bytes(40))
    texts = spark.createDataFrame([(1, "# c\nv 1 2 3\nv x 2 3\nvn 0 0 1\nf 1 2 3\nv 4 5 6\r\nvn 0 1 0"), (2, "v 1 2 3\nv 2 2 2\nvn 0 0 1"), (3, "")], "k int, t string")
    got = sorted((r.k, r.idx, r.x, r.nz) for r in meshes.read_obj(texts, "k", "t").collect() if r.k == 1)
    assert got == [(1, 0, 1.0, 1.0), (1, 1, 4.0, 0.0)]
    assert [r.nz for r in meshes.read_obj(texts, "k", "t").where("k = 2").collect()] == [None, None]


@pytest.mark.parametrize("how", [{}, {"order": ">"}, {"tile": 16}, {"deflate": False, "rows": 3}])
def test_geotiff(how):
    g = (np.arange(35 * 20).reshape(35, 20) * 0.5 - 40).astype(np.float32)
    b = tiff_out.encode(g, (10.0, 20.0, 30.0, 55.0), **how)
    got = pd.concat(geotiff.parse(b)).sort_values(["row", "col"])
    assert np.array_equal(got["z"].to_numpy().reshape(35, 20), g)
    i = geotiff.info(b)
    assert i.bounds == (10.0, 20.0, 30.0, 55.0) and i.resolution == (1.0, 1.0) and i.geo[2048] == 4326
    with pytest.raises(BadFile):
        geotiff.block(b, i, 999)
    with pytest.raises(BadFile):
        list(geotiff.parse(b[:60]))


def test_geotiff_broken():
    for bad in (b"", b"II*\0", b"MM\0+" + bytes(8), b"II*\0\xff\xff\0\0"):
        with pytest.raises(BadFile):
            geotiff.info(bad)
    assert geotiff.info(tiff_out.encode(np.zeros((2, 2), np.float32))).bounds == (0.0, 0.0, 1.0, 1.0)


def test_topojson_and_gpx(spark):
    t = json.dumps({"type": "Topology", "objects": {"a": {"type": "GeometryCollection", "geometries": [{"type": "LineString", "arcs": [0, -2], "id": 7, "properties": {"p": 1}}, {"type": "Point", "coordinates": [1, 1]}, {"type": "MultiPolygon", "arcs": [[[0]], [[1]]]}]}}, "arcs": [[[0, 0], [1, 0]], [[5, 5], [1, 0]]]})
    parts = [(g["type"], p) for _, g, p in tracks.topology(t)]
    assert parts[0] == ("LineString", [[(0.0, 0.0), (1.0, 0.0), (5.0, 5.0)]]) and len(parts[2][1]) == 2
    f = json.loads(tracks.to_geojson(t))["features"]
    assert f[0]["id"] == 7 and f[2]["geometry"]["coordinates"][1][0][0] == [5.0, 5.0]
    for bad in ("", "{}", t.replace("[0, -2]", "[9]")):
        with pytest.raises(BadFile):
            tracks.to_geojson(bad)
    gpx = spark.createDataFrame([(1, "<trkpt lat='1' lon='2'/><trkpt lon=\"4\" lat=\"3\">\n<ele>5</ele><time>t</time></trkpt><trkpt lat='x' lon='1'></trkpt>"), (2, None), (3, "")], "k int, t string")
    assert [(r.k, r.lng, r.lat, r.ele, r.time) for r in tracks.read_gpx(gpx, "k", "t").collect()] == [(1, 2.0, 1.0, 0.0, None), (1, 4.0, 3.0, 5.0, "t")]


def test_ifc():
    text = "#1=IFCCARTESIANPOINT((0.,0.));#2=IFCCARTESIANPOINT((2.,0.));#3=IFCCARTESIANPOINT((2.,1.));#4=IFCPOLYLINE((#1,#2,#3,#1));#5=IFCARBITRARYCLOSEDPROFILEDEF(.AREA.,$,#4);#6=IFCEXTRUDEDAREASOLID(#5,$,$,3.);#7=IFCEXTRUDEDAREASOLID(#99,$,$,3.);"
    (i, p, d, depth), = tracks.ifc_solids(text)
    t = meshing.prism(p, d, depth)
    assert (i, len(p), depth) == (6, 3, 3.0) and len(t) == 3 * 8
    v = t.reshape(-1, 3, 3)
    assert abs(np.einsum("ij,ij->i", v[:, 0], np.cross(v[:, 1], v[:, 2])).sum() / 6 - 3.0) < 1e-9  # the volume, all walls facing outwards


def test_ears():
    star = [(0, 0), (4, 0), (4, 4), (2, 1), (0, 4)]
    for ring in (star, star[::-1], [*star, star[0]]):
        p = np.array(ring, float)
        t = meshing.ears(ring)
        a = p[t]
        assert len(t) == 3 and abs(_area([planar.closed(r) for r in a]) - 10) < 1e-9
    assert len(meshing.ears([(0, 0), (1, 1), (2, 2)])) == 0


def test_tiles():
    xyz = np.random.default_rng(1).normal(size=(50, 3)) * 100 + 1e6
    got, = tiles.pnts(tile_out.pnts(xyz, np.full((50, 3), 9)))
    assert np.abs(got[["x", "y", "z"]].to_numpy() - xyz).max() < 1e-3 and (got["r"] == 9).all()
    for b in (tile_out.pnts(xyz), tile_out.b3dm(tile_out.points_glb(xyz), 3, {"a": [1, 2, 3]})):
        assert struct.unpack_from("<I", b, 8)[0] == len(b)
    with pytest.raises(ValueError):
        tile_out.b3dm(b"nope")
    text, content = tile_out.mesh_tileset([[0, 0, 0], [2, 0, 0], [0, 4, 0]], [0, 1, 2], error=5.0)
    assert json.loads(text)["root"]["boundingVolume"]["box"][:3] == [1.0, 2.0, 0.0] and tiles.tile(content, b"b3dm")[2][:4] == b"glTF"
    text, many = tile_out.instanced_tileset(tile_out.points_glb(xyz), [np.eye(4).ravel()] * 3)
    assert len(many) == len(json.loads(text)["root"]["children"]) == 3
    g = tile_out.Gltf()
    g.add_mesh([[0, 0, 0], [1, 0, 0], [0, 1, 0]], [0, 1, 2], material=g.add_material((1, 0, 0, 1)))
    assert json.loads(g.to_json())["meshes"][0]["primitives"][0]["material"] == 0


def test_tileset_nests(spark):
    from geoloom.operators import points

    cloud = spark.createDataFrame([(i, (i * 7919 % 101) / 101, (i * 104729 % 103) / 103, (i * 31 % 97) / 97) for i in range(300)], "idx long, x double, y double, z double")
    rows = tile_out.tileset(points.octree(cloud, 20, 8)).collect()
    top = json.loads(tile_out.tileset_json(rows))["root"]

    def leaves(n):
        return [n["content"]["uri"]] if "content" in n else [u for c in n["children"] for u in leaves(c)]
    made = {f"tile_{r.path}.pnts": r.n for r in tile_out.point_tiles(cloud, 20, 8).collect()}
    assert sorted(leaves(top)) == sorted(made) and sum(made.values()) == 300 and max(made.values()) <= 20


def test_mvt_shapes():
    layers = {"a": [(5, 2, [[(0, 0), (10, 0), (10, 5)], [(7, 7), (8, 9)]], {"n": 3, "t": "x", "f": 0.5, "b": True, "none": None}), (6, 3, [[(0, 0), (4, 0), (4, 4), (0, 0)]], {"n": -3})], "b": [(None, 1, [[(1, 2), (3, 4)]], {})]}
    got = {name: f for name, _, _, f in mvt.layers(mvt_out.encode(layers))}
    assert got["a"][0] == (5, 2, layers["a"][0][2], {"n": 3, "t": "x", "f": 0.5, "b": True}) and got["a"][1][2:] == ([[(0, 0), (4, 0), (4, 4), (0, 0)]], {"n": -3}) and got["b"][0][:3] == (None, 1, [[(1, 2), (3, 4)]])
    assert mvt_out.clip_line([(-10, 5), (20, 5), (20, 50)], 0, 10) == [[(0.0, 5.0), (10.0, 5.0)]]
    assert sorted(mvt_out.clip_ring([(-5, -5), (5, -5), (5, 5), (-5, 5), (-5, -5)], 0, 10)[:-1]) == [(0.0, 0.0), (0.0, 5.0), (5.0, 0.0), (5.0, 5.0)]
    for bad in (b"\x1a\xff", b"\x1a\x05\x0a\x99", b"\x1f"):
        with pytest.raises(BadFile):
            list(mvt.layers(bad))
    assert list(mvt.layers(b"")) == []
    asked = []
    cache = mvt.TileCache(lambda z, x, y: asked.append((z, x, y)) or (z, x, y), 2)
    assert [cache.get(0, 0, 0), cache.get(0, 0, 0), cache.get(1, 0, 0), cache.get(2, 0, 0)][0] == (0, 0, 0) and len(cache) == 2 and len(asked) == 3
    cache.get(0, 0, 0)
    cache.clear()
    assert len(asked) == 4 and len(cache) == 0


def test_vector_tiles_of_lines(spark):
    f = spark.createDataFrame([(1, "LineString", [(-170.0, 10.0), (170.0, 10.0)], None), (2, "Polygon", [(-10.0, -10.0), (10.0, -10.0), (10.0, 10.0), (-10.0, 10.0), (-10.0, -10.0)], '{"a":1}'), (3, "Unknown", [], None)], "feature long, type string, coords array<struct<x:double,y:double>>, properties string")
    t = mvt_out.tiles(f, 1)
    assert sorted((r.x, r.y) for r in t.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]
    rows = mvt.read(t.withColumn("k", F.col("x") * 2 + F.col("y")), "k", "content")
    assert sorted((r.k, r.id) for r in rows.collect()) == [(0, 1), (0, 2), (1, 2), (2, 1), (2, 2), (3, 2)]


def test_worker(spark):
    from geoloom.streaming import worker

    w = worker.Worker(spark)
    assert w.submit(lambda s: s.range(1000).count()).wait(60) == 1000 and worker.supports_worker()
    with pytest.raises(ZeroDivisionError):
        w.submit(lambda s: 1 / 0).wait(60)
    w.terminate()
    with pytest.raises(RuntimeError):
        w.submit(lambda s: 1)
    seen = []
    assert worker.for_each_chunk(spark.range(25), 10, "id", lambda p, done, total: seen.append((len(p), done, total))) == 25
    assert seen == [(10, 10, 25), (10, 20, 25), (5, 25, 25)]


SQUARE = np.array([(0, 0), (4, 0), (4, 4), (0, 4)], float)


def _area(rings):
    return sum((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum() / 2 for r in rings)


@pytest.mark.parametrize("other, both, touches", [
    ([(2, 2), (6, 2), (6, 6), (2, 6)], 4, False), ([(4, 0), (8, 0), (8, 4), (4, 4)], 0, True), ([(5, 5), (6, 5), (6, 6), (5, 6)], 0, False), ([(1, 1), (2, 1), (2, 2), (1, 2)], 1, False),
    ([(0, 0), (4, 0), (4, 4), (0, 4)], 16, False), ([(4, 4), (5, 4), (5, 5), (4, 5)], 0, True), ([(-1, 1), (5, 1), (5, 2), (-1, 2)], 4, False), ([(0, 0), (4, 0), (4, 2), (0, 2)], 8, False), ([(-1, -1), (9, -1), (9, 9), (-1, 9)], 16, False)])
def test_overlay(other, both, touches):
    b = np.array(other, float)
    for x, y in ((SQUARE, b), (b, SQUARE), (SQUARE[::-1], b), (planar.closed(SQUARE), planar.closed(b))):
        area = abs(_area([planar.closed(b)]))
        assert abs(_area(planar.overlay(x, y, False)) - both) < 1e-9
        assert abs(_area(planar.overlay(x, y, True)) - (16 + area - both)) < 1e-9
        meet, inside = planar.relation(x, y)
        assert inside == (both > 0) and (meet and not inside) == touches


def test_overlay_of_random_rings():
    rng = np.random.default_rng(5)
    for _ in range(20):
        a, b = ([(cx + r * np.cos(t), cy + r * np.sin(t)) for t, r in zip(np.sort(rng.random(9)) * 6.2, rng.random(9) + 0.5)] for cx, cy in rng.normal(size=(2, 2)) * 0.5)
        grid = rng.random((4000, 2)) * 6 - 3
        inside = np.array([[planar.locate(np.array(r), p) > 0 for p in grid] for r in (a, b)])
        for union, want in ((False, inside.all(axis=0).mean()), (True, inside.any(axis=0).mean())):
            assert abs(_area(planar.overlay(a, b, union)) - 36 * want) < 0.9
        whole = abs(_area([planar.closed(np.array(a))])) + abs(_area([planar.closed(np.array(b))]))
        assert abs(_area(planar.overlay(a, b, True)) + _area(planar.overlay(a, b, False)) - whole) < 1e-6


def test_hulls_and_lines():
    p = np.array([(x, y) for x in range(5) for y in range(5)], float)
    assert sorted(map(tuple, planar.hull(p).tolist())) == [(0, 0), (0, 4), (4, 0), (4, 4)]
    assert len(planar.hull(p[:2])) == 2 and len(planar.hull(np.array([(0, 0), (1, 1), (2, 2)], float))) == 2
    c = planar.concave(np.array([(0, 0), (10, 0), (10, 10), (0, 10), (5, 2)], float), 0.3)
    assert (5, 2) in set(map(tuple, c.tolist())) and len(planar.concave(p, 2000)) == 4
    line = np.array([(0, 0), (1, 0.1), (2, -0.1), (3, 5), (4, 6), (5, 7), (6, 8.1), (7, 9), (8, 9), (9, 9)], float)
    assert planar.simplified(line, 1.0).tolist() == [0, 2, 3, 6, 9] or set(planar.simplified(line, 1.0)) >= {0, 9}
    assert planar.simplified(line, 1e9).tolist() == [0, 9] and len(planar.simplified(line, 0.0)) >= 8
    t = planar.delaunay(np.random.default_rng(2).random((60, 2)))
    assert len(t) == 2 * 60 - 2 - len(planar.hull(np.random.default_rng(2).random((60, 2))))
    with pytest.raises(ValueError):
        planar.delaunay(np.zeros((2, 2)))


def test_normals_of_a_plane(spark):
    rows = [(i, float(i % 12), float(i // 12), 2.0 * (i % 12) - 0.5 * (i // 12) + 7) for i in range(144)]
    got = planar.normals(spark.createDataFrame(rows, "idx long, x double, y double, z double"), 8).collect()
    n = np.array([2.0, -0.5, -1.0]) / np.linalg.norm([2.0, -0.5, -1.0])
    assert len(got) == 144 and all(abs(r.nx - n[0]) < 1e-6 and abs(r.ny - n[1]) < 1e-6 and abs(r.nz - n[2]) < 1e-6 for r in got)


_STEP_Y = 454
_TIED_LINES = [
    ([8, 607, 566, 838, 844, 529, 279, 563, 328, 680, 336, 294, 129, 528, 550, 941], [0, 1, 2, 3, 4, 5, 10, 11, 12, 13, 15]),
    ([175, 566, 674, 641, 4, 902, 170, 473, 941, 94, 374, 785, 241, 39, 539, 870], [0, 2, 4, 5, 6, 7, 8, 9, 10, 11, 13, 15]),
    ([641, 95, 988, 911, 36, 391, 368, 973, 245, 940, 530, 710, 808, 435, 964, 956], [0, 1, 2, 4, 5, 6, 9, 10, 12, 13, 14, 15]),
]


def test_simplified_takes_the_first_of_equally_far_positions():
    """Lines on which rounding decided between positions at the same distance; what SQL keeps."""
    for ids, want in _TIED_LINES:
        p = np.array([(116.0 + x / 997.0, 39.0 + (x * _STEP_Y) % 997 / 997.0) for x in ids])
        assert planar.simplified(p, 0.2).tolist() == want


def _some_segments():
    """Segments from a point to one across the whole plane, and boxes of all sizes."""
    r = np.random.default_rng(5)
    a = r.uniform(-40, 40, (300, 2))
    e = a + r.uniform(-1, 1, (300, 2)) * 10.0 ** r.uniform(-2, 1.5, (300, 1))
    lines = [(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(a, e))] + [(300, -1e7, -1e7, 1e7, 1e7), (301, 3.0, 3.0, 3.0, 3.0), (302, 8.0, 0.0, 0.0, 8.0)]
    lo = r.uniform(-45, 45, (40, 2))
    boxes = [(i, *map(float, (*p, *q))) for i, (p, q) in enumerate(zip(lo, lo + 10.0 ** r.uniform(-2, 2, (40, 2))))] + [(40, 3.0, 3.0, 3.0, 3.0), (41, 5.0, 5.0, 4.0, 6.0), (42, 8.0, 8.0, 9.0, 9.0)]
    return lines, boxes


def test_segments_of_any_size_in_boxes(spark):
    lines, boxes = _some_segments()
    s, b = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double"), spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double")
    env = [(i, min(p, r), min(q, t), max(p, r), max(q, t)) for i, p, q, r, t in lines]
    meets = sorted((k, i) for i, u0, v0, u1, v1 in env for k, x0, y0, x1, y1 in boxes if x0 <= x1 and y0 <= y1 and u1 >= x0 and u0 <= x1 and v1 >= y0 and v0 <= y1)
    inside = sorted((k, i) for i, u0, v0, u1, v1 in env for k, x0, y0, x1, y1 in boxes if u0 >= x0 and u1 <= x1 and v0 >= y0 and v1 <= y1)
    for within, want in ((False, meets), (True, inside)):
        found = planar.segments_in_boxes(s, b, 1.0, within)
        assert sorted((r.box, r.id) for r in found.collect()) == want and "Aggregate" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert planar.segments_in_boxes(s.limit(0), b, 1.0, False).count() == 0 and planar.segments_in_boxes(s, b.limit(0), 1.0, False).count() == 0


def test_nearest_of_segments_of_any_size(spark):
    lines, boxes = _some_segments()
    s = spark.createDataFrame(lines, "id long, x1 double, y1 double, x2 double, y2 double")
    own = [(i, x0, y0) for i, x0, y0, _, _ in boxes] + [(50, 3000.0, -3000.0), (51, -60.0, 77.0)]

    def d2(x, y, x1, y1, x2, y2):
        n = (x2 - x1) ** 2 + (y2 - y1) ** 2
        t = min(max(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / n, 0.0), 1.0) if n else 0.0
        return (x - x1 - t * (x2 - x1)) ** 2 + (y - y1 - t * (y2 - y1)) ** 2

    got = {r.qid: r for r in planar.nearest_segment(s, spark.createDataFrame(own, "qid long, qx double, qy double"), 0.5).collect()}
    assert len(got) == len(own)
    for k, x, y in own:
        near = {i: d2(x, y, *v) for i, *v in lines}
        assert abs(got[k].d2 - min(near.values())) < 1e-6 and near[got[k].id] - min(near.values()) < 1e-6


def test_obj_in_parts(spark):
    """Normals in parts of their own are joined, a file without as many has none, a file of
    many points has many parts, and all lines come back by their order."""
    texts = spark.createDataFrame([(1, 2, "vn 0 0 1\nv 3 0 0"), (1, 0, "v 1 0 0\nv 2 0 0"), (1, 5, "vn 0 1 0\nvn 1 0 0"), (2, 0, "v 1 0 0\nvn 0 0 1"), (2, 1, "v 2 0 0")], "k int, p long, t string")
    got = sorted((r.k, r.idx, r.x, r.nx, r.ny, r.nz) for r in meshes.read_obj(texts, "k", "t", "p").collect())
    assert got == [(1, 0, 1.0, 0.0, 0.0, 1.0), (1, 1, 2.0, 0.0, 1.0, 0.0), (1, 2, 3.0, 1.0, 0.0, 0.0), (2, 0, 1.0, None, None, None), (2, 1, 2.0, None, None, None)]
    cloud = spark.range(60_000).selectExpr("if(id < 100, 'a', 'b') AS k", "id AS o", "double(id) AS x", "0e0 AS y", "1e0 AS z", "0e0 AS nx", "0e0 AS ny", "double(id % 7) AS nz")
    files = mesh_out.obj(cloud, "k", "o", True)
    assert files.where("k = 'b'").count() > 4
    back = meshes.read_obj(files, "k", "text", "part")
    assert back.count() == 60_000 and back.where("x <> idx + if(k = 'a', 0, 100) OR nz <> cast(x AS long) % 7").count() == 0


@pytest.mark.parametrize("binary", [False, True])
def test_pcd_in_parts(spark, binary):
    """A file that as a whole is beyond the input limit: no part of it is."""
    cloud = spark.range(40_000).selectExpr("if(id < 100, 'a', 'b') AS k", "id AS o", "double(id) AS x", "0.25e0 AS y", "double(-id) AS z", "int(id % 256) AS r", "int(1) AS g", "int(2) AS b")
    files = mesh_out.pcd_parts(cloud, "k", "o", binary).cache()
    whole = b"".join(bytes(r.content) for r in files.where("k = 'a'").orderBy("part").collect())
    want = pd.DataFrame({"x": np.arange(100.0), "y": 0.25, "z": 0.0 - np.arange(100.0), "r": np.arange(100), "g": 1, "b": 2})
    assert whole == mesh_out.pcd(want, binary)
    limits.set_input_size_limit(500_000)
    try:
        back = meshes.read_pcd(files, "k", "content", "part")
        assert back.count() == 40_000 and back.where("x <> idx + if(k = 'a', 0, 100) OR z <> -x OR r <> cast(x AS long) % 256 OR g <> 1").count() == 0
        with pytest.raises(Exception, match="InputTooLarge"):
            meshes.read_pcd(spark.createDataFrame([("b", bytearray(mesh_out.pcd(pd.concat([want] * 400), False)))], "k string, content binary"), "k", "content").count()
    finally:
        limits.set_input_size_limit(limits.DEFAULT_INPUT_LIMIT)


def test_equal_pairs_are_overlaid_once(spark, monkeypatch):
    """Pairs of a batch that are equal are worked out once; an empty ring and a null are no shape."""
    import pyarrow as pa

    seen = []
    ring = lambda *p: [{"x": float(x), "y": float(y)} for x, y in p]
    one, two = ring((0, 0), (4, 0), (4, 4), (0, 4), (0, 0)), ring((2, 2), (6, 2), (6, 6), (2, 6))
    kind = pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))
    got = planar._once(lambda u, v: seen.append(1) or len(u) * 10 + len(v), pa.int64())(pa.array([None, one, two, one, one, []], kind).slice(1), pa.array([one, two, one, two, one, None], kind).slice(1))
    assert got.to_pylist() == [54, 45, 54, 55, 0] and len(seen) == 4
    rows = spark.createDataFrame([(1, one, two), (2, one, two), (3, one, []), (4, None, two)], "i int, a array<struct<x:double,y:double>>, b array<struct<x:double,y:double>>")
    for union, want in ((True, [28.0, 28.0, 16.0, 16.0]), (False, [4.0, 4.0, 0.0, 0.0])):
        found = rows.select("i", planar.overlaid(F.col("a"), F.col("b"), union).alias("r")).orderBy("i").collect()
        assert [abs(_area([np.array([(p.x, p.y) for p in q]) for q in r.r])) for r in found] == want
    assert [tuple(r.r) for r in rows.select("i", planar.relate(F.col("a"), F.col("b")).alias("r")).orderBy("i").collect()] == [(True, False, False)] * 2 + [(False, False, True)] * 2


def test_mvt_of_many_features_is_encoded_in_proportion():
    """Ten times the features take about ten times as long, not a hundred times."""
    import time

    def seconds(n):
        features = [(i, 1, [[(i % 4096, i * 7 % 4096)]], {"k": i % 5, "name": f"n{i % 3}"}) for i in range(n)]
        began = time.process_time()
        tile = mvt_out.encode({"points": iter(features)})
        took = time.process_time() - began
        (name, _, _, back), = mvt.layers(tile)
        assert name == "points" and back == features
        return took

    assert seconds(150_000) < 30 * max(seconds(15_000), 0.01)


def test_normals_by_all_pairs(spark):
    """Across blocks, with strays far off and copies: the k nearest others, ties by idx; a point
    whose copies come first by idx has k others too."""
    rng = np.random.default_rng(8)
    p = np.concatenate([rng.uniform(-40, 40, (900, 3)), [(500.0, -300.0, 20.0)], np.repeat([[1.0, 2.0, 3.0]], 6, axis=0), rng.integers(0, 4, (120, 3)) * 0.5])
    got = {r.idx: (r.nx, r.ny, r.nz) for r in planar.normals(spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(p)] + [(5000, float("nan"), 0.0, 0.0)], "idx long, x double, y double, z double"), 5, 0.9).collect()}
    assert sorted(got) == list(range(len(p)))
    for i, v in enumerate(p):
        d = ((p - v) ** 2).sum(axis=1)
        near = [j for j in np.lexsort((np.arange(len(p)), d)) if j != i][:5]
        m = np.cov(p[near].T, bias=True)
        least = np.linalg.eigvalsh(m)[0]
        assert abs(np.array(got[i]) @ m @ np.array(got[i]) - least) < 1e-9 * max(1.0, np.trace(m))
