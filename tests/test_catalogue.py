"""Every query with SQL against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from geoloom.plans import catalogue, formats, geometry, scalars, texts  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    got, want = catalogue.QUERIES[name](spark, SF).toPandas(), duck.sql(catalogue.ORACLE_SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda df: sorted(tuple(str(v) for v in r) for r in df[cols].itertuples(index=False))
    assert rows(got) == rows(want)


def test_contours_of_a_plane(spark):
    from geoloom.operators import shapes

    grid = spark.createDataFrame([(r, c, float(c) * 2 + 0.5) for r in range(4) for c in range(4)], "row long, col long, z double")
    found = shapes.contour_lines(grid, 2.0).collect()
    assert len(found) == 9 and all(abs(x.x1 - (x.level - 0.5) / 2) < 1e-9 and abs(x.x2 - x.x1) < 1e-9 for x in found)


def _octree(points, bounds, most, depth, level=0, path=""):
    """Nodes by plain recursion on the midpoints."""
    mid = [(lo + hi) / 2 for lo, hi in bounds]
    octant = lambda p: "".join("1" if v >= m else "0" for v, m in zip(p, mid))
    parts = {}
    for p in points:
        parts.setdefault(int(octant(p), 2), []).append(p)
    leaf = len(points) <= most or level >= depth or len(parts) <= 1
    out = {path: (len(points), leaf)}
    if not leaf:
        for d in range(8):
            box = [(m, hi) if d >> (2 - i) & 1 else (lo, m) for i, ((lo, hi), m) in enumerate(zip(bounds, mid))]
            out |= _octree(parts.get(d, []), box, most, depth, level + 1, f"{path}{d}")
    return out


@pytest.mark.parametrize("most, depth", [(20, 6), (5, 21), (500, 4)])
def test_octree_by_recursion(spark, most, depth):
    from geoloom.operators import points

    rows = [((i * 7919 % 101) / 101, (i * 104729 % 103) / 103, (i * 31 % 97) / 97) for i in range(400)]
    rows += [(0.3, 0.3, 0.3)] * 40 + [(float("nan"), 0.5, 0.5), (0.5, float("inf"), 0.5)]
    cloud = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)], "idx long, x double, y double, z double")
    own = [p for p in rows if all(math.isfinite(v) for v in p)]
    want = _octree(own, [(min(p[k] for p in own), max(p[k] for p in own)) for k in range(3)], most, depth)
    assert {r.path: (r.n, r.leaf) for r in points.octree(cloud, most, depth).collect()} == want


def test_octree_of_few_places(spark):
    from geoloom.operators import points

    equal = spark.createDataFrame([(i, 1.0, 2.0, 3.0) for i in range(30)], "idx long, x double, y double, z double")
    assert [(r.path, r.n, r.leaf) for r in points.octree(equal, 5, 6).collect()] == [("", 30, True)]
    two = equal.unionAll(spark.createDataFrame([(99, 5.0, 2.0, 3.0)], equal.schema))
    found = points.octree(two, 5, 6).collect()
    assert len(found) == 9 and max(r.level for r in found) == 1 and sum(r.n for r in found if r.leaf) == 31
    assert [(r.path, r.n) for r in points.octree(equal.limit(0), 5, 6).collect()] == [("", 0)]


def test_knn_far_away(spark):
    from geoloom.operators import points

    p = spark.createDataFrame([(i, float(i % 7), float(i // 7)) for i in range(40)], "idx long, lng double, lat double")
    q = spark.createDataFrame([(1, 1e7, -1e7), (2, 3.2, 2.1), (3, -50.0, 2.0)], "qid long, qx double, qy double")
    rows = [(r.idx, r.lng, r.lat) for r in p.collect()]
    got = {}
    for r in sorted(points.knn(p, q, 3, 0.5).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.qid, []).append(r.idx)
    for qid, x, y in ((1, 1e7, -1e7), (2, 3.2, 2.1), (3, -50.0, 2.0)):
        assert got[qid] == [i for _, i in sorted(((px - x) ** 2 + (py - y) ** 2, i) for i, px, py in rows)[:3]]
    assert points.knn(p.limit(0), q, 3, 0.5).count() == 0 and points.knn(p, q.limit(0), 3, 0.5).count() == 0


def test_boxes_of_any_size(spark):
    from geoloom.operators import points

    p = spark.createDataFrame([(i, -180 + i * 3.6, -90 + (i * 37 % 100) * 1.8) for i in range(100)], "idx long, lng double, lat double")
    boxes = [(1, -180.0, -90.0, 180.0, 90.0), (2, 0.0, 0.0, 0.1, 0.1), (3, -50.0, -20.0, 60.0, 40.0), (4, 5.0, 5.0, 4.0, 4.0)]
    got = {(r.box, r.idx) for r in points.bbox_join(p, spark.createDataFrame(boxes, "box long, x0 double, y0 double, x1 double, y1 double"), 0.01).collect()}
    assert got == {(b, r.idx) for r in p.collect() for b, x0, y0, x1, y1 in boxes if x0 <= r.lng <= x1 and y0 <= r.lat <= y1}


def test_random_places_are_the_shuffle():
    from geoloom.operators.points import random_indices

    n, k, seed, order = 50, 20, 12345, list(range(50))
    for i in range(k):
        seed = (seed * 1103515245 + 12345) & 0x7FFFFFFF
        j = i + int(seed / 0x7FFFFFFF * (n - i))
        order[i], order[j] = order[j], order[i]
    assert list(random_indices(n, k)) == order[:k]


def test_dbscan_by_hand(spark):
    from geoloom.operators import points

    xs = [0.0, 0.01, 0.02, 0.03, 1.0, 2.0, 2.01, 2.02, 2.03, 179.995, -179.995, 179.99]
    df = spark.createDataFrame([(i, x, 0.0) for i, x in enumerate(xs)], "idx long, lng double, lat double")
    got = {r.idx: r.cluster for r in points.dbscan(df, 1200.0, 2).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: -1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 2, 10: 2, 11: 2}
    assert {r.cluster for r in points.dbscan(df, 0.0, 2).collect()} == {-1}


@pytest.mark.parametrize("metres, least", [(60_000.0, 4), (250_000.0, 9), (30_000_000.0, 3)])
def test_dbscan_by_all_pairs(spark, metres, least):
    """Over the date line and a pole, with copies, against all pairs; pairs are never rows."""
    import random

    from geoloom.operators import points

    r = random.Random(4)
    rows = [(r.gauss(179.5, 2), r.gauss(10, 2)) for _ in range(220)] + [(r.uniform(-180, 180), r.uniform(88, 90)) for _ in range(60)] + [(5.0, 5.0)] * 12 + [(5.5, 5.0)]
    rows = [((x + 180) % 360 - 180, y) for x, y in rows]

    def far(p, q):
        (x, y), (u, v) = (map(math.radians, rows[k]) for k in (p, q))
        h = math.sin((v - y) / 2) ** 2 + math.cos(y) * math.cos(v) * math.sin((u - x) / 2) ** 2
        return 2 * 6371000 * math.atan2(math.sqrt(h), math.sqrt(max(1 - h, 0)))

    near = {p: [q for q in range(len(rows)) if q != p and far(p, q) <= metres] for p in range(len(rows))}
    core, want, n = {p for p in near if len(near[p]) >= least}, dict.fromkeys(near, -1), 0
    for p in sorted(core):
        if want[p] < 0:
            todo, want[p] = [p], n
            while todo:
                for q in near[todo.pop()]:
                    if q in core and want[q] < 0:
                        want[q] = n
                        todo.append(q)
            n += 1
    for p in near:
        if p not in core:
            want[p] = min((want[q] for q in near[p] if q in core), default=-1)
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(rows)] + [(1000, float("nan"), 0.0)], "idx long, lng double, lat double")
    assert {r.idx: r.cluster for r in points.dbscan(df, metres, least).collect()} == want | {1000: -1}


def test_vincenty_known(spark):
    from pyspark.sql import functions as F

    from geoloom.functions import geodesy

    rows = [(0.0, 0.0, 0.0, 0.0), (144.42486788888888, -37.95103341666667, 143.92649552777777, -37.65282113888889), (0.0, 0.0, 179.7, 0.5)]
    got = [r.d for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select(geodesy.vincenty(*map(F.col, "abcd")).alias("d")).collect()]
    assert got[0] == 0.0 and abs(got[1] - 54972.271) < 0.01 and math.isnan(got[2])


def test_limits(spark):
    from geoloom.functions import limits

    assert limits.get_input_size_limit() == 100 * 1024 * 1024
    limits.set_input_size_limit(10)
    with pytest.raises(limits.InputTooLarge):
        limits.check_input_size(11, "x")
    limits.set_input_size_limit(0)
    limits.check_input_size(1 << 40, "x")
    limits.set_input_size_limit(limits.DEFAULT_INPUT_LIMIT)
    limits.set_max_memory(5)
    assert limits.get_max_memory() == 5 and not limits.check_memory_available(6)
    limits.set_max_memory(0)
    assert limits.check_memory_available(1 << 50)
    info = limits.memory_info(spark)
    assert info.total == info.used + info.remaining > 0
    assert limits.thread_count(spark) >= 1 and limits.supports("las") and not limits.supports("draco") and "e57" in limits.status("e57") and limits.version()


def test_empty_inputs(spark):
    from geoloom.operators import points

    none = spark.createDataFrame([], "idx long, lng double, lat double")
    assert points.bounds(none, "lng").first().min_lng == 0.0
    assert points.cluster_by_grid(none, 1000.0, 1).count() == 0


def _contours(z, interval):
    """Marching squares of a dict by (row, col), cell by cell."""
    found, level = [], (math.floor(min(z.values()) / interval) + 1) * interval
    while level <= max(z.values()):
        for (r, c), a in z.items():
            if not {(r, c + 1), (r + 1, c), (r + 1, c + 1)} <= z.keys():
                continue
            b, d, e = z[r, c + 1], z[r + 1, c], z[r + 1, c + 1]
            cut = lambda u, v, p: p + (0.5 if abs(v - u) < 1e-10 else (level - u) / (v - u))
            bottom, top, left, right = (lambda: (cut(a, b, c), r)), (lambda: (cut(d, e, c), r + 1)), (lambda: (c, cut(a, d, r))), (lambda: (c + 1, cut(b, e, r)))
            sides = {1: "bl", 14: "bl", 2: "br", 13: "br", 3: "lr", 12: "lr", 4: "rt", 11: "rt", 5: "blrt", 6: "bt", 9: "bt", 7: "lt", 8: "lt", 10: "brlt"}
            s = sides.get((a >= level) + 2 * (b >= level) + 4 * (e >= level) + 8 * (d >= level), "")
            at = {"b": bottom, "t": top, "l": left, "r": right}
            found += [(level, *at[s[k]](), *at[s[k + 1]]()) for k in range(0, len(s), 2)]
        level += interval
    return sorted(tuple(round(float(v), 6) + 0.0 for v in x) for x in found)


def test_contours_with_saddles(spark):
    from geoloom.operators import shapes

    z = {(r, c): float((r * 7 + c * 11) % 13 - 6) + 0.25 * ((r + c) % 3) for r in range(7) for c in range(6)}
    z |= {(0, 0): 5.0, (0, 1): -5.0, (1, 0): -5.0, (1, 1): 5.0, (0, 2): 5.0, (1, 2): -5.0}
    grid = spark.createDataFrame([(*k, v) for k, v in z.items()], "row long, col long, z double")
    got = sorted(tuple(round(float(v), 6) + 0.0 for v in x) for x in shapes.contour_lines(grid, 2.0).collect())
    assert got == _contours(z, 2.0)


def test_contours_of_the_whole_grid(spark):
    from geoloom.plans import fixtures

    z = {(r.row, r.col): r.z for r in fixtures.spark(spark, SF, "grid").collect()}
    assert max(r for r, _ in z) >= 64
    got = sorted(tuple(float(v) + 0.0 for v in x) for x in catalogue.QUERIES["contour_lines"](spark, SF).collect())
    want = _contours(z, 10.0)
    assert len(got) == len(want) and max(x[2] for x in got) > 64
    assert all(abs(a - b) < 2e-6 for x, y in zip(got, want) for a, b in zip(x, y))


@pytest.mark.parametrize("name, key", [("bbox_join", "box"), ("knn", "qid")])
def test_every_hundredth_point_is_searched(spark, name, key):
    from geoloom.plans import fixtures

    ids = {r.idx for r in fixtures.spark(spark, SF, "china").where("idx % 100 = 0").collect()}
    assert {r[key] for r in catalogue.QUERIES[name](spark, SF).select(key).distinct().collect()} == ids
