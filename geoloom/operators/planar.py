"""Planar geometry of groups: hulls, simplification, triangulation, overlay and predicates.

The shapes of a key are found in one task a key, from what the key needs: a hull is first
taken of the points of each batch, so a task gets hull points and not all points. Inner
functions work on plain arrays of positions and know nothing of Spark.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POINTS = "seq long, x double, y double"


def _schema(df: DataFrame, key: str, rest: str) -> str:
    return f"{key} {next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)}, {rest}"


# ---------------------------------------------------------------- hulls

def hull(p: np.ndarray) -> np.ndarray:
    """Corners of the convex hull of an (n, 2) array, from the least one on, counter-clockwise;
    points between corners are left out."""
    p = np.unique(p[np.isfinite(p).all(axis=1)], axis=0)
    if len(p) < 3:
        return p

    def chain(points):
        out = []
        for q in points:
            while len(out) >= 2 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    rows = p.tolist()
    return np.array(chain(rows)[:-1] + chain(rows[::-1])[:-1])


def closed(ring: np.ndarray) -> np.ndarray:
    return np.concatenate([ring, ring[:1]]) if len(ring) else ring


def _frame(key: str, value, p: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({key: [value] * len(p), "seq": np.arange(len(p)), "x": p[:, 0] if len(p) else [], "y": p[:, 1] if len(p) else []})


def convex_hull(df: DataFrame, key: str) -> DataFrame:
    """(key, seq, x, y): the closed hull of each key's points (x, y). Hulls of the points of
    one batch go on to the task of the key, so a hot key sends few."""
    def local(frames):
        for pdf in frames:
            for k, own in pdf.groupby(key):
                h = hull(own[["x", "y"]].to_numpy(float))
                yield pd.DataFrame({key: [k] * len(h), "x": h[:, 0], "y": h[:, 1]})

    part = df.select(key, "x", "y").mapInPandas(local, _schema(df, key, "x double, y double"))
    return part.groupBy(key).applyInPandas(lambda pdf: _frame(key, pdf[key].iloc[0], closed(hull(pdf[["x", "y"]].to_numpy(float)))), _schema(df, key, POINTS))


def concave(p: np.ndarray, alpha: float, rounds: int = 50) -> np.ndarray:
    """The convex hull whose edges are bent in, round by round, to the nearest point that is
    no corner yet and nearer than ``alpha`` times the edge."""
    p = np.unique(p[np.isfinite(p).all(axis=1)], axis=0)
    ring = hull(p)
    if len(p) < 3 or alpha >= 1000 or len(ring) <= 3:
        return ring
    at = {tuple(q): i for i, q in enumerate(p.tolist())}
    rim = [at[tuple(q)] for q in ring.tolist()]
    for _ in range(rounds):
        free, bent = np.ones(len(p), bool), []
        free[rim] = False
        inner = np.flatnonzero(free)
        for i, j in zip(rim, rim[1:] + rim[:1]):
            bent.append(i)
            a, e = p[i], p[j] - p[i]
            long = max(math.hypot(*e), 1e-10)
            if len(inner):
                t = np.clip(((p[inner] - a) @ e) / max(float(e @ e), 1e-20), 0, 1)
                d = np.hypot(*(p[inner] - a - t[:, None] * e).T)
                k = int(np.argmin(d))
                if d[k] < alpha * long:
                    bent.append(int(inner[k]))
        if len(bent) == len(rim):
            break
        rim = bent
    return p[rim]


def concave_hull(df: DataFrame, key: str, alpha: float) -> DataFrame:
    """(key, seq, x, y): the closed concave hull of each key's points, in one task a key."""
    return df.select(key, "x", "y").groupBy(key).applyInPandas(lambda pdf: _frame(key, pdf[key].iloc[0], closed(concave(pdf[["x", "y"]].to_numpy(float), alpha))), _schema(df, key, POINTS))


def buffer_line(df: DataFrame, key: str, metres: float, segments: int = 16) -> DataFrame:
    """(key, seq, x, y): the hull of the circles about each key's points (lng, lat)."""
    from .shapes import circle

    at = df.select(key, F.explode(circle(F.col("lng"), F.col("lat"), metres, segments)).alias("p")).select(key, F.col("p.x").alias("x"), F.col("p.y").alias("y"))
    return convex_hull(at, key)


# ---------------------------------------------------------------- simplification

def simplified(p: np.ndarray, tolerance: float) -> np.ndarray:
    """Places of the positions that a Douglas-Peucker pass keeps: both ends, and where a run
    strays from its chord by more than ``tolerance``, the farthest. Squared distances count to
    12 digits, halves up, so that of positions equally far the first is taken, whatever was
    rounded. Sums go term by term: a dot product may fuse its steps and round otherwise."""
    keep = np.zeros(len(p), bool)
    if len(p):
        keep[[0, -1]] = True
    todo, xs, ys = [(0, len(p) - 1)], p[:, 0], p[:, 1]
    while todo:
        a, b = todo.pop()
        if b - a < 2:
            continue
        ax, ay, x, y = xs[a], ys[a], xs[a + 1:b], ys[a + 1:b]
        dx, dy = xs[b] - ax, ys[b] - ay
        n = dx * dx + dy * dy
        t = np.clip(((x - ax) * dx + (y - ay) * dy) / n, 0, 1) if n > 0 else np.zeros(b - a - 1)
        ox, oy = x - (ax + t * dx), y - (ay + t * dy)
        d = (ox * ox + oy * oy) * 1e12
        low = np.floor(d)
        d = (low + (d - low >= 0.5)) / 1e12
        k = int(np.argmax(d))
        if d[k] > tolerance ** 2:
            k += a + 1
            keep[k] = True
            todo += [(a, k), (k, b)]
    return np.flatnonzero(keep)


def simplify(df: DataFrame, key: str, order: str, tolerance: float) -> DataFrame:
    """The rows of each key's line (x, y by ``order``) that simplification keeps."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        return pdf.iloc[simplified(pdf[["x", "y"]].to_numpy(float), tolerance)]

    return df.groupBy(key).applyInPandas(run, df.schema)


# ---------------------------------------------------------------- triangulation

def delaunay(p: np.ndarray) -> np.ndarray:
    """Triangles (places of corners, ascending) of distinct points, by inserting one after the
    other into a triangle around all and refilling the hole of the triangles whose circle holds it."""
    n = len(p)
    if n < 3:
        raise ValueError("a triangulation needs three points")
    mid, size = (p.min(axis=0) + p.max(axis=0)) / 2, max(float(np.ptp(p, axis=0).max()), 1e-9)
    q = np.concatenate([p - mid, size * 1e4 * np.array([[-1.0, -1.0], [1.0, -1.0], [0.0, 1.0]])])

    def circle(t):
        (ax, ay), (bx, by), (cx, cy) = q[list(t)]
        d = 2 * (ax * (by - cy) + bx * (cy - ay) + cx * (ay - by))
        if d == 0:
            return None
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        ux, uy = (a2 * (by - cy) + b2 * (cy - ay) + c2 * (ay - by)) / d, (a2 * (cx - bx) + b2 * (ax - cx) + c2 * (bx - ax)) / d
        return ux, uy, (ax - ux) ** 2 + (ay - uy) ** 2

    alive = {(n, n + 1, n + 2): circle((n, n + 1, n + 2))}
    for i in range(n):
        x, y = q[i]
        bad = [t for t, c in alive.items() if c is None or (x - c[0]) ** 2 + (y - c[1]) ** 2 < c[2]]
        edges: dict = {}
        for t in bad:
            del alive[t]
            for e in ((t[0], t[1]), (t[1], t[2]), (t[0], t[2])):
                edges[e] = edges.get(e, 0) + 1
        for e, k in edges.items():
            if k == 1:
                t = tuple(sorted((*e, i)))
                if (c := circle(t)) is not None:
                    alive[t] = c
    return np.array(sorted(t for t in alive if max(t) < n), np.int64).reshape(-1, 3)


def tin(df: DataFrame, key: str, order: str) -> DataFrame:
    """(key, a, b, c): the triangles of each key's points, as places in ``order``; equal
    positions count once, at the first. Keys with fewer than three have none."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").drop_duplicates(["x", "y"])
        own = pdf[order].to_numpy()
        t = own[delaunay(pdf[["x", "y"]].to_numpy(float))] if len(pdf) >= 3 else np.zeros((0, 3), np.int64)
        return pd.DataFrame({key: [pdf[key].iloc[0]] * len(t), "a": t[:, 0], "b": t[:, 1], "c": t[:, 2]})

    return df.select(key, order, "x", "y").groupBy(key).applyInPandas(run, _schema(df, key, "a long, b long, c long"))


def tin_interpolate(triangles: DataFrame, points: DataFrame, queries: DataFrame, key: str, order: str) -> DataFrame:
    """(key, qid, z) of each query (key, qid, qx, qy): by its place in the first triangle that
    holds it, to 1e-10, else the height of the nearest point. All of it is joins on the key."""
    corner = lambda n: points.select(key, F.col(order).alias(n), *(F.col(c).alias(f"{c}{n}") for c in "xyz"))
    t = triangles
    for n in "abc":
        t = t.join(corner(n), [key, n])
    d = (F.col("yb") - F.col("yc")) * (F.col("xa") - F.col("xc")) + (F.col("xc") - F.col("xb")) * (F.col("ya") - F.col("yc"))
    u = ((F.col("yb") - F.col("yc")) * (F.col("qx") - F.col("xc")) + (F.col("xc") - F.col("xb")) * (F.col("qy") - F.col("yc"))) / F.nullif(d, F.lit(0.0))
    v = ((F.col("yc") - F.col("ya")) * (F.col("qx") - F.col("xc")) + (F.col("xa") - F.col("xc")) * (F.col("qy") - F.col("yc"))) / F.nullif(d, F.lit(0.0))
    inside = t.join(queries, key).withColumns({"u": u, "v": v}).where((F.col("u") >= -1e-10) & (F.col("v") >= -1e-10) & (F.col("u") + F.col("v") <= 1 + 1e-10))
    z = F.col("u") * F.col("za") + F.col("v") * F.col("zb") + (1 - F.col("u") - F.col("v")) * F.col("zc")
    hit = inside.groupBy(key, "qid").agg(F.min_by(z, F.struct("a", "b", "c")).alias("z"))
    near = queries.join(points, key).groupBy(key, "qid").agg(F.min_by("z", F.struct((F.col("x") - F.col("qx")) ** 2 + (F.col("y") - F.col("qy")) ** 2, F.col(order))).alias("near"))
    return near.join(hit, [key, "qid"], "left").select(key, "qid", F.coalesce("z", "near").alias("z"))


# ---------------------------------------------------------------- predicates and overlay of rings

def _plain(ring) -> list:
    """Positions as pairs of plain floats: on a few of them arrays take ten times as long."""
    return ring if isinstance(ring, list) else np.asarray(ring, float).reshape(-1, 2).tolist()


def locate(ring, p) -> int:
    """1 inside, 0 on the rim, -1 outside."""
    inside, ring, (x, y) = False, _plain(ring), p
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        if (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0 and min(ax, bx) <= x <= max(ax, bx) and min(ay, by) <= y <= max(ay, by):
            return 0
        if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
            inside = not inside
    return 1 if inside else -1


def _open(ring) -> np.ndarray:
    r = np.asarray(ring, float).reshape(-1, 2)
    if len(r) > 1 and (r[0] == r[-1]).all():
        r = r[:-1]
    return r[np.append(True, (r[1:] != r[:-1]).any(axis=1))] if len(r) else r


def _cuts(a, b) -> list[list[float]]:
    """For each edge of a, the places (0..1) at which edges of b meet it."""
    out, a, b = [], _plain(a), _plain(b)
    other = list(zip(b, b[1:] + b[:1]))
    for (px, py), (qx, qy) in zip(a, a[1:] + a[:1]):
        dx, dy, ts = qx - px, qy - py, {0.0, 1.0}
        for (rx, ry), (sx, sy) in other:
            ex, ey = sx - rx, sy - ry
            den = dx * ey - dy * ex
            if den:
                t, u = ((rx - px) * ey - (ry - py) * ex) / den, ((rx - px) * dy - (ry - py) * dx) / den
                if -1e-12 <= t <= 1 + 1e-12 and -1e-12 <= u <= 1 + 1e-12:
                    ts.add(round(min(max(t, 0.0), 1.0), 12))
            elif dx * (ry - py) - dy * (rx - px) == 0:
                n = dx * dx + dy * dy
                ts.update(round(t, 12) for t in (((rx - px) * dx + (ry - py) * dy) / n, ((sx - px) * dx + (sy - py) * dy) / n) if 0 <= t <= 1)
        out.append(sorted(ts))
    return out


def _pieces(a, b):
    """The edges of a, cut where b meets them, with the side of b that their middle lies on."""
    a, b = _plain(a), _plain(b)
    for ((px, py), (qx, qy)), ts in zip(zip(a, a[1:] + a[:1]), _cuts(a, b)):
        dx, dy = qx - px, qy - py
        for t, u in zip(ts[:-1], ts[1:]):
            m = (t + u) / 2
            yield (px + t * dx, py + t * dy), (px + u * dx, py + u * dy), locate_near(b, (px + m * dx, py + m * dy))


def locate_near(ring, p, tol: float = 1e-11) -> int:
    """``locate``, with a rim of relative width ``tol``."""
    ring, (x, y) = _plain(ring), p
    rim = tol * max(max(abs(u), abs(v)) for u, v in ring) or tol * 1e-300
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        ex, ey = bx - ax, by - ay
        n = ex * ex + ey * ey
        t = min(max(((x - ax) * ex + (y - ay) * ey) / n, 0.0), 1.0) if n else 0.0
        if math.hypot(x - ax - t * ex, y - ay - t * ey) <= rim:
            return 0
    return locate(ring, p)


def relation(a, b) -> tuple[bool, bool]:
    """Whether two simple rings meet at all, and whether their insides do."""
    a, b = _open(a), _open(b)
    if len(a) < 3 or len(b) < 3:
        return False, False
    if (a.max(axis=0) < b.min(axis=0)).any() or (b.max(axis=0) < a.min(axis=0)).any():
        return False, False
    sides = [s for _, _, s in _pieces(a, b)] + [s for _, _, s in _pieces(b, a)]
    if any(s > 0 for s in sides):
        return True, True
    if all(s == 0 for s in sides):
        return True, True  # one and the same ring
    meet = any(locate_near(b, p) >= 0 for p in a) or any(locate_near(a, p) >= 0 for p in b) or any(s == 0 for s in sides) or any(len(t) > 2 for t in _cuts(a, b))
    return meet, False


def overlay(a, b, union: bool) -> list[np.ndarray]:
    """The closed outer and inner rings of the intersection or union of two simple rings: the
    pieces of either's edges inside (outside) the other, joined end to start. Shared edges
    count once where both run the same way."""
    a, b = _open(a), _open(b)
    if len(a) < 3 or len(b) < 3:
        return [closed(r) for r in (a, b) if union and len(r) >= 3]
    area = lambda r: float((r[:, 0] * np.roll(r[:, 1], -1) - r[:, 1] * np.roll(r[:, 0], -1)).sum()) / 2
    a, b = (r if area(r) > 0 else r[::-1] for r in (a, b))
    want, scale = (-1 if union else 1), max(float(np.abs(np.concatenate([a, b])).max()), 1e-300)
    name = lambda p: (round(float(p[0]) / scale, 10), round(float(p[1]) / scale, 10))
    edges, shared = [], {}
    for p, q, s in _pieces(a, b):
        if s == want:
            edges.append((p, q))
        elif s == 0:
            shared[name(p), name(q)] = (p, q)
    for p, q, s in _pieces(b, a):
        if s == want:
            edges.append((p, q))
        elif s == 0 and (name(p), name(q)) in shared:
            edges.append((p, q))
    start: dict = {}
    for p, q in edges:
        if name(p) != name(q):
            start.setdefault(name(p), []).append((p, q))
    rings = []
    while start:
        key = min(start)
        ring, here = [], key
        while here in start:
            options = start[here]
            if len(ring) and len(options) > 1:  # at a touching corner the sharpest left turn closes the smaller ring
                back = ring[-1][0] - options[0][0][0], ring[-1][1] - options[0][0][1]
                turn = lambda e: (math.atan2(e[1][1] - e[0][1], e[1][0] - e[0][0]) - math.atan2(back[1], back[0])) % (2 * math.pi)  # noqa: E731, B023
                options.sort(key=turn, reverse=not union)
            p, q = options.pop(0)
            if not options:
                del start[here]
            ring.append(p)
            here = name(q)
            if here == key:
                break
        if len(ring) >= 3 and here == key:
            rings.append(closed(_straight(np.array(ring))))
    if not rings and union:
        rings = [closed(r) for r in ([a, b] if not relation(a, b)[0] else [max((a, b), key=lambda r: abs(area(r)))])]
    return rings


def _straight(r: np.ndarray) -> np.ndarray:
    """A ring without the corners at which it goes straight on."""
    before, after = np.roll(r, 1, axis=0), np.roll(r, -1, axis=0)
    turn = (r[:, 0] - before[:, 0]) * (after[:, 1] - r[:, 1]) - (r[:, 1] - before[:, 1]) * (after[:, 0] - r[:, 0])
    size = np.hypot(*(r - before).T) * np.hypot(*(after - r).T)
    keep = np.abs(turn) > 1e-11 * np.maximum(size, 1e-300)
    return r[keep] if keep.sum() >= 3 else r


def _once(work, kind):
    """``work`` of the pairs of rings in two Arrow arrays, each different pair once a batch, as
    an array of ``kind``."""
    def rings(array):
        flat, at = array.flatten(), np.concatenate([[0], np.cumsum(array.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(int)
        p = np.stack([pc.struct_field(flat, n).to_numpy(zero_copy_only=False).astype(float) for n in ("x", "y")], -1) if len(flat) else np.zeros((0, 2))
        return [p[i:j] for i, j in zip(at[:-1], at[1:])]

    def run(s, t):
        seen, out, place = {}, [], []
        for u, v in zip(rings(s), rings(t)):
            key = u.tobytes(), v.tobytes()
            if key not in seen:
                seen[key] = len(out)
                out.append(work(u, v))
            place.append(seen[key])
        return pa.array(out, kind).take(pa.array(place, pa.int64()))

    return run


def relate(a: Column, b: Column) -> Column:
    """struct<intersects, touches, disjoint> of two rings (arrays of x, y)."""
    def one(u, v):
        meet, inside = relation(u, v)
        return {"intersects": meet, "touches": meet and not inside, "disjoint": not meet}

    run = _once(one, pa.struct([(n, pa.bool_()) for n in ("intersects", "touches", "disjoint")]))

    @F.arrow_udf("intersects boolean, touches boolean, disjoint boolean")
    def related(s: pa.Array, t: pa.Array) -> pa.Array:
        return run(s, t)

    return related(a, b)


def overlaid(a: Column, b: Column, union: bool) -> Column:
    """The rings of the intersection or union, as an array of rings; none for no overlap."""
    run = _once(lambda u, v: [[{"x": x, "y": y} for x, y in r.tolist()] for r in overlay(u, v, union)], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))

    @F.arrow_udf("array<array<struct<x:double,y:double>>>")
    def laid(s: pa.Array, t: pa.Array) -> pa.Array:
        return run(s, t)

    return laid(a, b)


def holds(ring: Column, x: Column, y: Column) -> Column:
    """Whether a ring holds a point, the rim not counted; in generated code."""
    from .shapes import in_ring

    n = F.size(ring)
    edge = F.exists(F.sequence(F.lit(0), n - 1), lambda i: _on(F.element_at(ring, i + 1), F.element_at(ring, F.when(i + 1 == n, 1).otherwise(i + 2)), x, y))
    return in_ring(x, y, ring) & ~edge


def _on(a: Column, b: Column, x: Column, y: Column) -> Column:
    cross = (b["x"] - a["x"]) * (y - a["y"]) - (b["y"] - a["y"]) * (x - a["x"])
    return (cross == 0) & x.between(F.least(a["x"], b["x"]), F.greatest(a["x"], b["x"])) & y.between(F.least(a["y"], b["y"]), F.greatest(a["y"], b["y"]))


# ---------------------------------------------------------------- segments

def _extent_level(dx: Column, dy: Column, cell: float) -> Column:
    """The level (cell size doubled so many times) whose cells are as long as an envelope of
    these sides, with a hair's breadth for rounding."""
    side = F.greatest(F.abs(dx), F.abs(dy), F.lit(float(cell))) * (1 + 1e-9)
    return F.greatest(F.ceil(F.log2(side / float(cell)) - 1e-8), F.lit(0)).cast("int")


def segments_in_boxes(segments: DataFrame, boxes: DataFrame, cell: float, within: bool = True) -> DataFrame:
    """(box, id) of the segments (id, x1, y1, x2, y2) whose envelope lies within a closed box,
    or meets it, by cells. A segment goes to the one cell that holds its lower corner, so a pair
    comes up once; a box goes to the cells that it meets, and for ``within=False`` to those from
    which a segment can reach it. Cells are on the level of the box or of the segment, whichever
    is larger, so either may have any size."""
    from .durable import durable
    from .points import _covered

    kinds = [0]  # levels of segments: one for each doubling of their size
    e = segments.select("id", F.least("x1", "x2").alias("ex0"), F.greatest("x1", "x2").alias("ex1"), F.least("y1", "y2").alias("ey0"), F.greatest("y1", "y2").alias("ey1"), (F.lit(0) if within else _extent_level(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), cell)).alias("kind"))
    if not within:
        kinds = [r["kind"] for r in e.select("kind").distinct().collect() if r["kind"] is not None]
    spread = durable(_covered(boxes, cell, kinds=None if within else kinds).drop("w"))
    levels = [r["level"] for r in spread.select("level").distinct().collect()]  # one for each doubling of the box size
    e = e.withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels or [0]])))
    w = F.lit(float(cell)) * F.pow(F.lit(2.0), F.greatest("level", "kind"))
    e = e.withColumns({"cx": F.floor(F.col("ex0") / w), "cy": F.floor(F.col("ey0") / w)})
    hit = e.join(spread, ["level", *([] if within else ["kind"]), "cx", "cy"])
    if within:
        hit = hit.where((F.col("ex0") >= F.col("x0")) & (F.col("ex1") <= F.col("x1")) & (F.col("ey0") >= F.col("y0")) & (F.col("ey1") <= F.col("y1")))
    else:
        hit = hit.where((F.col("ex1") >= F.col("x0")) & (F.col("ex0") <= F.col("x1")) & (F.col("ey1") >= F.col("y0")) & (F.col("ey0") <= F.col("y1")))
    return hit.select("box", "id")


def nearest_segment(segments: DataFrame, queries: DataFrame, cell: float) -> DataFrame:
    """(qid, id, d2): the nearest segment (ties by id) of each query (qid, qx, qy). A segment is
    in the one cell that holds its lower corner; a query looks, for each level of segment sizes
    (``kind``), at the cells from which such a segment comes within its reach. The reach doubles
    from round to round; a query is done when its hit is no farther, at the latest where the
    reach covers everything. Least distances are found first, as plain sums of a hash table
    that sorts no pairs, then the least id at that distance."""
    from ..functions.geodesy import segment_distance_sq
    from .durable import durable
    from .points import _covered

    b = segments.agg(F.min(F.least("x1", "x2")).alias("x0"), F.max(F.greatest("x1", "x2")).alias("x1"), F.min(F.least("y1", "y2")).alias("y0"), F.max(F.greatest("y1", "y2")).alias("y1")).first()
    q = queries.agg(F.min("qx").alias("x0"), F.max("qx").alias("x1"), F.min("qy").alias("y0"), F.max("qy").alias("y1")).first()
    todo, found, level = queries.select("qid", "qx", "qy"), None, 0
    if b["x0"] is None or q["x0"] is None:
        return todo.limit(0).select("qid", F.lit(0).cast("long").alias("id"), F.lit(0.0).alias("d2"))
    last = max(0, math.ceil(math.log2(max(max(b["x1"], q["x1"]) - min(b["x0"], q["x0"]), max(b["y1"], q["y1"]) - min(b["y0"], q["y0"]), cell) / cell)) + 1)
    own = segments.select("id", "x1", "y1", "x2", "y2", _extent_level(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), cell).alias("kind"))
    kinds = [r["kind"] for r in own.select("kind").distinct().collect() if r["kind"] is not None]  # one for each doubling of segment sizes
    d2 = segment_distance_sq(F.col("qx"), F.col("qy"), *map(F.col, ("x1", "y1", "x2", "y2")))
    while True:
        reach = cell * 2.0 ** level
        long = F.lit(float(cell)) * F.pow(F.lit(2.0), F.col("kind"))
        w = F.greatest(long, F.lit(reach))
        cells = todo.withColumn("kind", F.explode(F.array(*[F.lit(i) for i in kinds])))
        for c, at in (("cx", "qx"), ("cy", "qy")):
            cells = cells.withColumn(c, F.explode(F.sequence(F.floor((F.col(at) - reach - long) / w), F.floor((F.col(at) + reach) / w))))
        e = own.withColumns({"cx": F.floor(F.least("x1", "x2") / w), "cy": F.floor(F.least("y1", "y2") / w)})
        hit = cells.join(e, ["kind", "cx", "cy"]).groupBy("qid", "qx", "qy").agg(F.min(d2).alias("least"))
        done = durable(hit.where((F.sqrt("least") <= reach) | F.lit(level >= last)))
        found = done if found is None else found.unionAll(done)
        todo = durable(todo.join(done.select("qid"), "qid", "left_anti"))
        if level >= last or todo.isEmpty():
            break
        level += 1
    pad = 1e-10 * max(abs(v) for r in (b, q) for v in r)  # distances are rounded
    r = F.sqrt("least") * (1 + 1e-9) + pad
    around = found.select("qid", "qx", "qy", "least", *((F.col(c) + k * r).alias(n) for c, k, n in (("qx", -1, "x0"), ("qx", 1, "x1"), ("qy", -1, "y0"), ("qy", 1, "y1"))))
    spread = durable(_covered(around, cell, kinds=kinds).drop("w", "x0", "x1", "y0", "y1"))
    levels = [x["level"] for x in spread.select("level").distinct().collect()]  # one for each doubling of the distance
    e = own.withColumn("level", F.explode(F.array(*[F.lit(i) for i in levels or [0]])))
    w = F.lit(float(cell)) * F.pow(F.lit(2.0), F.greatest("level", "kind"))
    e = e.withColumns({"cx": F.floor(F.least("x1", "x2") / w), "cy": F.floor(F.least("y1", "y2") / w)})
    ids = spread.join(e, ["level", "kind", "cx", "cy"]).where(d2 <= F.col("least")).groupBy("qid", "least").agg(F.min("id").alias("id"))
    return ids.select("qid", "id", F.col("least").alias("d2"))


# ---------------------------------------------------------------- normals

def _eigen(m: np.ndarray) -> np.ndarray:
    """Of each covariance the direction of least spread, its largest part positive."""
    v = np.linalg.eigh(m)[1][:, :, 0] if len(m) else np.zeros((0, 3))
    top = np.abs(v).argmax(axis=1)
    return v * np.where(v[np.arange(len(v)), top] < 0, -1.0, 1.0)[:, None]


def _block_normals(idx: np.ndarray, p: np.ndarray, block: tuple, side: int, cell: float, k: int) -> pd.DataFrame:
    """Normals of the points in a block of ``side`` cells a way, from these and the ones a cell
    around it. A point whose k nearest others may lie beyond the cells next to its own isn't
    ``done`` and has its place instead."""
    order = np.argsort(idx, kind="stable")  # so that a stable sort by distance leaves ties by idx
    idx, p = idx[order], p[order]
    at = np.floor(p / cell).astype(np.int64) - np.array(block) * side + 1
    wide, d3 = side + 2, [(x, y, z) for x in (-1, 0, 1) for y in (-1, 0, 1) for z in (-1, 0, 1)]
    code = (at[:, 0] * wide + at[:, 1]) * wide + at[:, 2]
    by = np.argsort(code, kind="stable")
    names, starts = np.unique(code[by], return_index=True)
    members = dict(zip(names.tolist(), np.split(by, starts[1:])))
    own = ((at >= 1) & (at <= side)).all(axis=1)
    rim = np.minimum(p - np.floor(p / cell) * cell, (np.floor(p / cell) + 1) * cell - p).min(axis=1) + cell
    m = np.full((len(p), 3, 3), np.nan)
    for c in names[own[by[starts]]].tolist():
        here = members[c]
        around = np.sort(np.concatenate([members[o] for x, y, z in d3 if (o := c + (x * wide + y) * wide + z) in members]))
        if len(around) <= k:
            continue
        q, step = p[around], max(1, 1_000_000 // len(around))
        for i in (here[j:j + step] for j in range(0, len(here), step)):
            d = sum((p[i, a][:, None] - q[None, :, a]) ** 2 for a in range(3))
            d[np.arange(len(i)), np.searchsorted(around, i)] = np.inf
            near = np.argpartition(d, k - 1, axis=1)[:, :k]
            worst = np.take_along_axis(d, near, 1).max(axis=1)
            tied = np.flatnonzero((d <= worst[:, None]).sum(axis=1) > k)
            if len(tied):
                near[tied] = np.argsort(d[tied], axis=1, kind="stable")[:, :k]
            n = q[near]
            n = n - n.mean(axis=1, keepdims=True)
            m[i] = np.where((np.sqrt(worst) < rim[i])[:, None, None], np.matmul(n.transpose(0, 2, 1), n) / k, np.nan)
    done = np.isfinite(m[:, 0, 0])
    v = p.copy()
    v[done] = _eigen(m[done])
    return pd.DataFrame({"idx": idx[own], "done": done[own], **{f"n{a}": v[own, i] for i, a in enumerate("xyz")}})


def normals(points: DataFrame, k: int = 8, cell: float | None = None) -> DataFrame:
    """(idx, nx, ny, nz) of a cloud (idx, x, y, z): the direction in which each point's k
    nearest others (ties by idx) spread least, as the eigenvector of their covariance; its sign
    is that of its largest part being positive. Points go to blocks of many cells, with those a
    cell around; the few whose neighbours are farther than that are searched for by ``knn``.
    Rows that aren't finite are left out."""
    from pyspark.sql import Window

    from .durable import stored
    from .points import finite, knn

    points = points.select("idx", *"xyz").where(finite(F.col("x")) & finite(F.col("y")) & finite(F.col("z")))
    b = points.agg(F.count(F.lit(1)).alias("n"), *((F.max(a) - F.min(a)).alias(a) for a in "xyz")).first()
    n, side = b["n"], 32
    k = max(3, min(k, n - 1))
    if cell is None and n:
        sides = [max(b[a], 1e-9) for a in "xyz"]
        cell = max((math.prod(sides) * (k + 1) / n) ** (1 / 3), max(sides) * 1e-6)
    cell = float(cell or 1.0)
    at, w = points, cell * side
    for a in "xyz":  # a hair wider than a cell: what else comes is sorted out by its cell
        at = at.withColumn(f"b{a}", F.explode(F.sequence(F.floor((F.col(a) - cell * 1.001) / w), F.floor((F.col(a) + cell * 1.001) / w))))

    def run(key, pdf):
        p = pdf[["x", "y", "z"]].to_numpy()
        c = np.floor(p / cell) - np.array(key) * side
        inside = ((c >= -1) & (c <= side)).all(axis=1)
        return _block_normals(pdf["idx"].to_numpy()[inside], p[inside], key, side, cell, k)

    found = stored(at.groupBy("bx", "by", "bz").applyInPandas(run, "idx long, done boolean, nx double, ny double, nz double"))
    q = found.where("not done").select(F.col("idx").alias("qid"), *(F.col(f"n{a}").alias(f"q{a}") for a in "xyz"))
    few = F.broadcast if q.count() <= 20_000 else lambda df: df
    near = knn(points, q, k + 1, cell, ("x", "y", "z"), ("qx", "qy", "qz")).where("qid <> idx")
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("qid").orderBy("d2", "idx"))).where(F.col("place") <= k)
    pairs = ("xx", "xy", "xz", "yy", "yz", "zz")
    sums = few(near).join(points, "idx").groupBy("qid").agg(*(F.covar_pop(a, b).alias(f"{a}{b}") for a, b in pairs))

    @F.pandas_udf("nx double, ny double, nz double")
    def eigen(xx: pd.Series, xy: pd.Series, xz: pd.Series, yy: pd.Series, yz: pd.Series, zz: pd.Series) -> pd.DataFrame:
        m = np.stack([np.stack([xx, xy, xz], -1), np.stack([xy, yy, yz], -1), np.stack([xz, yz, zz], -1)], -2)
        return pd.DataFrame(_eigen(m), columns=["nx", "ny", "nz"])

    rest = sums.select(F.col("qid").alias("idx"), eigen(*map(F.col, pairs)).alias("n")).select("idx", "n.*")
    return found.where("done").select("idx", "nx", "ny", "nz").unionAll(rest)
