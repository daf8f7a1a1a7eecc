"""Distances, bearings, cells and quantisation as Column expressions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

R = 6371000.0
#: Fixed value: the geohash alphabet.
BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def haversine(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.sin((p2 - p1) / 2) ** 2 + F.cos(p1) * F.cos(p2) * F.sin(F.radians(lng2 - lng1) / 2) ** 2
    return F.atan2(F.sqrt(a), F.sqrt(1 - a)) * (2 * R)


def bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(p2), F.cos(p1) * F.sin(p2) - F.sin(p1) * F.cos(p2) * F.cos(d))) + 360.0, F.lit(360.0))


def destination(lng: Column, lat: Column, degrees: Column, metres: Column) -> tuple[Column, Column]:
    p, t, d = F.radians(lat), F.radians(degrees), metres / R
    p2 = F.asin(F.sin(p) * F.cos(d) + F.cos(p) * F.sin(d) * F.cos(t))
    return lng + F.degrees(F.atan2(F.sin(t) * F.sin(d) * F.cos(p), F.cos(d) - F.sin(p) * F.sin(p2))), F.degrees(p2)


def midpoint(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> tuple[Column, Column]:
    p1, p2, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    bx, by = F.cos(p2) * F.cos(d), F.cos(p2) * F.sin(d)
    return lng1 + F.degrees(F.atan2(by, F.cos(p1) + bx)), F.degrees(F.atan2(F.sin(p1) + F.sin(p2), F.sqrt((F.cos(p1) + bx) ** 2 + by ** 2)))


def _isometric(lat: Column, flat: float) -> Column:
    return F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * (1 - flat)


def _turn(d: Column) -> Column:
    """An angle brought into [-pi, pi)."""
    return F.pmod(d + math.pi, F.lit(2 * math.pi)) - math.pi


def rhumb_distance(lng1: Column, lat1: Column, lng2: Column, lat2: Column, compat: bool = True) -> Column:
    """``compat`` takes the flattened isometric difference for the latitude difference; the
    true distance on the sphere otherwise."""
    p1, p2 = F.radians(lat1), F.radians(lat2)
    flat = 1 / 298.257223563 if compat else 0.0
    psi = F.abs(_isometric(lat2, flat) - _isometric(lat1, flat))
    q = F.when(psi < (1e-15 if compat else 1e-12), F.cos((p1 + p2) / 2)).otherwise(F.abs(p2 - p1) / psi)
    return F.sqrt((psi if compat else p2 - p1) ** 2 + (q * _turn(F.radians(lng2 - lng1))) ** 2) * R


def rhumb_bearing(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    flat = 1 / 298.257223563
    return F.pmod(F.degrees(F.atan2(_turn(F.radians(lng2 - lng1)), _isometric(lat2, flat) - _isometric(lat1, flat))) + 360.0, F.lit(360.0))


def _letters(x: Column, y: Column, precision: int) -> Column:
    """The hash of a cell by its column and row."""
    bits = 5 * precision
    nx, ny = (bits + 1) // 2, bits // 2
    out = []
    for k in range(precision):
        code = F.lit(0).cast("long")
        for j in range(5 * k, 5 * k + 5):
            own, left = (x, nx - 1 - j // 2) if j % 2 == 0 else (y, ny - 1 - j // 2)
            code = code * 2 + F.shiftright(own, left).bitwiseAND(F.lit(1).cast("long"))
        out.append(F.substring(F.lit(BASE32), (code + 1).cast("int"), F.lit(1)))
    return F.concat(*out)


def geohash(lng: Column, lat: Column, precision: int) -> Column:
    """Cells by integer halving of both axes; precision is brought into 1..12."""
    precision = max(1, min(12, precision))
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    x = F.least(F.greatest(F.floor((lng + 180.0) / 360.0 * 2 ** nx), F.lit(0)), F.lit(2 ** nx - 1)).cast("long")
    y = F.least(F.greatest(F.floor((lat + 90.0) / 180.0 * 2 ** ny), F.lit(0)), F.lit(2 ** ny - 1)).cast("long")
    return _letters(x, y, precision)


def _cell(code: Column, precision: int) -> tuple[Column, Column]:
    """Column and row of the cell of a hash."""
    x = y = F.lit(0).cast("long")
    for k in range(precision):
        v = (F.instr(F.lit(BASE32), F.substring(code, k + 1, 1)) - 1).cast("long")
        for j in range(5):
            bit = F.shiftright(v, 4 - j).bitwiseAND(F.lit(1).cast("long"))
            if (5 * k + j) % 2 == 0:
                x = x * 2 + bit
            else:
                y = y * 2 + bit
    return x, y


def geohash_decode(code: Column, precision: int) -> dict[str, Column]:
    """Centre and half sizes of the cell of a hash of ``precision`` letters."""
    x, y = _cell(code, precision)
    w, h = 360.0 / 2 ** ((5 * precision + 1) // 2), 180.0 / 2 ** (5 * precision // 2)
    return {"lng": (x + 0.5) * w - 180.0, "lat": (y + 0.5) * h - 90.0, "err_lng": F.lit(w / 2), "err_lat": F.lit(h / 2)}


#: The sides of a cell, as steps of columns and rows.
AROUND = {"n": (0, 1), "ne": (1, 1), "e": (1, 0), "se": (1, -1), "s": (0, -1), "sw": (-1, -1), "w": (-1, 0), "nw": (-1, 1)}


def geohash_neighbors(df, code: str, precision: int):
    """``df`` with the eight hashes around the hash in column ``code``; the outermost cells
    are their own neighbours beyond the rim."""
    x, y = _cell(F.col(code), precision)
    nx, ny = (5 * precision + 1) // 2, 5 * precision // 2
    step = lambda c, d, n: f"least(greatest({c} + {d}, 0), {2 ** n - 1})"
    bit = f"(if(j % 2 = 0, shiftright(v.x, {nx - 1} - j div 2), shiftright(v.y, {ny - 1} - j div 2)) & 1)"
    letter = f"substring('{BASE32}', 1 + aggregate(sequence(5 * k, 5 * k + 4), 0, (s, j) -> s * 2 + cast({bit} as int)), 1)"
    whole = f"array_join(transform(sequence(0, {precision - 1}), k -> {letter}), '')"
    cells = ", ".join(f"struct({step('_x', dx, nx)} as x, {step('_y', dy, ny)} as y)" for dx, dy in AROUND.values())
    out = df.withColumns({"_x": x, "_y": y}).withColumn("_h", F.expr(f"transform(array({cells}), v -> {whole})"))
    return out.withColumns({k: F.col("_h")[i] for i, k in enumerate(AROUND)}).drop("_x", "_y", "_h")


def vincenty(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Metres on the WGS84 ellipsoid. Equal points are 0 apart; nearly antipodal ones, where the
    iteration has not settled after 200 steps, give NaN. The iteration runs on whole Arrow
    batches, and only for the rows that have not settled."""
    @F.pandas_udf("double")
    def run(x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series) -> pd.Series:
        a, f = 6378137.0, 1 / 298.257223563
        b = a * (1 - f)
        x1, y1, x2, y2 = (v.to_numpy(float) for v in (x1, y1, x2, y2))
        u1, u2, d = np.arctan((1 - f) * np.tan(np.radians(y1))), np.arctan((1 - f) * np.tan(np.radians(y2))), np.radians(x2 - x1)
        out = np.full(len(d), np.nan)
        same = (np.abs(x1 - x2) < 1e-12) & (np.abs(y1 - y2) < 1e-12)
        out[same] = 0.0
        todo, lam = np.flatnonzero(~same), d.copy()
        for _ in range(200):
            if not len(todo):
                break
            s1, c1, s2, c2 = np.sin(u1[todo]), np.cos(u1[todo]), np.sin(u2[todo]), np.cos(u2[todo])
            sl, cl = np.sin(lam[todo]), np.cos(lam[todo])
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            zero = sin_s < 1e-15
            out[todo[zero]] = 0.0
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = c1 * c2 * sl / np.where(zero, 1, sin_s)
            cos2_a = 1 - sin_a ** 2
            mid = np.where(np.abs(cos2_a) < 1e-15, 0.0, cos_s - 2 * s1 * s2 / np.where(cos2_a == 0, 1, cos2_a))
            c = f / 16 * cos2_a * (4 + f * (4 - 3 * cos2_a))
            new = d[todo] + (1 - c) * f * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid ** 2 - 1)))
            done = ~zero & (np.abs(new - lam[todo]) < 1e-12)
            uu = cos2_a * (a * a - b * b) / (b * b)
            k_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
            k_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
            turn = k_b * sin_s * (mid + k_b / 4 * (cos_s * (2 * mid ** 2 - 1) - k_b / 6 * mid * (4 * sin_s ** 2 - 3) * (4 * mid ** 2 - 3)))
            out[todo[done]] = (b * k_a * (sigma - turn))[done]
            lam[todo] = new
            todo = todo[~zero & ~done]
        return pd.Series(out)

    return run(lng1, lat1, lng2, lat2)


def segment_distance_sq(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Planar squared distance of a point and a segment."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n < 1e-20, 0.0).otherwise(F.least(F.greatest(((px - x1) * dx + (py - y1) * dy) / F.nullif(n, F.lit(0.0)), F.lit(0.0)), F.lit(1.0)))
    return (px - (x1 + t * dx)) ** 2 + (py - (y1 + t * dy)) ** 2


def oct16_decode(code: Column) -> tuple[Column, Column, Column]:
    """The unit vector of two octahedral bytes."""
    x, y = F.shiftright(code, 8) / F.lit(255.0) * 2 - 1, code.bitwiseAND(F.lit(255)) / F.lit(255.0) * 2 - 1
    low = 1 - F.abs(x) - F.abs(y) < 0
    sgn = lambda v: F.when((F.abs(v) > 1e-10) & (v < 0), -1.0).otherwise(1.0)
    ox, oy = F.when(low, (1 - F.abs(y)) * sgn(x)).otherwise(x), F.when(low, (1 - F.abs(x)) * sgn(y)).otherwise(y)
    # the height is that of the unfolded point on the upper side, and its mirror below
    oz = 1 - F.abs(x) - F.abs(y)
    n = F.greatest(F.sqrt(ox * ox + oy * oy + oz * oz), F.lit(1e-10))
    return ox / n, oy / n, oz / n


def oct16(nx: Column, ny: Column, nz: Column) -> Column:
    """A unit vector in two bytes, octahedral."""
    sgn = lambda v: F.when(v >= 0, 1.0).otherwise(-1.0)
    total = F.abs(nx) + F.abs(ny) + F.greatest(F.abs(nz), F.lit(1e-10))
    ox, oy = nx / total, ny / total
    fx = F.when(nz < 0, (1 - F.abs(oy)) * sgn(ox)).otherwise(ox)
    fy = F.when(nz < 0, (1 - F.abs(ox)) * sgn(oy)).otherwise(oy)
    u, v = (F.least(F.greatest(w * 0.5 + 0.5, F.lit(0.0)), F.lit(0.99999)) for w in (fx, fy))
    return (F.round(u * 255) * 256 + F.round(v * 255)).cast("int")


def screen_space_error(err: Column, distance: Column, fov: float, height: float) -> Column:
    return err / (F.greatest(distance, F.lit(1e-10)) * (2 * math.tan(fov / 2) / height))


def lerp(t: Column, a: float, b: float) -> Column:
    return F.lit(float(a)) + t * float(b - a)


def ramp(t: Column, stops: list[tuple[float, tuple[int, int, int]]], rounded: bool = True) -> list[Column]:
    """RGB of t in 0..1 between colour stops, rounded or truncated."""
    out = []
    for c in range(3):
        e = F.lit(float(stops[-1][1][c]))
        for (p, a), (q, b) in reversed(list(zip(stops, stops[1:]))):
            e = F.when(t <= q, lerp((t - p) / (q - p), a[c], b[c])).otherwise(e)
        out.append((F.round(e) if rounded else F.floor(e)).cast("int"))
    return out


# Colour stops.
TERRAIN = [(0.0, (0, 0, 128)), (0.25, (0, 128, 0)), (0.5, (255, 255, 0)), (0.75, (255, 64, 0)), (1.0, (255, 255, 255))]
HEAT = [(0.0, (0, 0, 255)), (0.25, (0, 255, 255)), (0.5, (0, 255, 0)), (0.75, (255, 255, 0)), (1.0, (255, 0, 0))]
OCEAN = [(0.0, (0, 0, 80)), (0.5, (0, 64, 192)), (1.0, (100, 200, 255))]
GREY = [(0.0, (0, 0, 0)), (1.0, (255, 255, 255))]

# Colours of the classes 0 to 22; others are grey.
CLASSES = [(255, 255, 255), (139, 90, 43), (34, 139, 34), (0, 180, 0), (0, 100, 0), (100, 100, 255), (139, 0, 0), (192, 192, 192), (255, 255, 0), (0, 0, 255), (255, 165, 0), (100, 100, 100),
           (128, 0, 128), (0, 255, 255), (255, 0, 255), (255, 0, 0), (255, 69, 0), (210, 180, 140), (200, 0, 0), (148, 0, 211), (101, 67, 33), (173, 216, 230), (255, 192, 203)]
OTHER_CLASS = (128, 128, 128)


def class_colour(cls: Column) -> list[Column]:
    """RGB of a class by the fixed table."""
    known = cls.between(0, len(CLASSES) - 1)
    return [F.when(known, F.get(F.array(*[F.lit(c[k]) for c in CLASSES]), cls.cast("int"))).otherwise(OTHER_CLASS[k]).cast("int") for k in range(3)]


def height_colour(z: Column, low: float, high: float, a: tuple, b: tuple) -> list[Column]:
    """RGBA in 0..1 between the colours a and b (0..255) by height; the middle for a flat range."""
    flat = abs(high - low) < 1e-10
    t = F.lit(0.5) if flat else F.least(F.greatest((z - low) / (high - low), F.lit(0.0)), F.lit(1.0))
    return [*((F.lit(float(p)) + t * float(q - p)) / 255.0 for p, q in zip(a, b)), F.lit(1.0)]


def intensity_colour(intensity: Column) -> list[Column]:
    """Grey RGBA in 0..1 of an intensity in 0..255; 128 where there is none."""
    v = F.least(F.greatest(F.coalesce(intensity, F.lit(128.0)) / 255.0, F.lit(0.0)), F.lit(1.0))
    return [v, v, v, F.lit(1.0)]


def padded_colour(r: Column, g: Column, b: Column, a: Column) -> list[Column]:
    """A point's own RGBA, half grey where it has none."""
    return [F.coalesce(c, F.lit(d)) for c, d in ((r, 0.5), (g, 0.5), (b, 0.5), (a, 1.0))]


def colour_ramp(spark, stops: list[tuple[int, int, int]], steps: int):
    """(step, r, g, b): ``steps`` colours between evenly spaced stops, truncated."""
    if len(stops) < 2 or steps < 1:
        raise ValueError("a ramp needs two colours and one step at least")
    at = F.col("id") / F.lit(float(max(steps - 1, 1))) * (len(stops) - 1)
    k = F.least(F.floor(at), F.lit(len(stops) - 2)).cast("int")
    chan = lambda c, i: F.get(F.array(*[F.lit(float(s[c])) for s in stops]), i)
    mixed = lambda c: F.floor((1 - (at - k)) * chan(c, k) + (at - k) * chan(c, k + 1)).cast("int")
    return spark.range(steps).select(F.col("id").alias("step"), mixed(0).alias("r"), mixed(1).alias("g"), mixed(2).alias("b"))
