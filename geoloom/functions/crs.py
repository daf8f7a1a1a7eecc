"""Coordinate systems as Column expressions; all of it stays in generated code."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Krasovsky ellipsoid and box of the GCJ-02 offset, the BD-09 angle, the
# Mercator radius, and the WGS84 ellipsoid.
GCJ_A, GCJ_EE = 6378245.0, 0.00669342162
CHINA = (73.66, 135.05, 3.86, 53.55)
X_PI = math.pi * 3000.0 / 180.0
MERCATOR_R = 6378137.0
WGS84_A, WGS84_B = 6378137.0, 6356752.314245179
UTM_K0 = 0.9996

Pair = tuple[Column, Column]


def in_china(lng: Column, lat: Column) -> Column:
    return lng.between(CHINA[0], CHINA[1]) & lat.between(CHINA[2], CHINA[3])


def _wave(v: Column, *terms: tuple[float, float]) -> Column:
    return sum(F.sin(v * (math.pi / period)) * size for size, period in terms) * 2.0 / 3.0


def _gcj_offset(lng: Column, lat: Column) -> Pair:
    x, y = lng - 105.0, lat - 35.0
    both = _wave(x, (20.0, 1 / 6), (20.0, 0.5))
    t_lat = -100.0 + x * 2.0 + y * 3.0 + y * y * 0.2 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.2 + both + _wave(y, (20.0, 1), (40.0, 3)) + _wave(y, (160.0, 12), (320.0, 30))
    t_lng = 300.0 + x + y * 2.0 + x * x * 0.1 + x * y * 0.1 + F.sqrt(F.abs(x)) * 0.1 + both + _wave(x, (20.0, 1), (40.0, 3)) + _wave(x, (150.0, 12), (300.0, 30))
    phi = F.radians(lat)
    m = 1 - F.sin(phi) * F.sin(phi) * GCJ_EE
    d_lat = t_lat * 180.0 / (GCJ_A * (1 - GCJ_EE) / (m * F.sqrt(m)) * math.pi)
    d_lng = t_lng * 180.0 / (GCJ_A / F.sqrt(m) * F.cos(phi) * math.pi)
    return d_lng, d_lat


def wgs84_to_gcj02(lng: Column, lat: Column) -> Pair:
    d_lng, d_lat = _gcj_offset(lng, lat)
    inside = in_china(lng, lat)
    return F.when(inside, lng + d_lng).otherwise(lng), F.when(inside, lat + d_lat).otherwise(lat)


def gcj02_to_wgs84(lng: Column, lat: Column) -> Pair:
    """A single step back, as the forward offset at the shifted point."""
    x, y = wgs84_to_gcj02(lng, lat)
    return lng * 2 - x, lat * 2 - y


def gcj02_to_bd09(lng: Column, lat: Column) -> Pair:
    z = F.sqrt(lng * lng + lat * lat) + F.sin(lat * X_PI) * 0.00002
    t = F.atan2(lat, lng) + F.cos(lng * X_PI) * 0.000003
    return z * F.cos(t) + 0.0065, z * F.sin(t) + 0.006


def bd09_to_gcj02(lng: Column, lat: Column) -> Pair:
    x, y = lng - 0.0065, lat - 0.006
    z = F.sqrt(x * x + y * y) - F.sin(y * X_PI) * 0.00002
    t = F.atan2(y, x) - F.cos(x * X_PI) * 0.000003
    return z * F.cos(t), z * F.sin(t)


def wgs84_to_bd09(lng: Column, lat: Column) -> Pair:
    return gcj02_to_bd09(*wgs84_to_gcj02(lng, lat))


def bd09_to_wgs84(lng: Column, lat: Column) -> Pair:
    return gcj02_to_wgs84(*bd09_to_gcj02(lng, lat))


def to_mercator(lng: Column, lat: Column) -> Pair:
    return F.radians(lng) * MERCATOR_R, F.log(F.tan(F.radians(lat) / 2 + math.pi / 4)) * MERCATOR_R


def from_mercator(x: Column, y: Column) -> Pair:
    return F.degrees(x / MERCATOR_R), F.degrees(F.atan(F.exp(y / MERCATOR_R)) * 2 - math.pi / 2)


def wgs84_to_ecef(lng: Column, lat: Column, height: Column) -> tuple[Column, Column, Column]:
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    phi, lam = F.radians(lat), F.radians(lng)
    n = WGS84_A / F.sqrt(1 - F.sin(phi) * F.sin(phi) * e2)
    return (n + height) * F.cos(phi) * F.cos(lam), (n + height) * F.cos(phi) * F.sin(lam), (n * (1 - e2) + height) * F.sin(phi)


def utm_zone(lng: Column) -> Column:
    return F.least(F.greatest((F.floor((lng + 180) / 6) + 1).cast("int"), F.lit(1)), F.lit(60))


def wgs84_to_utm(lng: Column, lat: Column) -> dict[str, Column]:
    """Zone, easting, northing and hemisphere by Snyder's series."""
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    ep2 = e2 / (1 - e2)
    zone = utm_zone(lng)
    phi = F.radians(lat)
    s, c, t = F.sin(phi), F.cos(phi), F.tan(phi)
    n = WGS84_A / F.sqrt(1 - s * s * e2)
    tt, cc = t * t, c * c * ep2
    a = c * F.radians(lng - ((zone - 1) * 6 - 177))
    m = _arc(phi, e2)
    east = n * UTM_K0 * (a + (1 - tt + cc) * a ** 3 / 6 + (5 - tt * 18 + tt * tt + cc * 72 - 58 * ep2) * a ** 5 / 120) + 500000.0
    north = (m + n * t * (a * a / 2 + (5 - tt + cc * 9 + cc * cc * 4) * a ** 4 / 24 + (61 - tt * 58 + tt * tt + cc * 600 - 330 * ep2) * a ** 6 / 720)) * UTM_K0
    return {"zone": zone, "easting": east, "northing": F.when(lat < 0, north + 10000000.0).otherwise(north), "is_north": lat >= 0}


def _arc(phi: Column, e2: float) -> Column:
    e4, e6 = e2 * e2, e2 ** 3
    return (phi * (1 - e2 / 4 - 3 * e4 / 64 - 5 * e6 / 256) - F.sin(phi * 2) * (3 * e2 / 8 + 3 * e4 / 32 + 45 * e6 / 1024) + F.sin(phi * 4) * (15 * e4 / 256 + 45 * e6 / 1024) - F.sin(phi * 6) * (35 * e6 / 3072)) * WGS84_A


def utm_to_wgs84(zone: Column, easting: Column, northing: Column, is_north: Column) -> Pair:
    e2 = 1 - (WGS84_B / WGS84_A) ** 2
    ep2 = e2 / (1 - e2)
    e1 = (1 - math.sqrt(1 - e2)) / (1 + math.sqrt(1 - e2))
    x = easting - 500000.0
    y = F.when(is_north, northing).otherwise(northing - 10000000.0)
    mu = y / UTM_K0 / (WGS84_A * (1 - e2 / 4 - 3 * e2 * e2 / 64 - 5 * e2 ** 3 / 256))
    p = mu + F.sin(mu * 2) * (3 * e1 / 2 - 27 * e1 ** 3 / 32) + F.sin(mu * 4) * (21 * e1 ** 2 / 16 - 55 * e1 ** 4 / 32) + F.sin(mu * 6) * (151 * e1 ** 3 / 96) + F.sin(mu * 8) * (1097 * e1 ** 4 / 512)
    s, c, t = F.sin(p), F.cos(p), F.tan(p)
    cc, tt = c * c * ep2, t * t
    n = WGS84_A / F.sqrt(1 - s * s * e2)
    r = WGS84_A * (1 - e2) / (1 - s * s * e2) ** 1.5
    d = x / (n * UTM_K0)
    lat = p - n * t / r * (d * d / 2 - (5 + tt * 3 + cc * 10 - cc * cc * 4 - 9 * ep2) * d ** 4 / 24 + (61 + tt * 90 + cc * 298 + tt * tt * 45 - 252 * ep2 - cc * cc * 3) * d ** 6 / 720)
    lng = (d - (1 + tt * 2 + cc) * d ** 3 / 6 + (5 - cc * 2 + tt * 28 - cc * cc * 3 + 8 * ep2 + tt * tt * 24) * d ** 5 / 120) / c
    return F.degrees(lng) + ((zone - 1) * 6 - 177), F.degrees(lat)


def best_region(min_lng: Column, min_lat: Column, max_lng: Column, max_lat: Column) -> Column:
    """GCJ-02 where the centre is in China, Web Mercator for a span over 10 degrees, else WGS84."""
    wide = (max_lng - min_lng > 10) | (max_lat - min_lat > 10)
    return F.when(in_china((min_lng + max_lng) / 2, (min_lat + max_lat) / 2), "GCJ-02").when(wide, "EPSG:3857").otherwise("EPSG:4326")


#: The coordinate systems that are known, with their other names and bounds.
SYSTEMS = [
    ("EPSG:4326", "WGS 84", ("WGS84", "WGS-84"), (-180.0, -90.0, 180.0, 90.0), "degree"),
    ("EPSG:3857", "Web Mercator", ("WebMercator", "Web Mercator"), (-180.0, -85.05, 180.0, 85.05), "meter"),
    ("EPSG:4490", "CGCS2000", ("CGCS2000",), (73.66, 3.86, 135.05, 53.55), "degree"),
    ("GCJ-02", "GCJ-02 (Mars)", ("GCJ02",), (73.66, 3.86, 135.05, 53.55), "degree"),
    ("BD-09", "BD-09", ("BD09",), (73.66, 3.86, 135.05, 53.55), "degree"),
]


def supported(spark):
    """(code, name, unit, min_lng, min_lat, max_lng, max_lat) of every known system."""
    return spark.createDataFrame([(c, n, u, *b) for c, n, _, b, u in SYSTEMS], "code string, name string, unit string, min_lng double, min_lat double, max_lng double, max_lat double")


def info(code: str) -> dict | None:
    """One system by its code or another name of it; None if it isn't known."""
    for c, n, other, b, u in SYSTEMS:
        if code == c or code in other:
            return {"code": c, "name": n, "unit": u, "bounds": dict(zip(("minLng", "minLat", "maxLng", "maxLat"), b))}
    return None
