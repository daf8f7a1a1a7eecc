"""Rows to GeoJSON, by to_json."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pairs(coords: Column) -> Column:
    return F.transform(coords, lambda p: F.array(p["x"], p["y"]))


def geometry(coords: Column, kind: str) -> Column:
    """A geometry of one type from positions (array of x, y): the first of a Point, one ring
    of a Polygon, all of a LineString or MultiPoint."""
    if kind == "Point":
        c = _pairs(coords)[0]
    elif kind == "Polygon":
        c = F.array(_pairs(coords))
    elif kind in ("LineString", "MultiPoint"):
        c = _pairs(coords)
    else:
        raise ValueError(f"no geometry of type {kind}")
    return F.struct(F.lit(kind).alias("type"), c.alias("coordinates"))


def feature(coords: Column, kind: str, properties: Column | None = None) -> Column:
    """The text of a feature; ``properties`` is a struct or a map, an empty object without it."""
    p = F.create_map().cast("map<string,string>") if properties is None else properties
    return F.to_json(F.struct(F.lit("Feature").alias("type"), geometry(coords, kind).alias("geometry"), p.alias("properties")))


def collection(df: DataFrame, key: str, order: str, feature_: str) -> DataFrame:
    """(key, text): the feature texts of a key, in order, as one collection."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order, feature_))), lambda v: v[feature_])
    return df.groupBy(key).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(listed, ","), F.lit("]}")).alias("text"))


def split_rings(coords: Column) -> Column:
    """Positions of polygons one after the other, as rings: each ends where it comes back to
    its first position, to 1e-12; what is left open at the end is a ring too."""
    near = lambda a, b: (F.abs(a["x"] - b["x"]) < 1e-12) & (F.abs(a["y"] - b["y"]) < 1e-12)
    point = "struct<x:double,y:double>"
    start = F.struct(F.array().cast(f"array<array<{point}>>").alias("done"), F.array().cast(f"array<{point}>").alias("open"))

    def step(s, p):
        ring = F.concat(s["open"], F.array(p))
        closes = (F.size(s["open"]) >= 3) & near(s["open"][0], p)
        return F.when(closes, F.struct(F.concat(s["done"], F.array(ring)).alias("done"), F.array().cast(f"array<{point}>").alias("open"))).otherwise(F.struct(s["done"].alias("done"), ring.alias("open")))

    return F.aggregate(coords, start, step, lambda s: F.when(F.size(s["open"]) > 0, F.concat(s["done"], F.array(s["open"]))).otherwise(s["done"]))
