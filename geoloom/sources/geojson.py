"""GeoJSON texts to features, and filters and edits of these.

A feature is a row: its number in the text, geometry type, positions (the third ordinate
dropped, the parts of a geometry one after the other, collections walked through), and
properties as a JSON object. ``Unknown`` is the type of a feature without geometry.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import BadFile, decoded

SCHEMA = "feature long, type string, coords array<struct<x:double,y:double>>, properties string"
_SPACE = " \t\r\n"


def positions(geometry: dict | None) -> list[tuple[float, float]]:
    """All positions of a geometry, in order."""
    if not geometry:
        return []
    if geometry.get("type") == "GeometryCollection":
        return [p for g in geometry.get("geometries") or [] for p in positions(g)]
    out, todo = [], [geometry.get("coordinates") or []]
    while todo:
        c = todo.pop()
        if c and isinstance(c[0], (int, float)):
            if len(c) >= 2:
                out.append((float(c[0]), float(c[1])))
        else:
            todo.extend(x for x in reversed(c) if isinstance(x, list))
    return out


def features(text: str):
    """The features of a text one at a time, without parsing the ones to come. A bare feature
    or geometry is one."""
    decoder = json.JSONDecoder()
    start = _features_at(text)
    if start is None:
        try:
            one = json.loads(text)
        except ValueError as e:
            raise BadFile(f"not GeoJSON: {e}") from None
        if not isinstance(one, dict) or "type" not in one:
            raise BadFile("no GeoJSON object")
        if one["type"] == "FeatureCollection":
            raise BadFile("a collection without features")
        yield one if one["type"] == "Feature" else {"type": "Feature", "geometry": one, "properties": None}
        return
    at = start
    while True:
        while at < len(text) and text[at] in _SPACE + ",":
            at += 1
        if at >= len(text):
            raise BadFile("the list of features has no end")
        if text[at] == "]":
            return
        try:
            feature, at = decoder.raw_decode(text, at)
        except ValueError as e:
            raise BadFile(f"not GeoJSON: {e}") from None
        yield feature


def _features_at(text: str) -> int | None:
    """Where the outermost list of features begins; None if the object has none."""
    decoder, at = json.JSONDecoder(), 0
    skip = lambda i: next((j for j in range(i, len(text)) if text[j] not in _SPACE), len(text))
    at = skip(at)
    if at >= len(text) or text[at] != "{":
        return None
    at += 1
    try:
        while True:
            at = skip(at)
            if text[at] == ",":
                at = skip(at + 1)
            if text[at] == "}":
                return None
            key, at = decoder.raw_decode(text, at)
            at = skip(at)
            if text[at] != ":":
                return None
            at = skip(at + 1)
            if key == "features" and text[at] == "[":
                return at + 1
            _, at = decoder.raw_decode(text, at)
    except (ValueError, IndexError):
        return None


def _row(number: int, f: dict) -> tuple:
    g, p = f.get("geometry"), f.get("properties")
    return number, (g or {}).get("type") or "Unknown", [{"x": x, "y": y} for x, y in positions(g)], None if p is None else json.dumps(p, ensure_ascii=False, separators=(",", ":"))


def parse(text: str, chunk: int = 10_000):
    """Frames of at most ``chunk`` features."""
    rows = []
    for i, f in enumerate(features(text)):
        rows.append(_row(i, f))
        if len(rows) == chunk:
            yield pd.DataFrame(rows, columns=["feature", "type", "coords", "properties"])
            rows = []
    if rows:
        yield pd.DataFrame(rows, columns=["feature", "type", "coords", "properties"])


def read(df: DataFrame, key: str, text: str) -> DataFrame:
    """A row a feature of each text."""
    return decoded(df, key, text, parse, SCHEMA)


def read_lines(df: DataFrame, line: str) -> DataFrame:
    """A row a feature of line-delimited GeoJSON, as ``spark.read.text`` splits it."""
    return read(df.withColumn("_line", F.monotonically_increasing_id()), "_line", line)


def coordinates(features_: DataFrame, key: str) -> DataFrame:
    """(key, feature, pos, lng, lat): a row a position."""
    return features_.select(key, "feature", F.posexplode("coords").alias("pos", "p")).select(key, "feature", "pos", F.col("p.x").alias("lng"), F.col("p.y").alias("lat"))


def offsets(features_: DataFrame, key: str) -> DataFrame:
    """(key, feature, type, count, offset): where each feature's positions begin among those
    of its text."""
    w = Window.partitionBy(key).orderBy("feature").rowsBetween(Window.unboundedPreceding, -1)
    n = F.size("coords").cast("long")
    return features_.select(key, "feature", "type", n.alias("count"), F.coalesce(F.sum(n).over(w), F.lit(0)).alias("offset"))


def count(features_: DataFrame, key: str) -> DataFrame:
    return features_.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def chunked(features_: DataFrame, size: int) -> DataFrame:
    """Features with the number of the chunk of ``size`` that each belongs to."""
    return features_.withColumn("chunk", F.floor(F.col("feature") / size))


def _member(name: str) -> Column:
    return F.variant_get(F.try_parse_json("properties"), f"$['{name}']", "variant")


def where_property(features_: DataFrame, name: str, value) -> DataFrame:
    """Features whose property equals a string, a number (to 1e-10) or a boolean."""
    v = _member(name)
    kind = F.schema_of_variant(v)
    if isinstance(value, bool):
        test = (kind == "BOOLEAN") & (F.try_variant_get(v, "$", "boolean") == value)
    elif isinstance(value, str):
        test = (kind == "STRING") & (F.try_variant_get(v, "$", "string") == value)
    else:
        test = kind.isin("BIGINT", "DOUBLE") | kind.startswith("DECIMAL")
        test = test & (F.abs(F.try_variant_get(v, "$", "double") - float(value)) < 1e-10)
    return features_.where(F.coalesce(test, F.lit(False)))


def in_box(features_: DataFrame, x0: float, y0: float, x1: float, y1: float) -> DataFrame:
    """Features with any vertex in the closed box."""
    return features_.where(F.exists("coords", lambda p: p["x"].between(x0, x1) & p["y"].between(y0, y1)))


def count_by_property(features_: DataFrame, name: str) -> DataFrame:
    """(value, n) of a property; features without it are passed over, null counts as null."""
    has = F.array_contains(F.coalesce(F.json_object_keys("properties"), F.array().cast("array<string>")), name)
    text = F.coalesce(F.get_json_object("properties", f"$['{name}']"), F.lit("null"))
    return features_.where(has).groupBy(text.alias("value")).agg(F.count(F.lit(1)).alias("n"))


def _edited(features_: DataFrame, edit) -> DataFrame:
    """``edit`` of the properties as a map of JSON values; null properties stay null."""
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            p = json.loads(t)
            edit(p)
            return json.dumps(p, ensure_ascii=False, separators=(",", ":"))
        return s.map(one)

    return features_.withColumn("properties", run("properties"))


def add_property(features_: DataFrame, name: str, value) -> DataFrame:
    return _edited(features_, lambda p: p.__setitem__(name, value))


def rename_property(features_: DataFrame, old: str, new: str) -> DataFrame:
    return _edited(features_, lambda p: old in p and p.__setitem__(new, p.pop(old)))


def remove_property(features_: DataFrame, name: str) -> DataFrame:
    return _edited(features_, lambda p: p.pop(name, None))
