"""Mapbox vector tiles to features."""

from __future__ import annotations

import itertools
import json
import math
import struct

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import limits
from . import BadFile

SCHEMA = "layer string, extent int, version int, id long, type string, parts array<array<struct<x:double,y:double>>>, properties string"
KINDS = {1: "Point", 2: "LineString", 3: "Polygon"}


def _varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        if at >= len(b) or shift > 63:
            raise BadFile("a number is cut off")
        n |= (b[at] & 127) << shift
        at += 1
        if b[at - 1] < 128:
            return n, at
        shift += 7


def _fields(b: bytes):
    """(number, wire type, value) of a message."""
    at = 0
    while at < len(b):
        key, at = _varint(b, at)
        wire = key & 7
        if wire == 0:
            v, at = _varint(b, at)
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            v, at = b[at:at + n], at + n
        elif wire == 2:
            n, at = _varint(b, at)
            v, at = b[at:at + n], at + n
            if len(v) < n:
                raise BadFile("a field is cut off")
        else:
            raise BadFile(f"wire type {wire}")
        yield key >> 3, wire, v


def _packed(b: bytes) -> list[int]:
    out, at = [], 0
    while at < len(b):
        v, at = _varint(b, at)
        out.append(v)
    return out


def zag(n: int) -> int:
    return n >> 1 if not n & 1 else -(n >> 1) - 1


def _value(b: bytes):
    for number, _, v in _fields(b):
        if number == 1:
            return v.decode("utf-8", "replace")
        if number in (2, 3):
            return struct.unpack("<f" if number == 2 else "<d", v)[0]
        if number == 4:
            return v if v < 1 << 63 else v - (1 << 64)
        return {5: v, 6: zag(v), 7: bool(v)}.get(number)
    return None


def parts_of(kind: int, words: list[int]) -> list[list[tuple[int, int]]]:
    """Positions by the commands; a closed ring repeats its first."""
    out, x, y, at = [], 0, 0, 0
    while at < len(words):
        command, n = words[at] & 7, words[at] >> 3
        at += 1
        if command == 7:
            if out:
                out[-1].append(out[-1][0])
            continue
        if command not in (1, 2) or at + 2 * n > len(words):
            raise BadFile("a geometry that does not add up")
        for _ in range(n):
            x, y, at = x + zag(words[at]), y + zag(words[at + 1]), at + 2
            if command == 1 and (kind != 1 or not out):
                out.append([])
            elif command == 2 and not out:
                raise BadFile("a line from nowhere")
            out[-1].append((x, y))
    return out


def layers(b: bytes):
    """(name, extent, version, features) of every layer; a feature is (id, kind, parts, properties)."""
    for name, extent, version, features in _layers(b):
        yield name, extent, version, list(features)


def _layers(b: bytes):
    """``layers``, with each one's features as they are asked for."""
    for number, wire, body in _fields(b):
        if number != 3 or wire != 2:
            continue
        name, extent, version, raw, keys, values = "", 4096, 1, [], [], []
        for n, _, v in _fields(body):
            if n == 1:
                name = v.decode("utf-8", "replace")
            elif n == 2:
                raw.append(v)
            elif n == 3:
                keys.append(v.decode("utf-8", "replace"))
            elif n == 4:
                values.append(_value(v))
            elif n == 5:
                extent = v
            elif n == 15:
                version = v
        yield name, extent, version, _features(raw, keys, values)


def _features(raw: list[bytes], keys: list, values: list):
    """Features of a layer; properties that equal tags give are shared."""
    held: dict = {}
    for r in raw:
        fid, kind, tagged, geometry = None, 0, b"", []
        for n, _, v in _fields(r):
            if n == 1:
                fid = v
            elif n == 2:
                tagged = v
            elif n == 3:
                kind = v
            elif n == 4:
                geometry = _packed(v)
        if tagged not in held:
            tags = _packed(tagged)
            if any(k >= len(keys) for k in tags[::2]) or any(v >= len(values) for v in tags[1::2]):
                raise BadFile("a tag that is not there")
            held[tagged] = {keys[k]: values[v] for k, v in zip(tags[::2], tags[1::2])}
        yield fid, kind, parts_of(kind, geometry), held[tagged]


def read(df: DataFrame, key: str, content: str) -> DataFrame:
    """A row a feature of every layer of each tile, on the tile's grid."""
    import pyarrow as pa

    key_type = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)
    most, schema = limits.get_input_size_limit(), to_arrow_schema(StructType.fromDDL(SCHEMA))

    def rows(b):
        texts = {}
        for name, extent, version, features in _layers(b):
            for fid, kind, parts, props in features:
                if (text := texts.get(same := tuple((k, type(v), v) for k, v in props.items()))) is None:
                    if len(texts) >= 4096:
                        texts.clear()
                    text = texts[same] = json.dumps(props, ensure_ascii=False)
                yield name, extent, version, fid, KINDS.get(kind, "Unknown"), [[{"x": float(x), "y": float(y)} for x, y in p] for p in parts], text

    def run(batches):
        limits.set_input_size_limit(most)
        for batch in batches:
            for i in range(len(batch)):
                one = batch.slice(i, 1)
                if (c := one.column(1)[0].as_py()) is None:
                    continue
                limits.check_input_size(len(c), str(one.column(0)[0].as_py()))
                found = rows(c)
                while some := list(itertools.islice(found, 4096)):
                    columns = [pa.array(v, f.type) for v, f in zip(zip(*some), schema)]
                    yield pa.RecordBatch.from_arrays([one.column(0).take(pa.array([0] * len(some), pa.int64())), *columns], [key, *schema.names])

    return df.select(key, content).mapInArrow(run, f"{key} {key_type}, {SCHEMA}")


def info(features: DataFrame, key: str) -> DataFrame:
    """(key, layer, extent, version, features, points, lines, polygons)."""
    count = lambda t: F.count_if(F.col("type") == t)
    return features.groupBy(key, "layer", "extent", "version").agg(F.count(F.lit(1)).alias("features"), count("Point").alias("points"), count("LineString").alias("lines"), count("Polygon").alias("polygons"))


def to_wgs84(features: DataFrame, zoom: int, x: str, y: str) -> DataFrame:
    """Parts in degrees, by the tile's place: ``x`` and ``y`` name its columns."""
    n = float(2 ** zoom)
    lng = lambda p: (F.col(x) + p["x"] / F.col("extent")) / n * 360 - 180
    lat = lambda p: F.degrees(2 * F.atan(F.exp(F.lit(math.pi) * (1 - 2 * (F.col(y) + p["y"] / F.col("extent")) / n))) - math.pi / 2)
    return features.withColumn("parts", F.transform("parts", lambda part: F.transform(part, lambda p: F.struct(lng(p).alias("x"), lat(p).alias("y")))))


def to_geojson(features: DataFrame) -> DataFrame:
    """``feature``: each row as a GeoJSON feature, in degrees or tile units as its parts are."""
    pair = lambda p: F.array(p["x"], p["y"])
    part = lambda q: F.to_json(F.transform(q, pair))
    first = F.col("parts")[0]
    one = (F.col("type") == "Point") & (F.size(first) == 1)
    kind = F.when(one, "Point").when(F.col("type") == "Point", "MultiPoint").when((F.col("type") == "LineString") & (F.size("parts") > 1), "MultiLineString").otherwise(F.col("type"))
    coords = F.when(one, F.to_json(pair(first[0]))).when(kind.isin("MultiPoint", "LineString"), part(first)).otherwise(F.to_json(F.transform("parts", lambda q: F.transform(q, pair))))
    text = F.concat(F.lit('{"type":"Feature","geometry":{"type":"'), kind, F.lit('","coordinates":'), coords, F.lit('},"properties":'), F.coalesce("properties", F.lit("{}")), F.lit("}"))
    return features.withColumn("feature", text)


class TileCache:
    """The last ``most`` tiles that were asked for, by zoom, x and y."""

    def __init__(self, get, most: int = 64):
        from collections import OrderedDict

        self.get_tile, self.most, self.held = get, most, OrderedDict()

    def get(self, z: int, x: int, y: int):
        key = (z, x, y)
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = self.get_tile(z, x, y)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[key]

    def clear(self):
        self.held.clear()

    def __len__(self):
        return len(self.held)
