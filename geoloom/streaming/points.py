"""A LAS file as a stream whose offset is the record number, and files of a folder as a stream
of points or features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

from ..sources import decoded, geojson, las


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.path, self.step = options["path"], int(options.get("pointsPerBatch", 100_000))
        self.header = None

    def _open(self):
        if self.header is None:
            with open(self.path, "rb") as f:
                self.header = las.header(f.read(375))
        return self.header

    def initialOffset(self) -> dict:
        return {"point": 0}

    def _rows(self, start: int, end: int):
        h = self._open()
        with open(self.path, "rb") as f:
            f.seek(h.point_offset + start * h.record_length)
            frame = las.records(f.read((end - start) * h.record_length), las._checked(h), start)
        for r in frame.itertuples(index=False):
            yield tuple(None if v is None or v != v else v.item() if hasattr(v, "item") else v for v in (None if str(v) == "<NA>" else v for v in r))

    def read(self, start: dict):
        end = min(start["point"] + self.step, self._open().n_points)
        return self._rows(start["point"], end), {"point": end}

    def readBetweenOffsets(self, start: dict, end: dict):
        return self._rows(start["point"], end["point"])


class LasSource(DataSource):
    """``spark.readStream.format("las_points").option("path", ..)``: the points of one file of a
    local or mounted folder, ``pointsPerBatch`` at a time; a restart goes on from its offset."""

    @classmethod
    def name(cls) -> str:
        return "las_points"

    def schema(self) -> str:
        return las.SCHEMA

    def simpleStreamReader(self, schema):
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(LasSource)


def _new_files(spark: SparkSession, folder: str, files_per_trigger: int) -> DataFrame:
    return spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("maxFilesPerTrigger", files_per_trigger).load(folder).select("path", "content")


def point_files(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Points of the LAS files that arrive in a folder."""
    return decoded(_new_files(spark, folder, files_per_trigger), "path", "content", las.parse, las.SCHEMA)


def feature_files(spark: SparkSession, folder: str, files_per_trigger: int = 100, chunk: int = 10_000) -> DataFrame:
    """Features of the GeoJSON files that arrive in a folder, parsed ``chunk`` at a time."""
    return decoded(_new_files(spark, folder, files_per_trigger), "path", "content", lambda b: geojson.parse(b.decode("utf-8", "replace"), chunk), geojson.SCHEMA)


def region(points: DataFrame, start: int, count: int) -> DataFrame:
    """The records [start, start + count) of each file."""
    return points.where(points["idx"].between(start, start + count - 1))
