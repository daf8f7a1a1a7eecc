"""Readers: bytes or texts of one file each, in a column, to rows.

Every reader has a plain function from the content of a file to frames of bounded size, and
``decoded`` runs it over a DataFrame of files (``spark.read.format("binaryFile")``, or any
bytes column), a file a row. A file that breaks its format raises ``BadFile``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from ..functions import limits


class BadFile(ValueError):
    """Content that its format does not allow."""


class NoCodec(RuntimeError):
    """A format whose decoder is not installed."""


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of the files below ``path``."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


def decoded(df: DataFrame, key: str, content: str, parse: Callable[[bytes], Iterable[pd.DataFrame]], schema: str) -> DataFrame:
    """``parse`` of each row's content: its rows, their columns in the order of ``schema``, with
    the row's ``key`` before them. A null content has no rows; one beyond the input limit raises."""
    key_type = next(f.dataType.simpleString() for f in df.schema.fields if f.name == key)
    most, names = limits.get_input_size_limit(), StructType.fromDDL(schema).names

    def run(frames):
        limits.set_input_size_limit(most)
        for pdf in frames:
            for k, c in zip(pdf[key], pdf[content]):
                if c is not None:
                    limits.check_input_size(len(c), str(k))
                    for out in parse(c if isinstance(c, str) else bytes(c)):
                        out.columns = names
                        out.insert(0, key, k)
                        yield out

    return df.select(key, content).mapInPandas(run, f"{key} {key_type}, {schema}")


def chunks(frame: pd.DataFrame, size: int = 100_000) -> Iterable[pd.DataFrame]:
    for at in range(0, len(frame), size):
        yield frame.iloc[at:at + size].copy()
