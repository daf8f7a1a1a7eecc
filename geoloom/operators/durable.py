"""Cutting the lineage of iterative plans in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame


def _folder(spark) -> str:
    """``spark.checkpoint.dir``; a local session without that setting gets a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="geoloom-")
        atexit.register(shutil.rmtree, base, True)
        spark.sparkContext.setCheckpointDir(base)
    return base


def durable(df: DataFrame) -> DataFrame:
    """``df.checkpoint()`` in ``spark.checkpoint.dir``."""
    _folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """``df`` by way of a Parquet table there: for rows that are many, a fraction of a checkpoint's size."""
    spark = df.sparkSession
    path = f"{_folder(spark)}/geoloom-{spark.sparkContext.applicationId}/rows-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
