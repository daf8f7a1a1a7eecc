"""Sizes and capabilities: limits on single files, memory estimates, and what can be read.

A cluster has no linear memory of its own to grow, so the limits here guard what one task
holds at a time: the bytes of one input file and the bytes that a caller allows itself.
"""

from __future__ import annotations

import importlib.util
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

VERSION = "0.2.0"
#: Bytes of one input file unless changed; 0 lifts the limit.
DEFAULT_INPUT_LIMIT = 100 * 1024 * 1024
_state = {"input": DEFAULT_INPUT_LIMIT, "memory": 0}


class InputTooLarge(ValueError):
    """A file beyond the input limit."""


def version() -> str:
    return VERSION


def set_input_size_limit(n: int) -> None:
    _state["input"] = int(n)


def get_input_size_limit() -> int:
    return _state["input"]


def check_input_size(n: int, label: str) -> None:
    if _state["input"] and n > _state["input"]:
        raise InputTooLarge(f"input too large ({n} > {_state['input']} bytes): {label}")


def set_max_memory(n: int) -> None:
    _state["memory"] = int(n)


def get_max_memory() -> int:
    return _state["memory"]


def check_memory_available(n: int) -> bool:
    """Whether ``n`` bytes keep within the limit, if there is one."""
    return not _state["memory"] or n <= _state["memory"]


@dataclass
class MemoryInfo:
    total: int
    used: int
    remaining: int


def memory_info(spark: SparkSession) -> MemoryInfo:
    """Storage memory of all executors, as the block manager states it."""
    total = left = 0
    status = spark.sparkContext._jsc.sc().getExecutorMemoryStatus()
    rows = status.iterator()
    while rows.hasNext():
        pair = rows.next()._2()
        total, left = total + int(pair._1()), left + int(pair._2())
    return MemoryInfo(total, total - left, left)


def octree_bytes(points: Column) -> Column:
    """Positions, order, nodes and buffers of an octree build over so many points."""
    nodes = F.greatest(F.floor(points / 50_000), F.lit(1)) * 9
    return points * 12 + points * 8 + nodes * 140 + points * 6 + 1024


def points_bytes(points: Column, colour: Column, normals: Column) -> Column:
    """Positions, colours, normals, nodes and encoded tiles of so many points."""
    nodes = F.greatest(F.floor(points / 50_000), F.lit(1)) * 9
    return points * 12 + F.when(colour, points * 3).otherwise(0) + F.when(normals, points * 12).otherwise(0) + nodes * 64 + points * 14 + 1024


def octree_used(nodes: Column, internal: Column, points: Column) -> Column:
    """Bytes of a built octree: internal nodes, leaves, positions."""
    return internal * 140 + (nodes - internal) * 72 + points * 12 + 64


def supports_multi_thread(spark: SparkSession) -> bool:
    return thread_count(spark) > 1


def thread_count(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


#: What each format needs and whether it is here.
_FORMATS = {
    "las": ("built in", True), "geotiff": ("built in: none and DEFLATE compression", True), "worker": ("Spark tasks", True),
    "laz": ("needs a LAZ codec (lazrs)", importlib.util.find_spec("lazrs") is not None), "copc": ("headers and ranges built in; points need a LAZ codec (lazrs)", importlib.util.find_spec("lazrs") is not None),
    "e57": ("magic and header only", False), "draco": ("no encoder", False),
}


def supports(name: str) -> bool:
    return _FORMATS.get(name, ("", False))[1]


def status(name: str) -> str:
    text, there = _FORMATS.get(name, ("unknown format", False))
    return f"{name}: {'available' if there else 'not available'} ({text})"
