"""Work handed to the cluster in the background: it tells its progress and can be cancelled."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession


class Worker:
    """Runs functions of a session in a job group of its own, one after the other."""

    def __init__(self, spark: SparkSession):
        self.spark, self.group, self.ended = spark, f"geoloom-{uuid.uuid4().hex}", False
        self.result, self.error, self.thread = None, None, None

    def submit(self, work: Callable[[SparkSession], object]) -> "Worker":
        """Starts ``work``; ``wait`` gives what it returns."""
        if self.ended:
            raise RuntimeError("the worker has been terminated")
        if self.thread and self.thread.is_alive():
            raise RuntimeError("the worker is at work")
        self.result = self.error = None

        def run():
            self.spark.sparkContext.setJobGroup(self.group, "geoloom worker", True)
            try:
                self.result = work(self.spark)
            except Exception as e:  # told to whoever waits
                self.error = e

        self.thread = InheritableThread(target=run, session=self.spark)
        self.thread.start()
        return self

    def progress(self) -> tuple[int, int]:
        """Tasks that are done and all tasks, of the jobs that are running."""
        tracker = self.spark.sparkContext.statusTracker()
        done = total = 0
        for job in tracker.getJobIdsForGroup(self.group):
            for stage in (info.stageIds if (info := tracker.getJobInfo(job)) else []):
                if s := tracker.getStageInfo(stage):
                    done, total = done + s.numCompletedTasks, total + s.numTasks
        return done, total

    def wait(self, timeout: float | None = None):
        if self.thread:
            self.thread.join(timeout)
            if self.thread.is_alive():
                raise TimeoutError("the worker is still at work")
        if self.error:
            raise self.error
        return self.result

    def cancel(self) -> None:
        self.spark.sparkContext.cancelJobGroup(self.group)

    def terminate(self) -> None:
        self.ended = True
        self.cancel()


def supports_worker() -> bool:
    return True


def process_terrain(worker: Worker, grid: DataFrame, key: str, max_zoom: int) -> Worker:
    """Terrain tiles of a grid in the background; ``wait`` gives their rows' summary."""
    from ..sinks.tiles import terrain_tiles

    return worker.submit(lambda _: terrain_tiles(grid, key, max_zoom).select(key, "level", "width", "height").toPandas())


def process_chunked(df: DataFrame, size: int, work: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """``work`` of the rows, ``size`` at a time, wherever they lie; its results in one frame."""
    def run(frames: Iterator[pd.DataFrame]):
        held: list[pd.DataFrame] = []
        n = 0
        for pdf in frames:
            held.append(pdf)
            n += len(pdf)
            while n >= size:
                rows = pd.concat(held, ignore_index=True)
                yield work(rows.iloc[:size])
                held, n = [rows.iloc[size:]], n - size
        if n:
            yield work(pd.concat(held, ignore_index=True))

    return df.mapInPandas(run, schema)


_lock = threading.Lock()


def for_each_chunk(df: DataFrame, size: int, key: str, callback: Callable[[pd.DataFrame, int, int], None]) -> int:
    """Hands a frame's rows by ``key`` to ``callback(rows, done, total)``, ``size`` at a time. A
    partition at a time comes to the driver; returns the rows handed over."""
    total, done, held = df.count(), 0, []
    columns = df.columns
    with _lock:
        for r in df.orderBy(key).toLocalIterator(prefetchPartitions=True):
            held.append(r)
            if len(held) == size:
                done += size
                callback(pd.DataFrame(held, columns=columns), done, total)
                held = []
        if held:
            done += len(held)
            callback(pd.DataFrame(held, columns=columns), done, total)
    return done
