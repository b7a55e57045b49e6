"""State that a stream advances, kept as a table: one version for each micro-batch.

A version is written whole under the batch's number before the next batch begins, so a batch that is run again
writes the same version again, and a reader always finds a finished one.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators import runs, uploads

Step = Callable[[DataFrame | None, DataFrame, int], DataFrame]


def _versions(spark: SparkSession, path: str) -> list[int]:
    """Finished versions below a path, in order."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    at = hadoop.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(at):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    return sorted(int(n[8:]) for n in names if n.startswith("version-") and fs.exists(hadoop.Path(f"{path}/{n}/_SUCCESS")))


def current(spark: SparkSession, path: str, before: int | None = None) -> DataFrame | None:
    """The newest finished version (below a number), or None."""
    found = [v for v in _versions(spark, path) if before is None or v < before]
    return spark.read.parquet(f"{path}/version-{found[-1]}") if found else None


def start_table(stream: DataFrame, path: str, checkpoint: str, step: Step, once: bool = False, keep: int = 3) -> StreamingQuery:
    """Each micro-batch makes a version: step(the version before, or None; the batch; its number). The newest
    `keep` versions stay."""

    def one(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        step(current(spark, path, number), batch, number).write.mode("overwrite").parquet(f"{path}/version-{number}")
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
        for old in _versions(spark, path)[:-keep]:
            gone = hadoop.Path(f"{path}/version-{old}")
            gone.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(gone, True)

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def upload_store(most_bytes: int = uploads.STORE_BYTES, now: Callable[[], float] = time.time) -> Step:
    """A step that adds a batch of uploads (ord, size, attached, added_at, ...) to the store, and lets go what is
    too old or too much."""

    def step(store: DataFrame | None, batch: DataFrame, _: int) -> DataFrame:
        return uploads.retain(batch if store is None else store.unionByName(batch), now(), most_bytes)

    return step


def requested_items(ids: DataFrame, saved: DataFrame) -> Step:
    """A step over the items of run control: a batch of requests (id, pos, key) is queued, or answered from the
    saved answers. ids are the messages there are at the start."""

    def step(items: DataFrame | None, batch: DataFrame, number: int) -> DataFrame:
        return runs.request(runs.blank(ids) if items is None else items, batch, saved, number, 0)

    return step


__all__ = ["current", "requested_items", "start_table", "upload_store"]
