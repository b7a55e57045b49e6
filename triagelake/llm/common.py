"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a batch that goes to a Python worker; Spark's default of 64 MB, times what Python objects take,
#: is much of a small executor.
ARROW_BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession) -> None:
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.conf.get(name).rstrip("b")  # a number of bytes, unless somebody chose another unit
    if given.isdigit() and int(given) > ARROW_BATCH_BYTES:
        spark.conf.set(name, str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is configured, a local session (tests) gets a new
    one; on a cluster that is an error, since no folder of one machine would do."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(at)
    return at


def shared_path(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes what shared_path named, by the file system that the path belongs to."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def own(df: DataFrame, *names: str) -> list[str]:
    """Column names like these that df does not have, so that none of its columns is hidden or lost."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared checkpoint folder, with a lineage that starts there."""
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def scan_parallelism(spark: SparkSession) -> int:
    """Partitions for work that follows a read: the session's shuffle partitions, and twice the cores at least."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


#: Bytes of a table's files for each task that gets its texts by a shuffle (texts are some times as large unpacked).
TASK_BYTES = 32 << 20


def size_parallelism(df: DataFrame) -> int:
    """Partitions for df's texts: as many as the size of the tables that it reads asks for, by what the plan
    knows of their files; the session's number where that is more, or where a size is unknown. Costs no job."""
    least = scan_parallelism(df.sparkSession)
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return least if size >= 1 << 60 else max(least, min(1 << 17, -(-size // TASK_BYTES)))


def tokenizer_path(name: str) -> str:
    """A public vocabulary file: a path as it stands, or the name of a file of public_tokenizers."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def give_back() -> None:
    """At a task's end: returns what a Python worker has freed to the system. Workers live on from task to
    task, and the next stage's need that memory."""
    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass
