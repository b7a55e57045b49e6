"""A stream of messages: files in, decisions out, with the batch operators."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import policy
from ..schemas import Shop


def message_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).json(path)


def decide_stream(messages: DataFrame, shop: Shop, today: dt.date, customers: DataFrame) -> DataFrame:
    """The policy keeps no state, so a stream passes through it as a table does."""
    return policy.decide(policy.with_customer(messages, customers), shop, today)


def start(decisions: DataFrame, to: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends decisions as Parquet, each message once (the sink keeps a log of its files)."""
    writer = decisions.writeStream.format("parquet").option("path", to).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def start_versions(decisions: DataFrame, checkpoint: str, write: Callable[[DataFrame], None], once: bool = False) -> StreamingQuery:
    """Each micro-batch with its number as the version of what it changed."""

    def one(batch: DataFrame, number: int) -> None:
        write(batch.withColumn("version", F.lit(number)))

    writer = decisions.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def first_answers(records: DataFrame, within: str = "1 hour") -> DataFrame:
    """A stream of records (key, saved_ts, ...) with each key once while the watermark lasts."""
    return records.withWatermark("saved_ts", within).dropDuplicatesWithinWatermark(["key"])
