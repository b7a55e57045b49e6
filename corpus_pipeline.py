"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triagelake.llm import benchmark_leaks, pair_bpe, pseudonyms, similar_texts, toxic_passages
from triagelake.llm.common import bound_batches, discard, shared_path, table


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go."""
    return toxic_passages.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays: SimHash (and, where its radius ends, MinHash) of
    five-word shingles proposes, a similarity of 0.8 or more of the whole texts decides."""
    bound_batches(spark)
    return similar_texts.keep_first_similar(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of benchmark items go, and documents that are little else."""
    # every hit run holds a whole window, or a whole item of fewer words: none is too short to cut
    found = benchmark_leaks.benchmark_leaks(docs, table(spark, sf_dir, "benchmark"), max_run=1)
    return benchmark_leaks.remove_leaks(found, max_run=1)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data becomes pseudonyms, under the key that the session names in spark.pseudonyms.key."""
    bound_batches(spark)
    return pseudonyms.pseudonymise(docs, spark.conf.get("spark.pseudonyms.key", pseudonyms.EXAMPLE_KEY))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left."""
    bound_batches(spark)
    return pair_bpe.bpe_ids(docs)


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("pii", pii), ("encode", encode)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, read from the files it wrote; the other stages' files go when the next ones stand."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        at = shared_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before:
            discard(spark, before)
        before = at
    return docs
