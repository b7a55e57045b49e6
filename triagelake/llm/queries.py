"""The opN_ queries over the driver's tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import benchmark_leaks as leaks
from . import balanced_shards as shards
from . import near_duplicates as near
from . import pair_bpe, pseudonyms, quality_ratio, sorted_tables, token_counts
from . import repeated_passages as passages
from . import toxic_passages as toxic
from .common import shared_path, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_karmarkar_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.balanced_shards(table(spark, sf_dir, "documents"), 16)


def op2_simhash_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_suffix_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(table(spark, sf_dir, "documents"))


def op4_toxic_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_pair_index_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_bpe.bpe_table(table(spark, sf_dir, "documents"))


def op6_suffix_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = leaks.benchmark_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leaks.n_words", "leaks.n_hit", "leaks.n_items", "leaks.items_sha256", (F.col("leaks.n_hit") > 0).alias("contaminated"))


def op7_quality_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_ratio.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", pseudonyms.pseudonymised(docs.text, pseudonyms.EXAMPLE_KEY).alias("p")).select("doc_id", "p.*")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op9_sorted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    to = shared_path(spark, "token-ids")
    sorted_tables.write_tables(table(spark, sf_dir, "documents"), to)
    return sorted_tables.read_tables(spark, to).select("doc_id", "start", "n_tokens", "ids_crc32")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = token_counts.token_counts(docs)
    return counted.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))


def queries() -> dict[str, Query]:
    import corpus_pipeline  # counts as part of this subpackage

    assert corpus_pipeline.STAGES
    ops = (
        op1_karmarkar_karp,
        op2_simhash_pigeonhole,
        op3_suffix_sort,
        op4_toxic_segments,
        op5_pair_index_bpe,
        op6_suffix_automaton,
        op7_quality_ratio,
        op8_feistel_pseudonyms,
        op9_sorted_tables,
        op10_token_counts,
        pipeline,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {}
