"""The board: statistics over finished items, and what changed between two states of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import lazy as F
from pyspark.sql.window import Window

from .ranges import running_total


def exact_upper_median(df: DataFrame, value: str) -> DataFrame:
    """sorted[n // 2] of non-null values, without collecting them: counts by value, and a running sum over
    the distinct values. One row; null for no values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n"))
    upto = running_total(counts, "v", "n", "upto", newest_first=False)
    n = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all"))
    return upto.crossJoin(F.broadcast(n)).where(F.col("upto") > F.floor(F.col("all") / 2)).agg(F.min("v").alias(value))


def stats(items: DataFrame) -> DataFrame:
    """One row over items (lane, matches_expected, latency_ms, cost_usd, list_price_usd, cost_is_estimate;
    lane is null until an item is done). Null and zero latencies do not count."""
    done = F.col("lane").isNotNull()
    latency = F.when(done & (F.col("latency_ms") != 0), F.col("latency_ms"))
    return items.agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("routed"),
        F.count_if(done & (F.col("lane") != "review")).alias("auto"),
        F.count_if(F.col("lane") == "review").alias("review"),
        F.count(F.when(done, F.col("matches_expected"))).alias("graded"),
        F.count_if(done & F.col("matches_expected")).alias("matches"),
        F.avg(latency).alias("avg_latency_ms"),
        F.sum(F.when(done, F.coalesce("cost_usd", F.lit(0.0)))).alias("cost_usd"),
        F.sum(F.when(done, F.coalesce("list_price_usd", F.lit(0.0)))).alias("list_price_usd"),
        F.coalesce(F.bool_or(done & ~F.coalesce("cost_is_estimate", F.lit(True))), F.lit(False)).alias("cost_reported"),
    )


def stats_with_median(items: DataFrame) -> DataFrame:
    latencies = items.where("lane is not null and latency_ms <> 0").select(F.col("latency_ms").alias("median_latency_ms"))
    return stats(items).crossJoin(exact_upper_median(latencies, "median_latency_ms"))


def lane_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("lane").agg(F.count("*").alias("n"))


def signature(*cols: Column) -> Column:
    """One digest of whatever makes an item worth sending again."""
    return F.sha2(F.to_json(F.struct(*[c.alias(f"c{i}") for i, c in enumerate(cols)])), 256)


def changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """(id, change): added, changed or removed between two tables of (id, sig)."""
    p, c = previous.select("id", F.col("sig").alias("old")), current.select("id", F.col("sig").alias("new"))
    both = p.join(c, "id", "full_outer")
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return both.select("id", kind.alias("change")).where("change is not null")


def versioned(versions: DataFrame) -> DataFrame:
    """(id, version, sig) with one row an item and version to (id, changed_at): the version of an item's
    last change of signature."""
    w = Window.partitionBy("id").orderBy("version")
    marked = versions.withColumn("before", F.lag("sig").over(w))
    return marked.where(F.col("before").isNull() | (F.col("before") != F.col("sig"))).groupBy("id").agg(F.max("version").alias("changed_at"))


def since_of(text: str | int | None) -> int | None:
    """A client's version as it sends it; None for what is no whole number."""
    try:
        return int(text) if text is not None and str(text).strip() else None
    except ValueError:
        return None


def is_full(version: int, since: int | None, same_boot: bool = True) -> bool:
    """Whether a client gets everything: its version is missing, negative, ahead, or of another run."""
    return since is None or since < 0 or since > version or not same_boot


def delta(entries: DataFrame, version: int, since: int | None, same_boot: bool = True) -> DataFrame:
    """Entries (with changed_at) to send: those changed after `since`, or all (is_full)."""
    return entries if is_full(version, since, same_boot) else entries.where(F.col("changed_at") > since)


def head(items: DataFrame, version: int, order_version: int, since: int | None, same_boot: bool = True) -> DataFrame:
    """The board without its entries: version, whether all entries go along (full), whether the order does
    (it changed, or all do), and the statistics. One row."""
    full = is_full(version, since, same_boot)
    s = stats_with_median(items)
    return s.select(F.lit(version).alias("version"), F.lit(full).alias("full"), F.lit(full or order_version > since).alias("with_order"), F.struct(*[F.col(c) for c in s.columns]).alias("stats"))


def entry(status: Column, record: Column) -> Column:
    """What is shown of a record: nothing before its item is done."""
    return F.when((status == "done") & record.isNotNull(), record)


def cache_size(seed: DataFrame, live: DataFrame) -> DataFrame:
    return seed.select("key").union(live.select("key")).agg(F.countDistinct("key").alias("cache_size"))


def board_json(entries: DataFrame) -> DataFrame:
    """One JSON object a row."""
    return entries.select(F.to_json(F.struct(*entries.columns)).alias("value"))
