"""Sharding by Karmarkar-Karp differencing, for groups that must stay together.

Every item begins as a partial partition with itself in one of k parts. The two partial partitions
of the largest spread are combined again and again, the larger parts of one with the smaller parts
of the other, until one is left. At scale this runs in levels: buckets of items are differenced into
bundles in tasks, bundles are items of the next level, and the driver gets a bounded number of them.
Groups too heavy for bundling go to the last level as they are, and one bucket of light groups is
held back: it is differenced last, against the result of all others, so that single groups even out
what bundles have left uneven.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, text_or_empty

#: Items that one task differences at once, bundles that come out of it, and items the driver takes at most.
BUCKET_ITEMS, BUNDLES, DRIVER_ITEMS = 20_000, 64, 20_000
#: A group of this share of all bytes (by shard count) is heavy; there are at most HEAVY_PARTS * shards.
HEAVY_PARTS = 64
#: Rows that one task numbers at once.
SLOT_ROWS = 50_000


def difference(weights: list[int], parts: int, start: list[int] | None = None) -> list[int]:
    """The part of each item. start: loads that the parts (in this order) have already."""
    if not weights:
        return []
    n = len(weights)
    left: list[int] = [-1] * n
    right: list[int] = [-1] * n
    heap: list[tuple[int, int, list[int], list[int]]] = []

    def spread(sums: list[int]) -> int:
        return sums[-1] - sums[0]

    for i, w in enumerate(weights):
        heap.append((-w, i, [0] * (parts - 1) + [w], [-1] * (parts - 1) + [i]))
    if start:
        # the loads are a partial partition whose sets are n, n + 1, ... in ascending order of load
        order = sorted(range(parts), key=lambda j: (start[j], j))
        base = len(left)
        left += [-1] * parts
        right += [-1] * parts
        sums = [start[j] for j in order]
        heap.append((-spread(sums), n, sums, list(range(base, base + parts))))
    heapq.heapify(heap)
    serial = n + 1
    while len(heap) > 1:
        _, _, sa, na = heapq.heappop(heap)
        _, _, sb, nb = heapq.heappop(heap)
        joined = []
        for x, y, i, j in zip(sa, reversed(sb), na, reversed(nb)):
            if i < 0 or j < 0:
                joined.append((x + y, max(i, j)))
            else:
                left.append(i)
                right.append(j)
                joined.append((x + y, len(left) - 1))
        joined.sort()
        sums, nodes = [x for x, _ in joined], [i for _, i in joined]
        low = sums[0]
        if low and not start:
            sums = [x - low for x in sums]
        heapq.heappush(heap, (-spread(sums), serial, sums, nodes))
        serial += 1
    out = [0] * n
    for part, node in enumerate(heap[0][3]):
        stack, leaves, named = [node] if node >= 0 else [], [], part
        while stack:
            v = stack.pop()
            if left[v] >= 0:
                stack += (left[v], right[v])
            elif v >= n:
                named = order[v - n]
            else:
                leaves.append(v)
        for v in leaves:
            out[v] = named
    return out


def _bundled(items: DataFrame, n: int, level: int) -> tuple[DataFrame, DataFrame]:
    """items (key, w) in buckets, each differenced into bundles: (key, bundle) and (key, w) of the bundles."""
    buckets = -(-n // BUCKET_ITEMS)

    def pack(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["w", "key"], ascending=[False, True], kind="stable")  # the same order in every attempt
        part = difference(frame["w"].tolist(), BUNDLES)
        b = frame["bucket"].iloc[0]
        return pd.DataFrame({"key": frame["key"], "bundle": [f"{level}-{b}-{p}" for p in part], "w": frame["w"]})

    of = items.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    key_type = items.schema["key"].dataType.simpleString()
    packed = cut(of.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(pack, f"key {key_type}, bundle string, w long"))
    return packed.select("key", "bundle"), packed.groupBy(F.col("bundle").alias("key")).agg(F.sum("w").alias("w"))


def group_shards(groups: DataFrame, shards: int) -> DataFrame:
    """groups (key string, w long, one row a key) with the shard of each: key, shard.

    Deterministic for a given set of groups. An empty table gives an empty one."""
    spark = groups.sparkSession
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("w"), F.lit(0))).first()
    if not n:
        return groups.select("key", F.lit(0).alias("shard"))
    buckets = -(-n // BUCKET_ITEMS)
    heavy_from = max(1, total // (shards * HEAVY_PARTS)) if buckets > 1 else total + 1
    light = groups.where(F.col("w") < heavy_from)
    fine = F.pmod(F.xxhash64("key", F.lit(7)), F.lit(buckets)) == 0
    heavy = sorted(((r.w, r.key) for r in groups.where(F.col("w") >= heavy_from).collect()), key=lambda x: (-x[0], x[1]))
    maps, items = [], None
    if buckets > 1:
        items, count, level = light.where(~fine), n, 0
        while count > DRIVER_ITEMS or level == 0:
            keys, items = _bundled(items, count, level)
            maps.append(keys)
            count, level = items.count(), level + 1
        tops = sorted(((r.w, r.key) for r in items.collect()), key=lambda x: (-x[0], x[1]))
    else:
        tops = []
    last = sorted(heavy + tops, key=lambda x: (-x[0], x[1]))
    part = difference([w for w, _ in last], shards)
    loads = [0] * shards
    for (w, _), p in zip(last, part):
        loads[p] += w

    def settle(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["w", "key"], ascending=[False, True], kind="stable")
        return pd.DataFrame({"key": frame["key"], "shard": difference(frame["w"].tolist(), shards, loads)})

    # a bucket of about BUCKET_ITEMS groups: one task by design
    done = [light.where(fine).withColumn("one", F.lit(0)).groupBy("one").applyInPandas(settle, "key string, shard int")]
    named = {k: p for (_, k), p in zip(last, part)}
    if heavy:
        done.append(spark.createDataFrame([(k, named[k]) for _, k in heavy], "key string, shard int"))
    if tops:
        at = spark.createDataFrame([(k, named[k]) for _, k in tops], "bundle string, shard int")
        for keys in reversed(maps):
            at = keys.join(at, "bundle").select(F.col("key").alias("bundle"), "shard")
        done.append(at.withColumnRenamed("bundle", "key"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def balanced_shards(docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, size, text_crc32, law (`bytes`), shard, slot, grown_shard (null).

    Equal texts share a shard (null counts as empty, of size 1); shards are near equal in bytes as far as
    such groups allow. Slots count from 0 without a gap. Rows with equal or null identifiers are all
    kept. One group may hold any share of the rows: groups are summed before they are shuffled, and
    the join that brings a group's shard to its rows is split where it is skewed."""
    text = text_or_empty(text_col)
    base = cut(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1 if size is None else size).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.sha2(text, 256).alias("key"),
            F.monotonically_increasing_id().alias("row"),
        )
    )
    groups = cut(base.groupBy("key").agg(F.sum("size").alias("w")))
    placed = cut(base.join(group_shards(groups, shards), "key").drop("key"))
    chunks = max(1, -(-base.count() // SLOT_ROWS))
    chunked = placed.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    before = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    counts = chunked.groupBy("shard", "chunk").agg(F.count("*").alias("n")).select("shard", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    inside = Window.partitionBy("shard", "chunk").orderBy("row")
    return (
        chunked.withColumn("inside", F.row_number().over(inside) - 1)
        .join(counts, ["shard", "chunk"])
        .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("begin") + F.col("inside")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


__all__ = ["balanced_shards", "difference", "group_shards"]
