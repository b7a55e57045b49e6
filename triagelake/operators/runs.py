"""Run control as tables: the state of each message's item, and what requests, answers and stops make of it.

An item is (id, status, source, error, key, queue, generation): idle, queued, running, done or error; queue is its
place in line, generation the run it was started in. Every step takes the table of items and gives the next.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from ..functions import lazy as F

from .records import queue_order

ITEM = "id string, status string, source string, error string, key string, queue struct<batch:long,pos:long>, generation long"
NO_KEY = "config"


def blank(ids: DataFrame) -> DataFrame:
    """An idle item for each id."""
    empty = {n: F.lit(None).cast(t) for n, t in (("source", "string"), ("error", "string"), ("key", "string"), ("queue", "struct<batch:long,pos:long>"), ("generation", "long"))}
    return ids.select("id", F.lit("idle").alias("status"), *[c.alias(n) for n, c in empty.items()])


def split(asked: DataFrame, saved: DataFrame, have_model: bool = True) -> DataFrame:
    """asked (id, key, status, stale, use_cache) with `outcome`: skip (queued, or running and not stale),
    again (running, but its run was stopped), cached (its key is saved), failed (no model), queued."""
    hit = saved.select("key").where("key is not null").distinct().withColumn("__hit", F.lit(True))
    a = asked.join(hit, "key", "left")
    busy = F.col("status") == "running"
    outcome = (
        F.when((F.col("status") == "queued") | (busy & ~F.col("stale")), "skip")
        .when(busy, "again")
        .when(F.col("use_cache") & F.coalesce("__hit", F.lit(False)), "cached")
        .otherwise(F.lit("queued" if have_model else "failed"))
    )
    return a.select(*asked.columns, outcome.alias("outcome"))


def request(items: DataFrame, asked: DataFrame, saved: DataFrame, batch: int, generation: int, front: bool = False, use_cache: bool = True, have_model: bool = True) -> DataFrame:
    """Items after a request for asked (id, pos, key). Saved answers are taken at once; the rest is queued as
    one batch, at the end or (in the same inner order) at the front. A stopped run's item that is still
    running is queued again. Unknown ids, and a second request for the same id, change nothing."""
    new = asked.groupBy("id").agg(F.min("pos").alias("__pos"), F.min_by("key", "pos").alias("__key"))
    both = items.join(new, "id", "left")
    stale = F.coalesce(F.col("generation") != generation, F.lit(False))
    what = split(both.where("__pos is not null").select("id", F.col("__key").alias("key"), "status", stale.alias("stale"), F.lit(use_cache).alias("use_cache")), saved, have_model)
    done = both.join(what.select("id", "outcome"), "id", "left")
    place = queue_order(F.lit(front), F.lit(batch).cast("long"), F.col("__pos").cast("long"))
    is_ = lambda *names: F.col("outcome").isin(*names)
    waits, out = is_("queued", "again"), F.col
    return done.select(
        "id",
        F.when(is_("cached"), "done").when(waits, "queued").when(is_("failed"), "error").otherwise(out("status")).alias("status"),
        F.when(is_("cached"), "cache").when(is_("queued"), None).otherwise(out("source")).alias("source"),
        F.when(is_("cached", "queued"), None).when(is_("failed"), NO_KEY).otherwise(out("error")).alias("error"),
        F.when(is_("cached", "queued", "again"), out("__key")).otherwise(out("key")).alias("key"),
        F.when(waits, F.struct(place["col1"].alias("batch"), place["col2"].alias("pos"))).when(is_("cached"), None).otherwise(out("queue")).alias("queue"),
        out("generation"),
    )


def start(items: DataFrame, ids: DataFrame, generation: int) -> DataFrame:
    """Queued items among ids run, in this generation."""
    chosen = items.join(ids.select("id", F.lit(True).alias("__go")).distinct(), "id", "left")
    go = F.coalesce("__go", F.lit(False)) & (F.col("status") == "queued")
    return chosen.select(
        "id", F.when(go, "running").otherwise(F.col("status")).alias("status"), "source", "error", "key",
        F.when(go, None).otherwise(F.col("queue")).alias("queue"), F.when(go, F.lit(generation)).otherwise(F.col("generation")).cast("long").alias("generation"),
    )


def stop(items: DataFrame) -> DataFrame:
    """What is queued is idle again; what runs goes on, but its run is over (the caller's generation grows)."""
    queued = F.col("status") == "queued"
    return items.withColumns({"status": F.when(queued, "idle").otherwise(F.col("status")), "queue": F.when(queued, None).otherwise(F.col("queue"))})


def reset(items: DataFrame) -> DataFrame:
    """Everything that does not run is blank."""
    stays = F.col("status") == "running"
    return items.select("id", F.when(stays, F.col("status")).otherwise("idle").alias("status"), *[F.when(stays, F.col(c)).alias(c) for c in items.columns if c not in ("id", "status")])


def finish(items: DataFrame, answered: DataFrame, generation: int) -> tuple[DataFrame, DataFrame]:
    """(items, records to save) after answers (id, key, error kind, fields of a record). An answer that comes
    after its run was stopped is saved but not shown: its item is idle. A fatal error stops what is queued."""
    from .decider import FATAL

    got = answered.select("id", F.col("key").alias("__key"), F.col("error").alias("__error"))
    both = items.join(got, "id", "left")
    mine = F.col("__key").isNotNull() & (F.col("status") == "running")
    late = F.coalesce(F.col("generation") != generation, F.lit(True))
    shown = both.select(
        "id",
        F.when(mine & late, "idle").when(mine & F.col("__error").isNotNull(), "error").when(mine, "done").otherwise(F.col("status")).alias("status"),
        F.when(mine & ~late & F.col("__error").isNull(), "live").when(mine, None).otherwise(F.col("source")).alias("source"),
        F.when(mine & ~late, F.col("__error")).when(mine, None).otherwise(F.col("error")).alias("error"),
        F.when(mine & ~late, F.col("__key")).otherwise(F.col("key")).alias("key"),
        "queue",
        "generation",
    )
    fatal = answered.agg(F.coalesce(F.bool_or(F.col("error").isin(*FATAL)), F.lit(False)).alias("__fatal"))
    stopped = shown.crossJoin(F.broadcast(fatal))  # one row
    drop = F.col("__fatal") & (F.col("status") == "queued")
    out = stopped.withColumns({"status": F.when(drop, "idle").otherwise(F.col("status")), "queue": F.when(drop, None).otherwise(F.col("queue"))}).drop("__fatal")
    return out, answered.where("error is null").drop("error", "id")


def next_in_line(items: DataFrame, many: int) -> DataFrame:
    """The next items to run, in order: a limit because a worker takes that many at once."""
    return items.where("status = 'queued'").orderBy("queue", "id").limit(many)


def counters(items: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: model calls, items answered from the cache, and how many wait."""
    of = items.agg(F.count_if(F.col("source") == "cache").alias("cache_hits"), F.count_if(F.col("status") == "queued").alias("queue_length"))
    return of.crossJoin(F.broadcast(calls.agg(F.count("*").alias("calls"))))


def remembered(decisions: DataFrame, items: DataFrame, thresholds_version: int, day: str) -> tuple[DataFrame, DataFrame]:
    """(decisions that still hold, items to decide again): one holds while its key, save time, thresholds'
    version and day are what they were. decisions: id, key, saved_at, thresholds_version, day, ...; items: id, key, saved_at, ..."""
    now = items.select("id", "key", "saved_at")
    same = (F.col("thresholds_version") == thresholds_version) & (F.col("day") == day)
    held = decisions.where(same).join(now, ["id", "key", "saved_at"], "left_semi")
    return held, items.join(held.select("id"), "id", "left_anti")


def status_of(found: Column, kind: Column, error: Column, available: Column) -> Column:
    """What a reader of a file answers: 200, 404 (unknown, or only a name), 410 (an upload that is gone), 500
    (its specification cannot be drawn)."""
    return F.when(~found | (kind == "name_only"), 404).when((kind == "upload") & ~available, 410).when(error.isNotNull(), 500).otherwise(200)


__all__ = ["blank", "counters", "finish", "next_in_line", "remembered", "request", "reset", "split", "start", "status_of", "stop"]
