"""The driver's tables as messages, customers, specifications and answers."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import lazy as F

from ..functions import answers as an
from ..operators import policy
from ..schemas import ATTACHMENT_FIELDS, EMAIL_TYPE_LABELS, VOLUME_LABELS, Shop

TODAY = dt.date(2026, 9, 3)  # a Thursday, so due dates cross a weekend
SHOP = Shop()
TIERS = {"BUILDING": "A", "AUTOMOBILE": "A", "MACHINERY": "B", "HOUSEHOLD": "C"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table's files for each task of costly work.
TASK_BYTES = 2 << 20


def spread(df: DataFrame, task_bytes: int | None = None) -> DataFrame:
    """df over all cores, in more parts the larger its files are, so that no task grows with the table; one that
    comes in two splits a core stays as it is. For work that costs much more than moving its rows; the costlier, the smaller task_bytes."""
    task_bytes = task_bytes or TASK_BYTES
    cores = df.sparkSession.sparkContext.defaultParallelism
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    parts = 2 * cores if size >= 1 << 60 else max(2 * cores, min(1 << 13, -(-size // task_bytes)))
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(parts if size > task_bytes else cores)


def attachment(**fields: Column) -> Column:
    """A normalised attachment with these fields, the others null."""
    return F.struct(*[fields.get(n, F.lit(None)).cast(t).alias(n) for n, t in ATTACHMENT_FIELDS.items()])


def customers(spark: SparkSession) -> DataFrame:
    rows = [(i, f"{s}.example.com", s.title(), t, "Manager") for i, (s, t) in enumerate(TIERS.items())]
    return policy.first_of_domain(spark.createDataFrame(rows, "ord long, domain string, name string, tier string, account_manager string"))


def _shares(keys: list[str], w: Column) -> Column:
    """Weights (an array column) as options with probabilities."""
    total = sum((w[i] for i in range(1, len(keys))), w[0]).cast("double")
    return F.array(*[F.struct(F.lit(k).alias("key"), (w[i] / total).alias("p")) for i, k in enumerate(keys)])


def _choice(probs: Column) -> Column:
    raw = F.struct(F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("confidence"), probs.alias("probabilities"))
    return an.normal_choice(raw)


#: The answers that a message has here.
ANSWERED = ("email_type", "process", "export_controlled", "urgency", "quantity_given", "drawings_provided", "outside_processing", "volume")


def with_answers(df: DataFrame, k: Column, only: tuple[str, ...] = ANSWERED) -> DataFrame:
    """df with answers that follow from a key: every lane's branch and every tie rule is met. What is not asked
    for is not made: no plan can prune it once the answers are one struct."""
    bonus = lambda when, n: F.when(when, F.lit(n)).otherwise(F.lit(0))
    div = lambda n: F.floor(k / n)
    weights = lambda n, of: F.array(*[of(i) for i in range(n)])
    kind = weights(6, lambda i: 1 + (k * (2 * i + 7) + 13 * i) % 41 + bonus((k % 5 != 0) & (k % 6 == i), 400) + bonus((k % 5 == 0) & (div(5) % 3 == i // 2), 150))
    process = weights(4, lambda i: 1 + (k * (2 * i + 11) + 17 * i) % 37 + bonus((k % 7 != 0) & (div(6) % 4 == i), 250))
    volume = weights(4, lambda i: 1 + (k * (2 * i + 23) + 29 * i) % 31 + bonus((k % 9 != 0) & (div(24) % 4 == i), 250))
    urgency = weights(4, lambda i: 1 + (k * (2 * i + 13) + 7 * i) % 23 + bonus(div(3) % 4 == i, 200))
    p = lambda c: F.struct(c.alias("p"))
    # in steps, so that each array is made once
    made = {"email_type": ("__kind", kind, list(EMAIL_TYPE_LABELS)), "process": ("__process", process, list(SHOP.process_labels())), "volume": ("__volume", volume, list(VOLUME_LABELS)), "urgency": ("__urgency", urgency, ["0", "1", "2", "3"])}
    made = {name: m for name, m in made.items() if name in only}
    df = df.withColumns({c: w for c, w, _ in made.values()})
    df = df.withColumns({c: _shares(keys, F.col(c)) for c, _, keys in made.values()})
    df = df.withColumns({c: _choice(F.col(c)) for name, (c, _, _) in made.items() if name != "urgency"})
    u = F.col("__urgency")
    score = F.struct(an.expected_score(u).alias("score"), an.confidence(u).alias("confidence"), F.lit(True).alias("confidence_estimated"), u.alias("probabilities"), F.lit(None).cast("map<string,string>").alias("legend"))
    answers = {
        "email_type": F.col("__kind"),
        "process": F.col("__process"),
        "export_controlled": p((k * 37 % 101) / F.lit(200.0) + F.when(k % 11 == 0, F.lit(0.5)).otherwise(F.lit(0.0))),
        "urgency": score,
        "quantity_given": p((k * 53 % 101) / F.lit(100.0)),
        "drawings_provided": p((k * 59 % 101) / F.lit(100.0)),
        "outside_processing": p((k * 61 % 101) / F.lit(100.0)),
        "volume": F.col("__volume"),
    }
    whole = F.struct(*[c.alias(name) for name, c in answers.items() if name in only])
    # made once: a generator of one row keeps filters from being pushed into it
    return df.select("*", F.inline(F.array(F.struct(whole.alias("answers"))))).drop(*[c for c, _, _ in made.values()])


def inbox(spark: SparkSession, sf_dir: str, answers: tuple[str, ...] = ANSWERED) -> DataFrame:
    """One message an order (without a body: see inbox_with_body), with these answers; without any, there is no
    column of them."""
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    o = with_answers(spread(o), k, answers) if answers else o
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
    files = F.array_compact(
        F.array(
            F.when(k % 3 == 0, attachment(name=F.concat(F.lit("part"), k, F.lit(".step")), kind=F.lit("name_only"))),
            F.when(k % 3 == 1, attachment(name=F.lit("rfq_form.pdf"), kind=F.lit("name_only"))),
            F.when(k % 10 == 0, attachment(name=F.concat(F.lit("scan"), k, F.lit(".pdf")), kind=F.lit("upload"), media=F.lit("pdf"), text=F.lit("Notes. ITAR controlled."))),
        )
    )
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        k.alias("id"),
        F.when(k % 4 == 0, F.lit("Purchasing Team")).when(k % 4 == 1, F.concat(F.lit("Dr. Ana "), F.col("c_name"))).otherwise(F.col("c_name")).alias("from_name"),
        F.concat(F.lit("buyer"), F.col("o_custkey"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".example.com")).alias("from_email"),
        F.when(k % 8 == 0, F.lit(" (no subject) ")).otherwise(F.concat(F.lit("Order "), k, F.lit(" "), F.col("o_orderpriority"))).alias("subject"),
        files.alias("attachments"),
        *(["answers"] if answers else []),
        F.element_at(F.array(*map(F.lit, ("milling_3axis", "orders", "review"))), (k % 3 + 1).cast("int")).alias("expected_lane"),
    )


def decided(spark: SparkSession, sf_dir: str, bars: dict[str, float] | None = None) -> DataFrame:
    return policy.decide(policy.with_customer(inbox(spark, sf_dir), customers(spark)), SHOP, TODAY, bars)


def part_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One drawing a part: its shape by the last word of its name."""
    p = table(spark, sf_dir, "part")
    size = F.array(F.col("p_size").cast("double"), F.col("p_size") / 2.0, F.col("p_size") / 4.0)
    shape = F.substring_index("p_name", " ", -1)
    units = F.when(F.col("p_partkey") % 2 == 0, F.lit("mm")).otherwise(F.lit("in"))
    return p.select("p_partkey", "p_name", "p_brand", "p_type", shape.alias("shape"), size.alias("size"), units.alias("units"))


def po_specs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One purchase order an order, its lines in a total order."""
    lines = table(spark, sf_dir, "lineitem")
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    line = F.struct(
        *order,
        F.struct(
            F.col("l_partkey").cast("string").alias("part_number"), F.lit("").alias("rev"), F.lit("item").alias("description"),
            F.col("l_quantity").cast("bigint").cast("string").alias("qty"),
            F.concat(F.lit("$"), F.format_number(F.col("l_extendedprice") / F.col("l_quantity"), 2)).alias("unit_price"),
            F.date_format("l_shipdate", "yyyy-MM-dd").alias("due"),
        ).alias("line"),
    )
    grouped = lines.groupBy("l_orderkey").agg(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]).alias("po_lines"))
    return grouped.select(F.col("l_orderkey").alias("id"), attachment(name=F.lit("po.pdf"), kind=F.lit("po"), po_number=F.col("l_orderkey"), company=F.lit("Acme – Co"), buyer=F.lit("Ana"), date=F.lit("2026-09-01"), terms=F.lit("NET 30"), po_lines=F.col("po_lines")).alias("a"))
