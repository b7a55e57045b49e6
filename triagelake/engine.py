"""The engine: one object over a session and a shop; every result is a DataFrame."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import DataFrame, SparkSession

from .functions import lazy as F

from .functions import text
from .operators import attachments, board, decider, layout, policy, records, uploads
from .operators import messages as intake
from .schemas import ANSWERS, EMAIL_TYPE_LABELS, VOLUME_LABELS, Shop


class Engine:
    def __init__(self, spark: SparkSession, shop: Shop | None = None, endpoint: str = "rules", model: str = "keywords", question_set: str = "v1"):
        self.spark, self.shop = spark, shop or Shop()
        self.endpoint, self.model, self.question_set = endpoint, model, question_set

    def state(self, emails: DataFrame) -> DataFrame:
        """emails with `state` and its content key."""
        cols = [F.col(c) for c in ("from_name", "from_email", "subject", "body", "attachments")]
        out = emails.withColumn("state", attachments.state(*cols))
        return out.withColumn("key", records.content_key(F.col("state"), self.endpoint, self.model, self.question_set))

    def answers(self, stated: DataFrame, saved: DataFrame | None = None) -> DataFrame:
        """stated with `answers`: saved ones by key, the keyword rules for the rest."""
        rules = decider.keyword_answers(F.col("state"), self.shop).cast(ANSWERS)
        if saved is None:
            return stated.withColumns({"answers": rules, "source": F.lit("rules")})
        known = stated.join(saved.select("key", F.col("answers").alias("__saved")), "key", "left")
        return known.withColumns({"answers": F.coalesce("__saved", rules), "source": F.when(F.col("__saved").isNull(), "rules").otherwise("saved")}).drop("__saved")

    def decide(self, answered: DataFrame, today: dt.date, thresholds: dict[str, float] | None = None, customers: DataFrame | None = None) -> DataFrame:
        customers = policy.customers_frame(self.spark, self.shop) if customers is None else customers
        return policy.decide(policy.with_customer(answered, customers), self.shop, today, thresholds)

    def route(self, emails: DataFrame, today: dt.date, saved: DataFrame | None = None) -> DataFrame:
        """From messages to decisions in one plan."""
        return self.decide(self.answers(self.state(emails), saved), today)

    def board(self, items: DataFrame) -> DataFrame:
        return board.stats_with_median(items)

    def changes(self, previous: DataFrame, current: DataFrame) -> DataFrame:
        return board.changes(previous, current)

    def merge_answers(self, seed: DataFrame, live: DataFrame) -> DataFrame:
        return records.merged(seed, live)

    def lanes(self) -> DataFrame:
        """The lane dimension: id, name, owner, role, group, in display order."""
        rows = [(i, x.id, x.name, x.owner, x.role, g) for i, (x, g) in enumerate(self.shop.lanes())]
        return self.spark.createDataFrame(rows, "ord int, id string, name string, owner string, role string, group string")

    def asked(self) -> list[dict]:
        """The eight questions, in order: name, type, what is asked, and the options (key, text). The lanes of
        the shop make the options of `process`."""
        yes_no = [("true", "Yes"), ("false", "No")]
        process = [(x.id, x.description or x.name) for x in self.shop.estimating] + [(policy.MIXED, "Another process, several of them, or too little detail to tell")]
        urgency = [("0", "No deadline"), ("1", "A week or more"), ("2", "A few days"), ("3", "Emergency")]
        rows = [
            ("email_type", "choice", "What kind of email is this?", list(EMAIL_TYPE_LABELS.items())),
            ("process", "choice", "Which process makes most of the parts?", process),
            ("export_controlled", "noul", "Does the email or a file hold export-controlled technical data?", yes_no),
            ("urgency", "score", "How soon does the sender need an answer or parts?", urgency),
            ("quantity_given", "noul", "Does the email or a file state a quantity?", yes_no),
            ("drawings_provided", "noul", "Are drawings or models of the parts attached?", yes_no),
            ("outside_processing", "noul", "Do the parts need a finish or another process outside the shop?", yes_no),
            ("volume", "choice", "How many parts are asked for?", list(VOLUME_LABELS.items())),
        ]
        return [{"name": n, "type": t, "instructions": i, "options": [{"key": k, "text": x} for k, x in o]} for n, t, i, o in rows]

    def questions(self) -> DataFrame:
        rows = [(q["name"], q["type"], q["instructions"], [(o["key"], o["text"]) for o in q["options"]]) for q in self.asked()]
        return self.spark.createDataFrame(rows, "name string, type string, instructions string, options array<struct<key:string,text:string>>")

    def bootstrap(self, messages: DataFrame, store: DataFrame | None = None) -> DataFrame:
        """Everything a client starts from, as (part, ord, value): JSON of each lane, customer, question,
        threshold, limit of uploads, and message (ord; attachments described, not raw)."""
        spark, shop = self.spark, self.shop
        limits = {"max_files": uploads.MOST_UPLOADS, "max_bytes": uploads.MOST_BYTES, "types": uploads.accepted_types()}
        small = [("lane", i, {"id": x.id, "name": x.name, "owner": x.owner, "role": x.role, "group": g}) for i, (x, g) in enumerate(shop.lanes())]
        small += [("customer", i, dict(zip(("domain", "name", "tier", "account_manager"), c))) for i, c in enumerate(shop.customers)]
        small += [("question", i, q) for i, q in enumerate(self.asked())] + [("threshold", i, {"name": k, "value": v}) for i, (k, v) in enumerate(shop.bars().items())] + [("uploads", 0, limits)]
        fixed = spark.createDataFrame([(p, i, json.dumps(v, ensure_ascii=False, separators=(",", ":"))) for p, i, v in small], "part string, ord long, value string")
        shown = intake.public(messages, store)
        return fixed.unionByName(shown.select(F.lit("message").alias("part"), F.col("ord").cast("long").alias("ord"), F.to_json(F.struct(*[c for c in shown.columns if c != "ord"])).alias("value")))

    def check(self, messages: DataFrame) -> DataFrame:
        """The first message through the whole question set: each probability with its bar, one row an option."""
        first = self.answers(self.state(messages.orderBy("ord", "id").limit(1)))
        options = [(q["name"], [o["key"] for o in q["options"]]) for q in self.asked()]
        a = F.col("answers")
        rows = []
        for i, (name, keys) in enumerate(options):
            kind = "noul" if "true" in keys else "probabilities"
            probs = F.array(F.struct(F.lit("true").alias("key"), a[name]["p"].alias("p"))) if kind == "noul" else a[name]["probabilities"]
            rows.append(F.transform(probs, lambda e, k, i=i, name=name: F.struct(F.lit(i).alias("ord"), F.lit(name).alias("question"), k.alias("pos"), e["key"].alias("key"), e["p"].alias("p"))))
        out = first.select(F.explode(F.concat(*rows)).alias("r")).select("r.*")
        return out.withColumn("bar", text.bar(F.col("p")))

    def remembered_files(self, attachments: DataFrame, id_cols: list[str]) -> DataFrame:
        """attachments (id_cols, a) with the derived file of each (content, media, thumb, pages, error): a
        specification that occurs many times is drawn once. Specifications are told apart by digest. Equal ones
        go in a hash table where they are read; only what is left is sorted for the first of each digest. The
        join is a merge: both sides may be large, and Spark takes the attachments for small by their file."""
        key = F.sha2(F.to_json(F.col("a")), 256)
        specs = attachments.select(key.alias("spec"), "a").distinct().dropDuplicates(["spec"])
        made = specs.select("spec", layout.derived(F.col("a")).alias("file"))
        return attachments.withColumn("spec", key).hint("merge").join(made, "spec").select(*id_cols, "a", "file.*")
