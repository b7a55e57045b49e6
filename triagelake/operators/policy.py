"""The routing policy: pure column expressions over a message, its answers and its customer.

Every step adds columns; nothing is shuffled. The only join is with the customer dimension.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession

from ..functions import lazy as F

from ..functions import answers as an, dates, text as tx
from ..functions.text import pct
from ..schemas import EMAIL_TYPE_LABELS, VOLUME_LABELS, Shop
from . import attachments as att

RFQ, ORDER, OUTSIDE = ("new_rfq", "quote_revision"), ("purchase_order", "order_followup"), ("vendor_or_solicitation", "other")
MIXED = "mixed_or_unclear"
STEP = "array<struct<label:string,detail:string,outcome:string>>"
FLAG = "array<struct<id:string,label:string,tone:string>>"


def _say(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])


def _pct(x: float) -> str:
    return f"{round(x * 100)}%"


def customers_frame(spark: SparkSession, shop: Shop) -> DataFrame:
    """domain, name, tier, account_manager; the first row of a domain counts."""
    rows = [(i, *r) for i, r in enumerate(shop.customers)]
    return first_of_domain(spark.createDataFrame(rows, "ord long, domain string, name string, tier string, account_manager string"))


def first_of_domain(customers: DataFrame) -> DataFrame:
    """One row for each lower-case domain: that of the least ord."""
    first = customers.groupBy(F.lower("domain").alias("domain")).agg(F.min_by(F.struct("name", "tier", "account_manager"), "ord").alias("r"))
    return first.select("domain", "r.name", "r.tier", "r.account_manager")


def with_customer(emails: DataFrame, customers: DataFrame, email_col: str = "from_email") -> DataFrame:
    """emails with `customer`, a struct or null: an exact match of the sender's domain. customers has one
    row a domain (first_of_domain); Spark broadcasts it if its size is known to be small."""
    c = customers.select(F.col("domain").alias("__domain"), F.struct("domain", "name", "tier", "account_manager").alias("customer"))
    return emails.join(c, tx.domain(F.col(email_col)) == F.col("__domain"), "left").drop("__domain")


def unmatched(emails: DataFrame, customers: DataFrame, email_col: str = "from_email") -> DataFrame:
    return emails.join(customers.select(F.col("domain").alias("__domain")), tx.domain(F.col(email_col)) == F.col("__domain"), "left_anti")


def decide(emails: DataFrame, shop: Shop, today: dt.date, bars: dict[str, float] | None = None) -> DataFrame:
    """emails (from_name, from_email, subject, attachments, answers, customer, expected_lane) with the
    decision's columns. A missing confidence counts as zero; ties among options keep their order. Fixed
    values: the wording of reasons, meters, flags, missing parts and priorities."""
    th = shop.bars(bars)
    b = {k: F.lit(v) for k, v in th.items()}
    labels, model = shop.process_labels(), shop.model_name
    a = F.col("answers")
    et, pr, ex, ur, vol = (a[n] for n in ("email_type", "process", "export_controlled", "urgency", "volume"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))

    # ranked once; everything about the likeliest options is read from these
    df = emails.withColumns({"et_ranked": an.ranked(et["probabilities"]), "pr_ranked": an.ranked(pr["probabilities"])})
    df = df.withColumns(
        {
            "cad_attachments": att.cad_names(F.col("attachments")),
            "marked": att.marked_names(F.col("attachments")),
            "et_conf": zero(et["confidence"]),
            "pr_conf": zero(pr["confidence"]),
            "vol_conf": zero(vol["confidence"]),
            "pair": an.pair_of(F.col("et_ranked")),
            "et_label": tx.label_of(et["choice"], EMAIL_TYPE_LABELS),
            "pr_label": tx.label_of(pr["choice"], labels),
            "is_rfq": F.coalesce(et["choice"].isin(*RFQ), F.lit(False)),
            "today": F.lit(today),
        }
    )
    col = F.col
    df = df.withColumn("route_conf", F.greatest(col("et_conf"), col("pair.confidence")))
    exempt = (col("et_conf") >= max(th["itar_exempt_confidence"], th["email_type_confidence"])) & et["choice"].isin(*OUTSIDE)
    df = df.withColumns({"restricted": (ex["p"] >= b["export_control_restrict"]) & ~exempt, "sure": col("route_conf") >= b["email_type_confidence"]})

    restricted, sure = col("restricted"), col("sure")
    process_ok = (pr["choice"] != MIXED) & (col("pr_conf") >= b["process_confidence"])
    lane = (
        F.when(restricted, F.lit("itar"))
        .when(~sure, F.lit("review"))
        .when(et["choice"].isin(*OUTSIDE), F.lit("filtered"))
        .when(et["choice"].isin(*ORDER), F.lit("orders"))
        .when(~process_ok, F.lit("review"))
        .otherwise(pr["choice"])
    )
    # the branch that asked for the estimator
    asked = ~restricted & sure & ~et["choice"].isin(*OUTSIDE, *ORDER)
    reason = (
        F.when(restricted, F.lit("Export-controlled technical data. Only U.S. persons may handle it, so it skips the shared queues."))
        .when(~sure, _say(f"{model} is unsure what kind of email this is: ", an.top_two_of(F.col("et_ranked"), EMAIL_TYPE_LABELS), "."))
        .when(et["choice"].isin(*OUTSIDE), _say(col("et_label"), ", not customer work."))
        .when(et["choice"].isin(*ORDER), _say(col("et_label"), " for an existing job."))
        .when(pr["choice"] == MIXED, F.lit("Mixed processes or not enough detail to pick an estimator."))
        .when(col("pr_conf") < b["process_confidence"], _say(f"{model} is torn between estimators: ", an.top_two_of(F.col("pr_ranked"), labels), "."))
        .otherwise(_say(col("pr_label"), " work, ", pct(pr["p"]), " probability."))
    )
    meter = F.struct(
        F.when(restricted, F.lit("ITAR / CUI likelihood")).otherwise(F.lit("Confidence")).alias("label"),
        F.when(restricted, ex["p"]).when(col("asked"), F.least(col("route_conf"), col("pr_conf"))).otherwise(col("route_conf")).alias("value"),
        F.when(restricted, b["export_control_restrict"]).when(col("asked") & (col("pr_conf") <= col("route_conf")), b["process_confidence"]).otherwise(b["email_type_confidence"]).alias("threshold"),
    )
    # A generator of one row: filters on the lane stay above it. Through a projection they would be pushed
    # down with all that the lane is made from written out, once for each time it is used.
    df = df.select("*", F.inline(F.array(F.struct(lane.alias("lane"), asked.alias("asked"), process_ok.alias("process_ok")))))
    df = df.withColumns({"reason": reason, "meter": meter})

    drawings, quantity = a["drawings_provided"]["p"], a["quantity_given"]["p"]
    no_drawings = col("is_rfq") & (F.size("cad_attachments") == 0) & (drawings < b["drawings_provided"])
    no_quantity = col("is_rfq") & (quantity < b["quantity_given"])
    rush, soon = ur["score"] >= b["rush_score"], ur["score"] >= b["soon_score"]
    flag = lambda when, id_, label, tone: F.when(when, F.struct(F.lit(id_).alias("id"), (F.lit(label) if isinstance(label, str) else label).alias("label"), F.lit(tone).alias("tone")))
    volume_known = col("is_rfq") & (col("vol_conf") >= b["volume_confidence"]) & (vol["choice"] != "not_stated")
    flags = F.array_compact(
        F.array(
            flag(rush & (col("lane") != "filtered"), "rush", "Rush", "serious"),
            flag(col("lane") == "itar", "itar", "ITAR / CUI", "restricted"),
            flag((col("lane") != "itar") & (ex["p"] >= b["export_control_warn"]), "itar_check", "Check export control", "warning"),
            flag(no_drawings, "missing_drawings", "Missing drawings", "warning"),
            flag(no_quantity, "missing_qty", "Missing quantity", "warning"),
            flag(col("is_rfq") & (a["outside_processing"]["p"] >= b["outside_processing"]), "outside_processing", "Outside processing", "neutral"),
            flag(volume_known, "volume", tx.label_of(vol["choice"], VOLUME_LABELS), "neutral"),
        )
    )
    missing = F.array_compact(F.array(F.when(no_drawings, F.lit("drawings (PDF plus STEP if you have it)")), F.when(no_quantity, F.lit("the quantities you want quoted"))))
    tier_a = F.coalesce(col("customer.tier") == "A", F.lit(False))
    production = F.coalesce((vol["choice"] == "production") & (col("vol_conf") >= b["volume_confidence"]), F.lit(False))
    waiting = (col("lane") == "orders") | ((col("lane") == "itar") & et["choice"].isin(*ORDER))
    why = F.array_join(F.array_compact(F.array(F.when(soon, F.lit("short turnaround")), F.when(tier_a, F.lit("A-tier customer")), F.when(production, F.lit("production volume")))), ", ")
    cases = [
        (col("lane") == "filtered", None, F.lit("")),
        (rush, "P1", F.lit("rush language")),
        (col("is_rfq") & tier_a & production, "P1", F.lit("A-tier customer and production volume")),
        (waiting, "P2", F.lit("customer is waiting on an existing order")),
        (soon | tier_a | production, "P2", why),
        (F.lit(True), "P3", F.lit("standard request")),
    ]
    priority = because = None
    for when, p, text in cases:
        p = F.lit(p).cast("string")
        priority = F.when(when, p) if priority is None else priority.when(when, p)
        because = F.when(when, text) if because is None else because.when(when, text)
    df = df.withColumns({"flags": flags, "missing": missing, "priority": priority, "priority_reason": because})

    reply_only = (col("lane") == "orders") | ((col("lane") == "itar") & ~col("is_rfq"))
    sla = F.lit(5)
    for p, n in shop.sla_days.items():
        sla = F.when(col("priority") == p, F.lit(int(n))).otherwise(sla)
    days = F.when(reply_only, F.lit(0)).otherwise(sla)
    day = F.when(days > 0, dates.add_business_days(col("today"), days)).otherwise(col("today"))
    due = F.when(
        col("priority").isNotNull(),
        F.struct(day.cast("string").alias("date"), dates.friendly_date(day, col("today")).alias("label"), F.when(reply_only, F.lit("reply")).otherwise(F.lit("quote")).alias("kind")),
    )
    df = df.withColumn("due", due)

    owners = {x.id: x for x, _ in shop.lanes()}
    df = df.withColumns({"lane_name": tx.label_of(col("lane"), {k: x.name for k, x in owners.items()}), "owner": tx.label_of(col("lane"), {k: x.owner for k, x in owners.items()})})
    df = df.withColumns({"trace": _trace(shop, th), "action": _action(shop)})
    return df.select(
        *emails.columns,
        "lane",
        "lane_name",
        "owner",
        (col("lane") != "review").alias("auto_routed"),
        "reason",
        "meter",
        "is_rfq",
        "flags",
        "missing",
        "priority",
        "priority_reason",
        "due",
        "cad_attachments",
        F.col("marked").alias("export_marked"),
        F.struct(pr["choice"].alias("choice"), col("pr_label").alias("label"), pr["p"].alias("p")).alias("process_guess"),
        "trace",
        "action",
        F.when(F.coalesce(col("expected_lane"), F.lit("")) != "", col("expected_lane") == col("lane")).alias("matches_expected"),
    )


def _trace(shop: Shop, th: dict[str, float]) -> Column:
    """The steps that led to the lane, in order; which ones there are depends on the branch. the
    steps' wording."""
    a, col, model = F.col("answers"), F.col, shop.model_name
    et, pr, ex = a["email_type"], a["process"], a["export_controlled"]
    step = lambda label, detail, outcome: F.struct(F.lit(label).alias("label"), detail.alias("detail"), (F.lit(outcome) if isinstance(outcome, str) else outcome).alias("outcome"))
    good = lambda c, bad="stop": F.when(c, F.lit("pass")).otherwise(F.lit(bad))
    where = F.when((F.size("marked") > 0) & (ex["p"] >= th["export_control_warn"]), _say(" Export-control wording found in ", F.array_join("marked", ", "), ".")).otherwise(F.lit(""))
    bar, restrict, process_bar = _pct(th["email_type_confidence"]), _pct(th["export_control_restrict"]), _pct(th["process_confidence"])
    together = F.when(
        col("pair.confidence") > col("et_conf"),
        _say(
            " ", tx.label_of(col("pair.a"), EMAIL_TYPE_LABELS), " and ", tx.label_of(col("pair.b"), EMAIL_TYPE_LABELS),
            " go to the same place: together ", pct(col("pair.p")), ", confidence ", pct(col("pair.confidence")), ".",
        ),
    ).otherwise(F.lit(""))
    kind = F.when(col("restricted"), _say(f"{model}: ", col("et_label"), " (", pct(et["p"]), "). Restricted handling applies either way.")).otherwise(
        _say(f"{model}: ", col("et_label"), " (", pct(et["p"]), "), confidence ", pct(col("et_conf")), ".", together, f" Auto-route bar is {bar}.")
    )
    files = F.when(F.size("cad_attachments") > 0, F.array_join("cad_attachments", ", ")).otherwise(F.lit("none"))
    due = F.concat(F.initcap(col("due.kind")), F.lit(" due "), col("due.label"), F.lit("."))
    return F.array_compact(
        F.array(
            step("Export-controlled?", _say(f"{model}: ", pct(ex["p"]), f" likely ITAR / CUI. Restricted queue at {restrict} or above.", where), F.when(col("restricted"), F.lit("stop")).otherwise(F.lit("pass"))),
            step("What kind of email?", kind, F.when(col("restricted"), F.lit("info")).otherwise(good(col("sure")))),
            F.when(col("asked"), step("Which estimator?", _say(f"{model}: ", col("pr_label"), " (", pct(pr["p"]), "), confidence ", pct(col("pr_conf")), f". Auto-route bar is {process_bar}."), good(col("process_ok")))),
            F.when(
                col("is_rfq"),
                step(
                    "Anything missing?",
                    _say("CAD / drawing files attached: ", files, f". {model}: drawings provided ", pct(a["drawings_provided"]["p"]), ", quantity stated ", pct(a["quantity_given"]["p"]), "."),
                    F.when(F.size("missing") > 0, F.lit("warn")).otherwise(F.lit("pass")),
                ),
            ),
            F.when(col("priority").isNotNull(), step("Priority", _say(col("priority"), ": ", col("priority_reason"), ". ", due), "info")),
            step("Route", _say(col("lane_name"), " (", col("owner"), "). ", col("reason")), F.when(col("lane") == "review", F.lit("review")).otherwise(F.lit("done"))),
        )
    )


def _action(shop: Shop) -> Column:
    """Next step and draft reply by template. The templates' wording."""
    a, col = F.col("answers"), F.col
    et, pr, lane = a["email_type"], a["process"], F.col("lane")
    hi = _say("Hi ", tx.first_name(col("from_name")), ",\n\n")
    subject = tx.strip(tx.blank(col("subject")))
    received = F.when((subject != "") & (subject != "(no subject)"), _say('your email "', subject, '"')).otherwise(F.lit("your email"))
    owner_first = F.substring_index(col("owner"), " ", 1)
    sign, service_sign = f"\n\nBest,\n{shop.name} Quoting Team", f"\n\nBest,\n{shop.name} Customer Service Team"
    is_rfq, is_order = et["choice"].isin(*RFQ), et["choice"].isin(*ORDER)
    promise = F.when(col("due").isNotNull(), _say(" You'll have our quote by ", col("due.label"), ".")).otherwise(F.lit(""))

    order_title = F.when(et["choice"] == "purchase_order", _say("Enter the PO in the ERP and send an order acknowledgment (", col("owner"), ")")).otherwise(_say("Look up the order in the ERP and reply (", col("owner"), ")"))
    order_body = F.when(
        et["choice"] == "purchase_order",
        _say(hi, "Thanks for the order. We received ", received, " and ", owner_first, " is entering it now. We'll confirm the ship date by end of day.", service_sign),
    ).otherwise(_say(hi, "Thanks for checking in. ", owner_first, " is pulling up the order details now and will get back to you by end of day with an update.", service_sign))
    itar_title = F.when(is_rfq | is_order, _say("Move to the restricted ITAR folder and notify ", col("owner"), ". Do not forward attachments outside the controlled environment.")).otherwise(
        _say(col("owner"), " reviews this in the restricted ITAR folder before anyone replies. Do not forward it outside the controlled environment.")
    )
    itar_body = F.when(is_rfq, _say(hi, "Thanks for the RFQ. We received ", received, " and it is being handled by our export-controlled quoting team (U.S. persons only).", promise, sign)).when(
        is_order, _say(hi, "Thanks for your note. We received ", received, " and our export-controlled team (U.S. persons only) will get back to you by end of day.", service_sign)
    )
    guess = F.when(is_rfq, an.top_two_of(F.col("pr_ranked"), shop.process_labels())).otherwise(an.top_two_of(F.col("et_ranked"), EMAIL_TYPE_LABELS))
    review_title = _say(col("owner"), f" ({shop.review.role}) confirms where this goes. {shop.model_name}'s best guesses: ", guess, ".")
    lacking = F.size("missing") > 0
    ask = F.when(lacking, _say(" To give you an accurate price, could you send ", F.array_join("missing", " and "), "?")).otherwise(promise)
    quote_title = F.when(lacking, _say("Assign to ", col("owner"), " and request the missing information")).otherwise(_say("Assign to ", col("owner"), " and send the acknowledgment"))
    quote_body = _say(hi, "Thanks for the RFQ. We received ", received, " and ", owner_first, " on our ", col("lane_name"), " team is reviewing it now.", ask, sign)
    title = F.when(lane == "filtered", F.lit("Archive. No reply needed.")).when(lane == "orders", order_title).when(lane == "itar", itar_title).when(lane == "review", review_title).otherwise(quote_title)
    draft = F.when(lane.isin("filtered", "review"), F.lit(None).cast("string")).when(lane == "orders", order_body).when(lane == "itar", itar_body).otherwise(quote_body)
    return F.struct(title.alias("title"), F.when(draft.isNotNull(), col("from_email")).alias("to"), draft.alias("draft"))


__all__ = ["customers_frame", "decide", "first_of_domain", "unmatched", "with_customer"]
