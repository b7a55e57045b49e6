"""One query for each operator, over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions import lazy as F

from ..functions import answers as an
from ..functions import binary, dates, geometry
from ..functions import text as tx
from ..operators import attachments as att
from ..operators import board, decider, layout, policy, records, render, uploads
from ..schemas import DOC_TYPE_LABELS, EMAIL_TYPE_LABELS
from . import bridge, more_queries
from .bridge import SHOP, attachment, decided, inbox, part_specs, po_specs, spread, table

def lane_decision(spark, sf):
    d = decided(spark, sf)
    return d.select("id", "lane", "is_rfq", "auto_routed", F.col("meter.label").alias("meter"), F.round("meter.value", 6).alias("value"), F.round("meter.threshold", 6).alias("threshold"))


def lane_counts(spark, sf):
    return board.lane_counts(decided(spark, sf))


def review_reasons(spark, sf):
    return decided(spark, sf).where("lane = 'review'").select("id", "reason")


def all_reasons(spark, sf):
    return decided(spark, sf).select("id", "lane_name", "owner", "reason")


def flag_list(spark, sf):
    flags = F.transform("flags", lambda f: F.when(f["id"] == "volume", F.concat(f["id"], F.lit(":"), f["label"])).otherwise(f["id"]))
    return decided(spark, sf).select("id", F.array_join(flags, ",").alias("flags"), F.array_join("missing", "|").alias("missing"))


def priority_due(spark, sf):
    return decided(spark, sf).select("id", "priority", "priority_reason", F.col("due.date").alias("due_date"), F.col("due.kind").alias("due_kind"))


def friendly_due(spark, sf):
    return decided(spark, sf).select("id", F.col("due.label").alias("due_label"))


def reply_action(spark, sf):
    return decided(spark, sf).select("id", "action.title", F.col("action.to").alias("send_to"), "action.draft")


def trace_steps(spark, sf):
    return decided(spark, sf).select("id", F.posexplode("trace").alias("pos", "s")).select("id", "pos", "s.*")


def process_guess(spark, sf):
    return decided(spark, sf).select("id", "process_guess.choice", "process_guess.label", F.round("process_guess.p", 6).alias("p"))


def threshold_change(spark, sf):
    """What another bar does: lanes before and after."""
    before = decided(spark, sf).select("id", F.col("lane").alias("lane_before"))
    return before.join(decided(spark, sf, {"email_type_confidence": 0.8}).select("id", F.col("lane").alias("lane_after")), "id").where("lane_before <> lane_after")


def customer_tier_lookup(spark, sf):
    return policy.with_customer(inbox(spark, sf, ()), bridge.customers(spark)).select("id", "customer.name", "customer.tier")


def unmatched_senders(spark, sf):
    return policy.unmatched(inbox(spark, sf, ()), bridge.customers(spark)).select("id", tx.domain(F.col("from_email")).alias("domain"))


def answer_key_accuracy(spark, sf):
    return decided(spark, sf).agg(F.count("matches_expected").alias("graded"), F.count_if("matches_expected").alias("matches"))


def top2_types(spark, sf):
    return inbox(spark, sf, ("email_type",)).select("id", an.top_two(F.col("answers.email_type.probabilities"), EMAIL_TYPE_LABELS).alias("top2"))


def pair_confidence(spark, sf):
    p = inbox(spark, sf, ("email_type",)).select("id", an.pair(F.col("answers.email_type.probabilities")).alias("pair"))
    return p.select("id", F.round("pair.confidence", 6).alias("confidence")).where("confidence is not null")


def expected_urgency(spark, sf):
    return inbox(spark, sf, ("urgency",)).select("id", F.round("answers.urgency.score", 6).alias("score"), F.round("answers.urgency.confidence", 6).alias("confidence"))


def po_total(spark, sf):
    return po_specs(spark, sf).select("id", F.round(att.po_total(F.col("a.po_lines")), 2).alias("total"))


def po_text(spark, sf):
    return po_specs(spark, sf).select("id", att.po_text(F.col("a")).alias("text"))


def _drawing(p: DataFrame, kind: str) -> DataFrame:
    return p.select(
        "p_partkey",
        attachment(
            name=F.lit("d.pdf"), kind=F.lit(kind), legend=F.when(F.col("p_partkey") % 5 == 0, F.lit("proprietary")), company=F.lit("Acme"), title=F.col("p_name"), part_number=F.col("p_partkey"),
            rev=F.when(F.col("p_partkey") % 3 != 0, F.lit("B")), material=F.col("p_type"), callouts=F.array(F.col("p_brand"), F.lit("2X\tHOLES")), notes=F.array(F.lit("BREAK EDGES"), F.lit("CLEAN “PARTS”")),
            shape=F.col("shape"), size=F.col("size"), units=F.col("units"), originating_system=F.lit("CAD 1"),
        ).alias("a"),
    )


def drawing_text(spark, sf):
    return _drawing(part_specs(spark, sf), "drawing").select("p_partkey", att.drawing_text(F.col("a")).alias("text"))


def model_text(spark, sf):
    return _drawing(part_specs(spark, sf), "model").select("p_partkey", att.model_text(F.col("a")).alias("text"))


def rfq_form_text(spark, sf):
    p = table(spark, sf, "part")
    line = F.struct(
        F.col("p_partkey").cast("string").alias("part_number"), F.lit("A").alias("rev"), F.col("p_name").alias("description"), F.col("p_type").alias("material"), F.lit("").alias("finish"),
        F.when(F.col("p_size") > 5, F.array(F.col("p_size") * 100.0, F.lit(5000.0))).alias("quantities"), F.lit("rush").alias("notes"),
    )
    a = attachment(kind=F.lit("rfq_form"), rfq_number=F.concat(F.lit("R-"), F.col("p_partkey")), company=F.lit("Acme"), buyer=F.lit("Ana"), respond_by=F.lit("2026-09-10"), date=F.lit("2026-09-01"), rfq_lines=F.array(line, line), terms=F.lit("NET 30"))
    return p.select("p_partkey", att.rfq_form_text(a).alias("text"))


def document_text(spark, sf):
    d = table(spark, sf, "documents")
    kinds = F.array(*map(F.lit, [*DOC_TYPE_LABELS, "unknown"]))
    section = F.struct(F.col("lang").alias("heading"), F.array(F.col("source"), F.lit("line — two"), F.col("text")).alias("lines"))
    a = attachment(kind=F.lit("document"), doc_type=F.element_at(kinds, (F.col("doc_id") % 10 + 1).cast("int")), title=F.concat(F.lit("Doc "), F.col("doc_id")), sections=F.array(section))
    return d.select("doc_id", F.md5(F.encode(att.document_text(a), "UTF-8")).alias("digest"))


def cad_detection(spark, sf):
    p = table(spark, sf, "part")
    ends = ("step", "pdf", "STP", "jpg", "dwg", "zip")
    words = ("", "_po", "-rfq", "cert_", "support")
    k = F.col("p_partkey")
    name = F.concat(F.lit("Part"), k, F.element_at(F.array(*map(F.lit, words)), (k % 5 + 1).cast("int")), F.lit("."), F.element_at(F.array(*map(F.lit, ends)), (k % 6 + 1).cast("int")))
    kind = F.element_at(F.array(*map(F.lit, ("name_only", "upload", "drawing", "po"))), (k % 4 + 1).cast("int"))
    media = F.when(k % 8 == 1, F.lit("pdf")).otherwise(F.lit("jpg"))
    return p.select("p_partkey", name.alias("name"), att.is_cad(name, kind, media).alias("cad"))


def marked_documents(spark, sf):
    """Every document as an uploaded file of two kinds: which of its attachments carry an export marking."""
    d = table(spark, sf, "documents")
    upload = lambda name, text: attachment(name=F.lit(name), kind=F.lit("upload"), media=F.lit("pdf"), text=text)
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Note: ITAR\n"), "text")).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("SITAR, U.S. PERSONS ONLY. "), "text")).otherwise(F.concat(F.lit("SITAR and cuisine. "), "text"))
    return d.select("doc_id", F.array_join(att.marked_names(F.array(upload("plain.pdf", F.col("text")), upload("marked.pdf", marked))), ",").alias("names"))


def clean_squeeze(spark, sf):
    noisy = F.concat(F.lit("  "), F.replace("text", F.lit(" the "), F.lit("\t\t“the” — ")), F.lit("\n \n\nend "))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(tx.clean(noisy), "UTF-8")).alias("cleaned"), F.md5(F.encode(tx.squeeze(noisy), "UTF-8")).alias("squeezed"))


def body_truncation(spark, sf):
    body = tx.shorten(tx.strip(F.col("text")), 8000, rstrip=False)
    return table(spark, sf, "documents").select("doc_id", F.length(body).alias("n"), F.md5(F.encode(body, "UTF-8")).alias("digest"))


def text_budget(spark, sf):
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.repeat(x["text"], 6)).alias("texts"))
    return c.select("conv_id", F.array_join(F.transform(att.within_budget(F.col("texts")), lambda t: F.length(t).cast("string")), ",").alias("lengths"))


def tidy_lines(spark, sf):
    broken = F.replace("text", F.lit(". "), F.lit("\nA\n12\nD D\n"))
    return table(spark, sf, "documents").select("doc_id", F.md5(F.encode(tx.tidy_lines(broken), "UTF-8")).alias("digest"))


def message_state(spark, sf):
    """Messages with bodies (an order whose number no document has comes without one): the parts of the state."""
    m, d = inbox(spark, sf, ()), table(spark, sf, "documents")
    b = m.join(d.select(F.col("doc_id").alias("body_id"), F.col("text").alias("body")), F.col("id") == F.col("body_id"), "left")
    s = b.select("id", att.state(F.col("from_name"), F.col("from_email"), F.col("subject"), F.col("body"), F.col("attachments")).alias("s"))
    return s.select("id", F.col("s.from").alias("sender"), "s.subject", F.md5(F.encode("s.body", "UTF-8")).alias("body"), F.md5(F.encode("s.attachments", "UTF-8")).alias("attachments"))


def _layer(e: DataFrame, odd: int) -> DataFrame:
    key = F.concat_ws(":", "user_id", "event_type")
    rows = e.where(F.col("event_id") % 2 == odd).select(key.alias("key"), F.col("event_id").alias("saved_at"), "value")
    return records.latest(rows)


def cache_merge(spark, sf):
    e = table(spark, sf, "events")
    return records.merged(_layer(e, 0), _layer(e, 1)).select("key", "saved_at", F.round("value", 6).alias("value"))


def cache_hits_misses(spark, sf):
    e = table(spark, sf, "events")
    asked, saved = _layer(e, 0), _layer(e, 1)
    hit, miss = records.hits(asked, saved), records.misses(asked, saved)
    return hit.select("key", F.lit("hit").alias("outcome")).unionByName(miss.select("key", F.lit("miss").alias("outcome")))


def latest_record(spark, sf):
    e = table(spark, sf, "events").select(F.col("user_id").cast("string").alias("key"), F.col("event_id").alias("saved_at"), "event_type")
    return records.latest(e)


def cache_size(spark, sf):
    e = table(spark, sf, "events")
    return board.cache_size(_layer(e, 0), _layer(e, 1))


def change_feed(spark, sf):
    """Items that a new bar makes worth sending again."""
    sig = board.signature(F.col("lane"), F.col("priority"))
    before = decided(spark, sf).select("id", sig.alias("sig"))
    after = decided(spark, sf, {"email_type_confidence": 0.8}).select("id", sig.alias("sig"))
    return board.changes(before, after)


def version_feed(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id", F.pmod("event_id", F.lit(16)).alias("version")).agg(F.max("event_type").alias("sig"))
    return board.versioned(e.select(F.col("user_id").alias("id"), "version", "sig"))


def _items(spark, sf):
    e = table(spark, sf, "events")
    k = F.col("event_id")
    lane = F.when(k % 5 != 0, F.element_at(F.array(*map(F.lit, ("review", "orders", "turning"))), (k % 3 + 1).cast("int")))
    return e.select(
        lane.alias("lane"), F.when(k % 4 != 0, k % 3 == 1).alias("matches_expected"), F.when(k % 9 == 0, F.lit(0.0)).otherwise(F.round("value", 3)).alias("latency_ms"),
        F.when(k % 2 == 0, F.round("value", 3) / 1000).alias("cost_usd"), (F.round("value", 3) / 500).alias("list_price_usd"), F.when(k % 7 != 0, k % 2 == 1).alias("cost_is_estimate"),
    )


def board_stats(spark, sf):
    s = board.stats_with_median(_items(spark, sf))
    return s.select("total", "routed", "auto", "review", "graded", "matches", *[F.round(c, 4).alias(c) for c in ("avg_latency_ms", "cost_usd", "list_price_usd", "median_latency_ms")], "cost_reported")


def upload_retention(spark, sf):
    store = table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), F.col("n_chars").alias("size"), (F.col("doc_id") % 3 == 0).alias("attached"), (F.col("doc_id") % 100 * 60.0).alias("added_at"))
    store = store.join(table(spark, sf, "documents").select(F.col("doc_id").alias("ord"), "lang", "source"), "ord")
    return uploads.retain(store, 6000.0, 1_000_000).select(F.col("ord").alias("doc_id"), "size", "lang", "source")


def content_sniff(spark, sf):
    p = table(spark, sf, "pages")
    k = F.col("page_id") % 4
    body = F.when(k == 0, F.concat(F.lit("%PDF-1.4 "), F.col("html"))).when(k == 1, F.concat(F.substring("html", 1, 100), F.lit("%PDF-"))).otherwise(F.col("html"))
    data = F.when(k == 2, F.concat(F.expr("X'89504E470D0A1A0A'"), F.encode("html", "UTF-8"))).otherwise(F.encode(body, "UTF-8"))
    return p.select("page_id", binary.sniff(data).alias("media"))


def png_sizes(spark, sf):
    head = lambda w, h: F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), F.lpad(F.hex(w), 8, "0"), F.lpad(F.hex(h), 8, "0")))
    p = table(spark, sf, "part").select("p_partkey", binary.png_size(head(F.col("p_partkey") + 7, F.col("p_size").cast("long"))).alias("s"))
    return p.select("p_partkey", "s.width", "s.height")


#: What is added to the tables' invented prose, so that every rule and lane is met.
PHRASES = (
    "", " Please quote 500 pcs of the anodized shaft, due next month.", " RFQ: 25 each of the 5-axis impeller, attached drawing.", " Purchase order 77, please proceed. Need it today.", " What is the status of our order, is it shipped?",
    " Our services: we are ITAR registered, special pricing.", " ITAR data, see rev b, please revise. Quote by Friday 3.", " Can you make this bracket? 5 / 10 / 20", " Weld and casting work, quote please, urgent.", " Revised model, update quote for the housing, 12 pcs this week.",
    " CUI, PO attached.", " We offer staffing and hiring.",
)


def _said(spark, sf) -> DataFrame:
    """Every document's source, and its text with a phrase."""
    d = spread(table(spark, sf, "documents").select("doc_id", "source", "text"))
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.col("doc_id") % len(PHRASES) + 1).cast("int"))
    return d.select("doc_id", "source", F.concat(F.coalesce("text", F.lit("")), phrase).alias("text"))


def rules_decider(spark, sf):
    d = _said(spark, sf)
    state = F.struct(F.concat(F.lit("s"), F.col("source")).alias("subject"), F.col("text").alias("body"), F.lit("none").alias("attachments"))
    a = d.select("doc_id", decider.keyword_answers(state, SHOP).alias("a"))
    return a.select("doc_id", F.col("a.email_type.choice").alias("kind"), F.col("a.process.choice").alias("process"), F.col("a.volume.choice").alias("volume"), "a.urgency.score", F.col("a.export_controlled.p").alias("export_p"), F.col("a.quantity_given.p").alias("quantity_p"))


def routed_documents(spark, sf):
    """From texts to decisions in one plan: rules, policy, lanes."""
    from ..engine import Engine

    d = _said(spark, sf)
    emails = d.select(F.col("doc_id").alias("id"), F.col("source").alias("from_name"), F.concat("source", F.lit("@x.example.com")).alias("from_email"), F.concat(F.lit("s"), F.col("source")).alias("subject"), F.col("text").alias("body"), F.array().cast(f"array<{att_type()}>").alias("attachments"), F.lit(None).cast("string").alias("expected_lane"))
    return Engine(spark, SHOP).route(emails, bridge.TODAY).groupBy("lane", "priority").agg(F.count("*").alias("n"))


def att_type() -> str:
    from ..schemas import ATTACHMENT

    return ATTACHMENT


def url_hosts(spark, sf):
    return table(spark, sf, "pages").groupBy(tx.url_host(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


def error_kinds(spark, sf):
    e = table(spark, sf, "events")
    status = F.element_at(F.array(*map(F.lit, (400, 401, 402, 403, 404, 418, 422, 429, 500, 503, 529))), (F.col("event_id") % 11 + 1).cast("int"))
    message = F.when(F.col("event_id") % 2 == 0, F.lit("Not on your Plan")).otherwise(F.lit("no"))
    return e.groupBy(status.alias("status"), records.error_kind(status, message).alias("kind")).agg(F.count("*").alias("n"))


def error_messages(spark, sf):
    e = table(spark, sf, "events")
    kind = F.col("event_id") % 4
    word = F.col("event_type")
    body = (
        F.when(kind == 0, F.concat(F.lit('{"error":{"message":"'), word, F.lit('"}}')))
        .when(kind == 1, F.concat(F.lit('{"message":"'), word, F.lit('"}')))
        .when(kind == 2, F.concat(F.lit('{"detail":[{"msg":"'), word, F.lit('"}]}')))
        .otherwise(F.lit("not json"))
    )
    return e.select("event_id", records.error_message(body, F.lit("HTTP error")).alias("message"))


def safe_filenames(spark, sf):
    k = F.col("p_partkey")
    name = F.concat(F.when(k % 2 == 0, F.lit("C:\\a\\")).otherwise(F.lit("../b/")), F.replace("p_name", F.lit(" "), F.lit("  <")), F.when(k % 3 == 0, F.lit(".PDF")).when(k % 3 == 1, F.lit(".txt")).otherwise(F.lit("")))
    return table(spark, sf, "part").select("p_partkey", tx.safe_filename(name, F.lit("pdf")).alias("name"))


def first_names(spark, sf):
    k = F.col("c_custkey")
    name = F.when(k % 4 == 0, F.concat(F.lit(" Mr "), F.col("c_name"), F.lit(", Jr."))).when(k % 4 == 1, F.concat(F.col("c_mktsegment"), F.lit(" Team"))).when(k % 4 == 2, F.concat(F.lit("a@"), F.col("c_name")))
    return table(spark, sf, "customer").select("c_custkey", tx.first_name(name).alias("first"))


def business_days(spark, sf):
    o = table(spark, sf, "orders")
    day, n = F.to_date("o_orderdate"), (F.col("o_orderkey") % 12 + 1).cast("int")
    due = dates.add_business_days(day, n)
    return o.select("o_orderkey", due.cast("string").alias("due"), dates.friendly_date(due, day).alias("label"))


def size_phrases(spark, sf):
    p = part_specs(spark, sf)
    return p.select("p_partkey", geometry.size_phrase(F.col("size"), F.col("shape"), F.col("units")).alias("size"), geometry.bbox_phrase(F.col("size"), F.col("shape"), F.col("units")).alias("box"))


def queue_order(spark, sf):
    o = table(spark, sf, "orders")
    k = F.col("o_orderkey")
    ordered = o.select("o_orderkey", records.queue_order(k % 4 == 0, F.floor(k / 10), k % 10).alias("q"))
    return ordered.select("o_orderkey", F.col("q.col1").alias("batch"), F.col("q.col2").alias("position"))


#: The shapes, in the order in which parts take them.
SHAPES = (
    "plate", "block", "bracket", "housing", "cover", "manifold", "heatsink", "fixture", "enclosure", "structural_fitting", "impeller", "implant", "contoured",
    "shaft", "pin", "disc", "nozzle", "threaded_fitting", "bushing", "spacer", "ring", "weldment", "sheet_metal", "casting", "assembly",
)


def mesh_bbox(spark, sf):
    """Every part as one of all shapes: its mesh's extents, and that its corners are where its faces say."""
    p = spread(part_specs(spark, sf).select("p_partkey", "size"), 1 << 19).withColumn("shape", F.element_at(F.array(*map(F.lit, SHAPES)), (F.col("p_partkey") % 25 + 1).cast("int")))
    m = p.select("p_partkey", "shape", render.mesh("shape", "size").alias("m"))
    used = F.array_size(F.array_distinct(F.flatten("m.faces"))) == F.size("m.vertices")
    return m.select("p_partkey", "shape", *[F.col("m.bbox")[i].alias(c) for i, c in enumerate("xyz")], used.alias("all_used"))


def render_files(spark, sf):
    """The file of every part's drawing: what it is, how many pages, and that it is whole."""
    d = _drawing(spread(part_specs(spark, sf), 1 << 18), "drawing").select("p_partkey", layout.derived(F.col("a")).alias("f"))
    head = F.decode(F.substring("f.content", 1, 8), "ISO-8859-1")
    return d.select("p_partkey", "f.media", "f.pages", head.alias("head"), (F.length("f.content") > 1000).alias("long_enough"), F.contains("f.thumb", F.lit("PAGE 1 OF 1")).alias("numbered"), "f.error")


def described(spark, sf):
    a = _drawing(part_specs(spark, sf), "model").select("p_partkey", att.describe(F.col("a"), F.concat(F.lit("/att/"), F.col("p_partkey")), F.lit(True)).alias("d"))
    return a.select("p_partkey", "d.kind", "d.label", "d.media", F.length("d.preview").alias("preview_chars"), "d.url")


QUERIES = (
    lane_decision, lane_counts, review_reasons, all_reasons, flag_list, priority_due, friendly_due, reply_action, trace_steps, process_guess, threshold_change,
    customer_tier_lookup, unmatched_senders, answer_key_accuracy, top2_types, pair_confidence, expected_urgency,
    po_total, po_text, drawing_text, model_text, rfq_form_text, document_text, cad_detection, marked_documents, clean_squeeze, body_truncation, text_budget, tidy_lines, message_state,
    cache_merge, cache_hits_misses, latest_record, cache_size, change_feed, version_feed, board_stats, upload_retention, content_sniff, png_sizes,
    rules_decider, routed_documents, url_hosts, error_kinds, error_messages, safe_filenames, first_names, business_days, size_phrases, queue_order, mesh_bbox, render_files, described,
)


def queries() -> dict:
    return {f.__name__: f for f in (*QUERIES, *more_queries.QUERIES)}


__all__ = ["queries"]
