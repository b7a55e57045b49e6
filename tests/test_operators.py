"""Attachments, policy, records, board, uploads and rules, on literal cases."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from triagelake.engine import Engine
from triagelake.operators import attachments as att
from triagelake.operators import board, decider, messages, policy, ranges, records, runs, uploads
from triagelake.schemas import ANSWERS, ATTACHMENT, Shop
from triagelake.sources.inbox import INBOX

DAY = dt.date(2026, 9, 3)
SHOP = Shop(customers=[("Acme.com", "Acme", "A", "Mo"), ("acme.com", "Second", "C", "Mo"), ("bee.org", "Bee", "B", "Mo")])


def normalised(spark, items):
    doc = json.dumps({"emails": [{"id": "E1", "attachments": items}]})
    df = spark.createDataFrame([(doc,)], "v string").select(F.explode(F.from_json("v", INBOX)["emails"]).alias("e"))
    return df.select(att.normalise(F.col("e.attachments")).alias("a"))


def test_bare_names_and_objects_mix(spark):
    rows = normalised(spark, ["a\tb.pdf", {"name": "x" * 130, "kind": "po", "lines": [{"qty": "2", "unit_price": "$1,000.50", "part_number": "P"}]}, {"kind": "model"}, {"name": "n"}]).first().a
    assert [(r.name[:5], r.kind, len(r.name)) for r in rows] == [("a b.p", "name_only", 7), ("xxxxx", "po", 120), ("attac", "model", 10), ("n", "name_only", 1)]
    assert rows[1].po_lines[0].unit_price == "$1,000.50" and rows[1].rfq_lines is None
    assert normalised(spark, None).first().a == []


def test_cad_names_by_kind_and_ending(spark):
    items = [{"name": "drawing.pdf", "kind": "drawing"}, {"name": "po.pdf", "kind": "po"}, {"name": "rfq.pdf", "kind": "rfq_form"}, {"name": "part.step", "kind": "model"}, "sketch.pdf", "PO_1234.pdf", "part.stp", "photo.jpg", {"name": "scan.jpg", "kind": "upload", "media": "jpg"}]
    assert normalised(spark, items).select(att.cad_names(F.col("a")).alias("c")).first().c == ["drawing.pdf", "part.step", "sketch.pdf", "part.stp"]


def fold(texts):
    left, out = 6000, []
    for t in texts:
        limit = min(1800, max(200, left))
        t = t if len(t) <= limit else t[:limit].rstrip() + " [truncated]"
        left -= len(t)
        out.append(t)
    return out


@pytest.mark.parametrize("texts", [[], ["x"], ["ab " * 8333] * 5, ["y" * 1800, "y" * 1801], ["z" * 3000] * 9])
def test_text_budget_equals_a_loop(spark, texts):
    df = spark.createDataFrame([(texts,)], "t array<string>")
    got = df.select(att.within_budget(F.col("t")).alias("o")).first().o
    assert got == fold(texts) and (len(texts) != 5 or (max(map(len, got)) <= 1820 and sum(map(len, got)) <= 6400))


def test_spec_texts(spark):
    items = [
        {"name": "d", "kind": "drawing", "legend": "itar", "title": "PLATE", "part_number": "P-1", "material": "6061", "size": [4, 3, 1], "shape": "plate", "units": "in", "notes": ["ONE", "TWO"], "revisions": [{"rev": "A", "description": "FIRST", "date": "2026"}, "junk"], "drawn_by": "AD", "date": "2026-01-01"},
        {"name": "u", "kind": "upload", "media": "png", "width": 3, "height": 2},
        {"name": "v", "kind": "upload", "media": "pdf", "text": " hi "},
        {"name": "w", "kind": "upload", "media": "pdf", "text_error": "broken"},
        {"name": "y", "kind": "document", "doc_type": "cert", "title": "T", "sections": [{"heading": "H", "lines": ["a", "b"]}]},
        {"name": "c", "kind": "document", "legend": "cui", "company": "acme", "buyer": "bo"},
        "plain.txt",
    ]
    t = [r for r in normalised(spark, items).select(F.transform("a", att.full_text).alias("t")).first().t]
    assert t[0].split("\n")[:2] == ["ENGINEERING DRAWING (PDF)", "TITLE BLOCK: . TITLE: PLATE. DWG NO: P-1 REV . SCALE 1:1. SHEET 1 OF 1. DRAWN: AD 2026-01-01."]
    assert "NOTES: 1. ONE 2. TWO" in t[0] and "OVERALL SIZE: 4.000 x 3.000 x 1.000 (IN)" in t[0] and t[0].endswith("U.S. PERSONS ONLY.") and "REVISIONS: A FIRST 2026" in t[0]
    assert t[1] == "(image file, 3 x 2 px; there is no text to read)" and t[2] == "hi" and t[3] == "(PDF file; its text could not be read: broken)"
    assert t[4] == "CERTIFICATE: T\nH: a b" and "CONTROLLED BY: ACME." in t[5] and t[5].endswith("POC: BO.") and t[6].startswith("(attached to the email")
    assert normalised(spark, items).select(att.marked_names(F.col("a")).alias("m")).first().m == ["d", "c"]


def answers(kind=None, process="milling_3axis", export=0.02, urgency=0.0, qty=0.9, drw=0.9, osp=0.1, volume="not_stated", probs=None, confidence=0.9):
    def choice(options, winner, sure=0.9):
        p = 0.9 if winner in options else 0.0
        ps = {o: (p if o == winner else round((1 - p) / (len(options) - 1), 4)) for o in options}
        return {"choice": winner, "p": p, "confidence": sure, "confidence_estimated": False, "probabilities": [{"key": k, "p": v} for k, v in ps.items()]}

    types = ["new_rfq", "quote_revision", "purchase_order", "order_followup", "vendor_or_solicitation", "other"]
    et = choice(types, kind or "new_rfq", confidence)
    if probs:
        top = max(probs, key=probs.get)
        et = {"choice": top, "p": probs[top], "confidence": confidence, "confidence_estimated": False, "probabilities": [{"key": t, "p": probs.get(t, 0.02)} for t in types]}
    return {
        "email_type": et, "process": choice(["milling_3axis", "milling_5axis", "turning", "mixed_or_unclear"], process), "export_controlled": {"p": export},
        "urgency": {"score": urgency, "confidence": 0.9}, "quantity_given": {"p": qty}, "drawings_provided": {"p": drw}, "outside_processing": {"p": osp},
        "volume": choice(["prototype", "low_volume", "production", "not_stated"], volume),
    }


def decide(spark, cases, today=DAY, bars=None, shop=SHOP):
    """cases: dicts of answers, sender, attachments, expected."""
    rows = [(i, c.get("name", "Ana Diaz"), c.get("sender", "a@acme.com"), c.get("subject", "Parts"), json.dumps(c.get("attachments", [])), json.dumps(c["answers"]), c.get("expected")) for i, c in enumerate(cases)]
    df = spark.createDataFrame(rows, "id int, from_name string, from_email string, subject string, atts string, ans string, expected_lane string")
    df = df.select("id", "from_name", "from_email", "subject", F.from_json("atts", f"array<{ATTACHMENT}>").alias("attachments"), F.from_json("ans", ANSWERS).alias("answers"), "expected_lane")
    out = policy.decide(policy.with_customer(df, policy.customers_frame(spark, shop)), shop, today, bars)
    return sorted(out.collect(), key=lambda r: r.id)


def test_lanes(spark):
    types = {"purchase_order": 0.46, "order_followup": 0.46}
    cases = [
        {"answers": answers()},
        {"answers": answers(probs=types, confidence=0.352), "expected": "orders"},
        {"answers": answers(probs={"new_rfq": 0.46, "quote_revision": 0.46}, confidence=0.352)},
        {"answers": answers(probs={"vendor_or_solicitation": 0.46, "other": 0.46}, confidence=0.352)},
        {"answers": answers(probs={"purchase_order": 0.46, "new_rfq": 0.46}, confidence=0.352), "expected": "orders"},
        {"answers": answers(export=0.5)},
        {"answers": answers(export=0.499)},
        {"answers": answers("vendor_or_solicitation", export=0.9, confidence=0.8)},
        {"answers": answers("vendor_or_solicitation", export=0.9, confidence=0.79)},
        {"answers": answers(process="mixed_or_unclear")},
        {"answers": answers(confidence=None, probs={"other": 0.9})},
    ]
    got = decide(spark, cases)
    assert [r.lane for r in got] == ["milling_3axis", "orders", "milling_3axis", "review", "review", "itar", "milling_3axis", "filtered", "itar", "review", "review"]
    assert [r.matches_expected for r in got[:5]] == [None, True, None, None, False]
    assert got[4].reason == "Model is unsure what kind of email this is: New RFQ 46% vs Purchase order 46%."
    assert got[8].flags[0].id == "itar" and "itar_check" in [f.id for f in got[7].flags]
    # the bar of type confidence above the exemption's
    assert decide(spark, [{"answers": answers("other", export=0.9, confidence=0.85)}], bars={"email_type_confidence": 0.9})[0].lane == "itar"


def test_flags_priority_and_due(spark):
    cases = [
        {"answers": answers(urgency=2.5, export=0.3, qty=0.1, drw=0.1, osp=0.7, volume="production")},
        {"answers": answers(volume="production")},
        {"answers": answers("purchase_order"), "sender": "x@nowhere.net"},
        {"answers": answers(urgency=1.6), "sender": "x@bee.org"},
        {"answers": answers(), "sender": "x@bee.org"},
        {"answers": answers("other", urgency=3.0)},
        {"answers": answers(drw=0.1), "attachments": [{"name": "a.step", "kind": "name_only"}]},
    ]
    r = decide(spark, cases)
    assert [f.id for f in r[0].flags] == ["rush", "itar_check", "missing_drawings", "missing_qty", "outside_processing", "volume"]
    assert [(x.priority, x.priority_reason) for x in r[:6]] == [("P1", "rush language"), ("P1", "A-tier customer and production volume"), ("P2", "customer is waiting on an existing order"), ("P2", "short turnaround"), ("P3", "standard request"), (None, "")]
    assert [x.due and (x.due.date, x.due.label, x.due.kind) for x in r[:6]] == [("2026-09-03", "today", "quote"), ("2026-09-03", "today", "quote"), ("2026-09-03", "today", "reply"), ("2026-09-07", "Mon, Sep 7", "quote"), ("2026-09-10", "Thu, Sep 10", "quote"), None]
    assert r[5].flags == [] and r[5].action.draft is None and r[5].due is None and r[6].missing == []
    assert r[0].customer.name == "Acme" and r[0].action.draft.startswith("Hi Ana,\n\nThanks for the RFQ.") and "could you send drawings (PDF plus STEP if you have it) and the quantities you want quoted?" in r[0].action.draft
    # due today even on a Saturday
    assert decide(spark, [cases[0]], dt.date(2026, 9, 5))[0].due.date == "2026-09-05"


def test_marking_is_named_in_the_trace(spark):
    files = [{"name": "scan.pdf", "kind": "upload", "media": "pdf", "text": "This is ITAR data"}]
    (r,) = decide(spark, [{"answers": answers(export=0.9), "attachments": files}])
    assert r.lane == "itar" and r.export_marked == ["scan.pdf"] and "scan.pdf" in r.trace[0].detail and [t.label for t in r.trace] == ["Export-controlled?", "What kind of email?", "Anything missing?", "Priority", "Route"]


def test_bars_are_clamped():
    bars = Shop(thresholds={"rush_score": 9, "nonsense": 1}).bars({"soon_score": -1, "quantity_given": 2})
    assert (bars["rush_score"], bars["soon_score"], bars["quantity_given"]) == (3.0, 0.0, 1.0) and "nonsense" not in bars


def test_engine_end_to_end_and_replay(spark):
    engine = Engine(spark, SHOP)
    rows = [("E1", "Ana", "a@acme.com", "RFQ for 25 pcs brackets", "Please quote the attached drawing, dwg no 7."), ("E2", "Bo", "b@x.org", "PO 77", "Our purchase order, please proceed."), ("E3", "C", "c@y.org", "Webinar", "unsubscribe"), ("E4", "D", "d@z.org", None, None)]
    emails = spark.createDataFrame(rows, "id string, from_name string, from_email string, subject string, body string").withColumn("attachments", F.array().cast(f"array<{ATTACHMENT}>")).withColumn("expected_lane", F.lit(None).cast("string"))
    got = {r.id: r for r in engine.route(emails, DAY).collect()}
    assert {k: r.lane for k, r in got.items()} == {"E1": "milling_3axis", "E2": "orders", "E3": "filtered", "E4": "filtered"}
    stated = engine.state(emails)
    saved = engine.answers(stated).select("key", "answers")
    assert records.misses(stated, saved).count() == 0 and {r.source for r in engine.answers(stated, saved).collect()} == {"saved"}
    assert engine.lanes().count() == 7 and engine.questions().count() == 8
    assert stated.where("id = 'E4'").first().state.attachments == "none"


def test_rules_choose_the_largest_count(spark):
    state = F.struct(F.lit("rfq").alias("subject"), F.lit("10 pcs or 1,000 pcs of shaft, anodized, ASAP").alias("body"), F.lit("none").alias("attachments"))
    a = spark.range(1).select(decider.keyword_answers(state, SHOP).cast(ANSWERS).alias("a")).first().a
    assert (a.email_type.choice, a.process.choice, a.volume.choice, a.urgency.score, a.outside_processing.p) == ("new_rfq", "turning", "production", round(0.08 + 0.16 + 3 * 0.76, 4), 0.85)
    assert [o.key for o in a.process.probabilities][0] == "turning" and a.email_type.confidence == round((6 * 0.82 - 1) / 5, 4)


def test_pacing_of_calls():
    waits, script = [], iter([{"error": "rate_limit", "retry_after": 0}, {"error": "rate_limit", "retry_after": 200}, {"error": "server"}, {"answers": {}}])
    assert decider.ask(lambda p: next(script), {}, decider.Pacing(), waits.append) == {"answers": {}}
    assert waits[:2] == [61.0, 200] and 2 <= waits[2] <= 2.2
    assert decider.ask(lambda p: {"error": "auth"}, {}, decider.Pacing(), waits.append) == {"error": "auth"}
    n = iter(range(99))
    assert decider.ask(lambda p: {"error": "timeout", "n": next(n)}, {}, decider.Pacing(), waits.append)["n"] == 3


def test_http_answers_stop_after_a_fatal_error(spark):
    def call(payload):
        return {"error": "billing"} if payload["state"]["subject"] == "bad" else {"answers": answers()}

    df = spark.createDataFrame([("k1", ("ok",)), ("k2", ("bad",))], "key string, state struct<subject:string>")
    out = {r.key: r for r in decider.http_answers(df, call).collect()}
    assert out["k2"].error == "billing" and out["k2"].answers is None


def test_records(spark):
    seed = spark.createDataFrame([("a", 1, "s"), ("b", 1, "s")], "key string, saved_at int, v string")
    live = spark.createDataFrame([("b", 2, "l"), ("b", 3, "m"), ("c", 1, "l")], "key string, saved_at int, v string")
    assert [tuple(r) for r in records.export(seed, records.latest(live)).collect()] == [("a", 1, "s"), ("b", 3, "m"), ("c", 1, "l")]
    asked = spark.createDataFrame([("a",), ("z",)], "key string")
    assert [r.key for r in records.misses(asked, seed).collect()] == ["z"] and records.hits(asked, seed).count() == 1
    assert board.cache_size(seed, live).first().cache_size == 3
    assert records.latest(seed.limit(0)).collect() == []


def test_board(spark):
    median = lambda values: board.exact_upper_median(spark.createDataFrame([(v,) for v in values], "v double"), "v").first().v
    assert [median(v) for v in ([1.0, 2.0, 3.0, 4.0], [5.0], [], [2.0, 2.0, 1.0])] == [3.0, 5.0, None, 2.0]
    items = spark.createDataFrame([("review", None, 0.0, None, 0.1, None), ("orders", True, 10.0, 0.5, 0.1, False), (None, None, 99.0, 9.0, 9.0, None)], "lane string, matches_expected boolean, latency_ms double, cost_usd double, list_price_usd double, cost_is_estimate boolean")
    s = board.stats_with_median(items).first()
    assert (s.total, s.routed, s.auto, s.review, s.graded, s.matches, s.avg_latency_ms, s.median_latency_ms, s.cost_usd, s.cost_reported) == (3, 2, 1, 1, 1, 1, 10.0, 10.0, 0.5, True)
    prev, cur = spark.createDataFrame([("1", "x"), ("2", "x"), ("3", "x")], "id string, sig string"), spark.createDataFrame([("1", "x"), ("2", "y"), ("4", "x")], "id string, sig string")
    assert {tuple(r) for r in board.changes(prev, cur).collect()} == {("2", "changed"), ("3", "removed"), ("4", "added")} and board.changes(cur, cur).count() == 0
    e = spark.createDataFrame([("1", 3), ("2", 5)], "id string, changed_at int")
    counts = [board.delta(e, 5, since, boot).count() for since, boot in ((None, True), (-1, True), (9, True), (3, False), (3, True), (5, True))]
    assert counts == [2, 2, 2, 2, 1, 0]


def test_uploads(spark):
    store = spark.createDataFrame([(i, 30, i % 2 == 0, 0.0 if i == 3 else 5000.0) for i in range(21)], "ord long, size long, attached boolean, added_at double")
    kept = sorted(r.ord for r in uploads.retain(store, 6000.0, 500).collect())
    assert kept == list(range(5, 21)) and 3 not in kept
    wanted = spark.createDataFrame([("u1",), ("nope",)], "upload_id string")
    with pytest.raises(Exception, match="no such upload"):
        uploads.claim(wanted, spark.createDataFrame([("u1", "x")], "upload_id string, name string")).collect()


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_running_totals_keep_every_row(spark, adaptive):
    """A million rows in many buckets, with further columns (some of them named as internal ones)."""
    was = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        n = 1_000_000
        df = spark.range(n).select((F.col("id") * 7919 % n).alias("ord"), (F.col("id") % 10).alias("size"), F.lit("x").alias("bucket"), F.col("id").cast("string").alias("inside"), (F.col("id") % 97).alias("b"))
        out = ranges.running_total(df, "ord", "size", "total", newest_first=False)
        w = Window.orderBy("ord")
        want = df.withColumn("total", F.sum("size").over(w))
        assert out.columns == [*df.columns, "total"] and out.count() == n
        digest = lambda t: t.agg(F.sum(F.xxhash64(*[F.col(c) for c in sorted(t.columns)]).cast("decimal(38,0)"))).first()[0]
        assert digest(out) == digest(want)
        numbered = ranges.row_numbers(df, "ord", "k")
        assert numbered.where(F.col("k") != F.col("ord") + 1).count() == 0 and numbered.count() == n
        store = df.select("ord", "size", F.lit(True).alias("attached"), F.lit(0.0).alias("added_at"), "inside")
        assert uploads.retain(store, 0.0, 10**12).count() == n
        assert uploads.retain(store, 0.0, 4500).count() == want.select(F.col("ord")).count() - n + df.withColumn("t", F.sum("size").over(Window.orderBy(F.col("ord").desc()))).where("t <= 4500").count()
        assert board.exact_upper_median(df, "ord").first().ord == n // 2
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", was)


def test_running_totals_with_ties_nulls_and_nothing(spark):
    df = spark.createDataFrame([(1, 5), (1, 7), (None, 2), (3, None), (2, 1)], "o long, v long")
    rows = sorted(((r.o is None, r.o or 0, r.v or 0, r.t) for r in ranges.running_total(df, "o", "v", "t").collect()))
    assert rows == [(False, 1, 5, 13), (False, 1, 7, 13), (False, 2, 1, 1), (False, 3, 0, 0), (True, 0, 2, 15)]
    assert ranges.running_total(df.limit(0), "o", "v", "t").collect() == [] and ranges.row_numbers(df.limit(0), "o", "t").collect() == []


def test_new_messages(spark):
    sample = [{"name": "d.pdf", "kind": "drawing"}, {"name": "m.step", "kind": "model"}, "plain.pdf"]
    examples = normalised(spark, sample).select(F.lit(0).alias("ord"), F.col("a").alias("attachments"))
    store = spark.createDataFrame([("u1", "s.pdf", "pdf", 9, 1, None, None, "text", None)], "upload_id string, name string, media string, size long, pages int, width int, height int, text string, text_error string")
    posts = spark.createDataFrame(
        [
            (1, None, " ", "s", "", "a.pdf; b.pdf,,", " 0 ", ["m.step"], ["u1"]),
            (2, "n", "n@x", "", " ", None, None, None, None),
            (3, "n", "n@x", "", "b", None, "7", None, None),
            (4, "n", "n@x", "x", "b", ",".join(f"f{i}" for i in range(30)), "zero", None, []),
            (5, "n", "n@x", "x", "b", None, None, None, ["nope"]),
            (6, "n", "n@x", "x", "b", None, None, None, ["u1"] * 6),
            (7, "n", "n@x", "x", "b", None, "0", None, None),
        ],
        "ord long, from_name string, from_email string, subject string, body string, names string, example string, example_files array<string>, uploads array<string>",
    )
    errors = {r.ord: r.error for r in messages.checked(posts, examples, store).collect()}
    assert errors == {1: None, 2: messages.NOTHING, 3: None, 4: None, 5: messages.GONE, 6: messages.TOO_MANY, 7: None}
    taken = spark.createDataFrame([("L01",), ("L03",), ("E9",), (None,)], "id string")
    new = sorted(messages.new_messages(posts, taken, examples, store).collect(), key=lambda r: r.ord)
    assert [(r.id, r.from_email, [a.name for a in r.attachments][:4], len(r.attachments)) for r in new] == [
        ("L02", "unknown@example.com", ["m.step", "s.pdf", "a.pdf", "b.pdf"], 4),
        ("L04", "n@x", [], 0),
        ("L05", "n@x", ["f0", "f1", "f2", "f3"], 20),
        ("L06", "n@x", ["d.pdf", "m.step"], 2),
    ]
    upload = new[0].attachments[1]
    assert (upload.kind, upload.upload_id, upload.bytes, upload.text) == ("upload", "u1", 9, "text")
    sent = messages.attachment_at(messages.new_messages(posts, taken, examples, store), spark.createDataFrame([("L02", 1), ("L02", 9), ("L02", -1), ("nope", 0), ("L04", 0)], "id string, idx int")).collect()
    got = {(r.id, r.idx): (r.file, r.text, r.truncated, r.full_chars) for r in sent}
    assert got == {("L02", 1): ("s.pdf", "text", False, 4), ("L02", 9): (None,) * 4, ("L02", -1): (None,) * 4, ("nope", 0): (None,) * 4, ("L04", 0): (None,) * 4}
    shown = messages.public(messages.new_messages(posts, taken, examples, store), store.limit(0)).where("id = 'L02'").first()
    assert [a.available for a in shown.attachments] == [True, False, False, False] and "body" in shown


def test_run_control(spark):
    ids = spark.createDataFrame([(i,) for i in "abcdef"], "id string")
    asked = lambda *names: spark.createDataFrame([(n, k, "k" + n) for k, n in enumerate(names)], "id string, pos long, key string")
    saved = spark.createDataFrame([("kb",)], "key string")
    state = lambda items: {r.id: (r.status, r.source, r.error) for r in items.collect()}
    items = runs.request(runs.blank(ids), asked("a", "b", "c", "a", "zz"), saved, 1, 1)
    assert state(items) == {"a": ("queued", None, None), "b": ("done", "cache", None), "c": ("queued", None, None), "d": ("idle", None, None), "e": ("idle", None, None), "f": ("idle", None, None)}
    items = runs.request(items, asked("d", "e"), saved, 2, 1, front=True)
    assert [r.id for r in runs.next_in_line(items, 9).collect()] == ["d", "e", "a", "c"]
    count = runs.counters(items, spark.createDataFrame([(1,), (2,)], "x int")).first()
    assert (count.cache_hits, count.queue_length, count.calls) == (1, 4, 2)
    items = runs.start(items, spark.createDataFrame([("d",), ("e",)], "id string"), 1)
    assert runs.request(items, asked("d"), saved, 3, 1).where("id = 'd'").first().status == "running"
    stopped = runs.stop(items)
    assert state(stopped)["a"][0] == "idle" and state(stopped)["d"][0] == "running"
    again = runs.request(stopped, asked("d"), saved, 3, 2)
    assert state(again)["d"][0] == "queued"
    answered = spark.createDataFrame([("d", "kd", None, 1.0), ("e", "ke", "server", None)], "id string, key string, error string, latency_ms double")
    shown, kept = runs.finish(items, answered, 1)
    assert state(shown)["d"] == ("done", "live", None) and state(shown)["e"] == ("error", None, "server") and state(shown)["a"][0] == "queued"
    assert [tuple(r) for r in kept.collect()] == [("kd", 1.0)]
    late, kept = runs.finish(stopped, answered, 2)
    assert state(late)["d"] == ("idle", None, None) and kept.count() == 1  # saved, but not shown
    fatal, _ = runs.finish(items, spark.createDataFrame([("d", "kd", "auth")], "id string, key string, error string"), 1)
    assert state(fatal)["a"][0] == "idle" and state(fatal)["d"] == ("error", None, "auth")
    assert state(runs.reset(shown)) == {i: ("idle", None, None) for i in "abcdef"}
    none = runs.request(runs.blank(ids), asked("f", "b"), saved, 1, 1, have_model=False)
    assert state(none)["f"] == ("error", None, "config") and state(none)["b"][0] == "done"
    decided = spark.createDataFrame([("a", "k", "t", 1, "d"), ("b", "k", "t", 1, "d"), ("c", "k", "t", 2, "d")], "id string, key string, saved_at string, thresholds_version int, day string")
    held, todo = runs.remembered(decided, spark.createDataFrame([("a", "k", "t"), ("b", "k2", "t"), ("c", "k", "t")], "id string, key string, saved_at string"), 1, "d")
    assert [r.id for r in held.collect()] == ["a"] and sorted(r.id for r in todo.collect()) == ["b", "c"]
