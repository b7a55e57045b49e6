"""Rendering, sources and streams."""

import json
import re
import threading
import time
import xml.etree.ElementTree as ET
import zlib
from collections import Counter
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest
from pyspark.sql import functions as F

from triagelake.functions.geometry import ROUND
from triagelake.functions import lazy, metrics
from triagelake.operators import decider, layout, render, uploads
from triagelake.plans import bridge
from triagelake.schemas import ANSWERS, ATTACHMENT, ATTACHMENT_FIELDS, Shop
from triagelake.sources import client, read_config, read_env, read_files, read_inbox, read_records, write_records
from triagelake.sources.inbox import pdf_text, read_pdf
from triagelake.streaming import inbox as stream
from triagelake.streaming import tables

from .test_functions import jpeg, png
from .test_operators import DAY, answers

SHAPES = [*ROUND, "plate", "block", "bracket", "housing", "cover", "manifold", "heatsink", "fixture", "enclosure", "structural_fitting", "impeller", "implant", "contoured", "weldment", "sheet_metal", "casting", "assembly", "unheard-of"]


@pytest.mark.parametrize("shape", SHAPES)
def test_meshes_are_closed(shape):
    s = render.solid(shape, [6.0, 3.0, 1.5])
    edges = Counter((f[i], f[(i + 1) % len(f)]) for f in s.faces for i in range(len(f)))
    assert all(n == 1 and edges[(b, a)] == 1 for (a, b), n in edges.items())  # each edge once in either direction
    x, y, z = (6.0, 3.0, 3.0) if shape in ROUND else (6.0, 3.0, 1.5)
    assert s.bbox() == [x, y, z] and all(a == 0 for a, _ in s.extents())
    volume = 0.0  # by tetrahedra over fans; positive where faces are wound from outside
    for f in s.faces:
        a = s.points[f[0]]
        for i in range(1, len(f) - 1):
            b, c = s.points[f[i]], s.points[f[i + 1]]
            volume += (a[0] * (b[1] * c[2] - b[2] * c[1]) - a[1] * (b[0] * c[2] - b[2] * c[0]) + a[2] * (b[0] * c[1] - b[1] * c[0])) / 6
    assert 0.1 * x * y * z < volume <= x * y * z + 1e-9
    root = ET.fromstring(render.to_svg(s, f"{shape} <&>"))
    assert root.tag.endswith("svg") and len(root) > 2


@pytest.mark.parametrize("units", ["in", "mm"])
def test_step_references_exist(units):
    text = render.to_step(render.solid("heatsink", [4, 3, 1]), "P'1", "FIN", "A", units, "AP203")
    defined = set(re.findall(r"^(#\d+)=", text, re.M))
    assert set(re.findall(r"#\d+", text)) == defined and text.startswith("ISO-10303-21;") and "CONFIG_CONTROL_DESIGN" in text and "@" not in text
    xs = [float(x) for x in re.findall(r"CARTESIAN_POINT\('',\(([-\d.]+),", text)]
    assert max(xs) == pytest.approx(4 if units == "mm" else 101.6)  # always in millimetres


def whole_pdf(data):
    start = int(re.search(rb"startxref\n(\d+)", data)[1])
    assert data[start : start + 4] == b"xref"
    offsets = [int(x) for x in re.findall(rb"^(\d{10}) 00000 n", data[start:], re.M)]
    assert all(data[o:].startswith(b"%d 0 obj" % i) for i, o in enumerate(offsets, 1))
    return [zlib.decompress(x) for x in re.findall(rb"stream\n(.*?)\nendstream", data, re.S)]


def specification(**fields):
    empty = dict.fromkeys(ATTACHMENT_FIELDS)
    return {**empty, "legend_text": "", "box_labels": ["4", "3", "1"], "tolerances": "T", **fields}


def test_pages_of_an_order():
    line = {"part_number": "p", "rev": "B", "description": "item " * 12, "qty": "1,250", "unit_price": "$4.50", "due": "2026-01-01"}
    a = specification(kind="po", po_number="77", company="Acme (1) \\ Co", po_lines=[line] * 60, legend_text="WARNING " * 60)
    data, media, thumb, pages, error = layout.make(a)
    sheets = whole_pdf(data)
    assert (media, pages, error, len(sheets)) == ("application/pdf", 3, None, 3)
    assert rb"Acme \(1\) \\ Co" in sheets[0] and b"$337,500.00" in sheets[2] and b"PAGE 3 OF 3" in sheets[2] and all(b"UNIT" not in s and b"DESCRIPTION" in s for s in sheets)
    assert len(ET.fromstring(thumb)) > 50


def test_pages_of_other_kinds():
    drawing = specification(kind="drawing", shape="bracket", size=[4.0, 3.0, 1.0], callouts=["c"] * 9, revisions=[{"rev": "A", "description": "x", "date": "d"}] * 9, notes=["n"])
    data, *_ = layout.make(drawing)
    (page,) = whole_pdf(data)
    assert page.count(b"(c) Tj") == 4 and page.count(b"(A x d) Tj") == 4 and b"(1. n) Tj" in page
    form = specification(kind="rfq_form", rfq_number="R1", rfq_lines=[{"part_number": "p", "rev": "", "description": "d", "material": "m", "finish": "f", "quantities": [1.0, 1000.0], "notes": ""}])
    assert b"1 / 1,000" in whole_pdf(layout.make(form)[0])[0]
    document = specification(kind="document", doc_type="resume", title="T", sections=[{"heading": "H", "lines": ["word " * 50] * 30}])
    assert layout.make(document)[3] == 2
    model = layout.make(specification(kind="model", shape="shaft", size=[4.0, 1.0]))
    assert model[0].startswith(b"ISO-10303-21;") and model[1] == "model/step" and model[3] is None
    assert layout.make(specification(kind="upload"))[4] == "no file for kind upload" and "Error" in layout.make(specification(kind="drawing", size="x"))[4]
    assert layout.row_height(["a " * 40, "b"], [60.0, 60.0]) > layout.row_height(["a", "b"], [60.0, 60.0])


@pytest.mark.parametrize("shape", SHAPES)
def test_files_are_made_fast(shape):
    began = time.perf_counter()
    data, *_, error = layout.make(specification(kind="drawing", shape=shape, size=[4.0, 3.0, 1.0]))
    assert data.startswith(b"%PDF-") and error is None and time.perf_counter() - began < 1.0


def test_wrapping_and_fitting(spark):
    assert metrics.wrap("aa bb cc", metrics.width("aa bb", 9.0), 9.0) == ["aa bb", "cc"]
    assert metrics.wrap("a" * 10 + " b", metrics.width("aaaa", 9.0), 9.0) == ["aaaa", "aaaa", "aa b"] and metrics.wrap("  ", 10, 9.0) == []
    assert metrics.fit("abc", 1000, 9.0) == ("abc", 9.0) and metrics.fit("a" * 50, 30, 9.0)[0].endswith("..") and metrics.fit("a" * 50, 30, 9.0)[1] == 4.5
    df = spark.createDataFrame([("aa bb\ncc",), (None,), ("",)], "t string")
    assert [r.w for r in df.select(metrics.wrapped(df.t, metrics.width("aa bb", 9.0), 9.0).alias("w")).collect()] == [["aa bb", "cc"], [], []]


def test_pdf_reading_is_bounded():
    assert read_pdf(b"junk")[2] and read_pdf(None) == ("", None, "no content")
    assert "longer than" in read_pdf(b"", seconds=0.5, reader="import time; time.sleep(30)")[2]
    hungry = "import resource, sys\nresource.setrlimit(resource.RLIMIT_AS, (int(sys.argv[3]),) * 2)\nb'x' * (1 << 30)\nprint('{}')"
    assert read_pdf(b"", memory=1 << 28, reader=hungry) == ("", None, "the reader ended without an answer")


def test_settings(tmp_path):
    (tmp_path / ".env").write_text('\ufeffA=1\nexport B = "two # 2" \n# C=3\nD=x # remark\nE=\'q\'\nnothing\nA=9\n', encoding="utf-8")
    other = tmp_path / "o"
    other.mkdir()
    (other / ".env").write_text("A=other\nF=f\n")
    paths = client.settings_paths(tmp_path, other, tmp_path)
    assert len(paths) == 2
    assert client.settings(paths, {"D": "real"}) == {"D": "real", "A": "1", "B": "two # 2", "E": "q", "F": "f"}
    found = {"MODEL_GATEWAY_KEY": "vk_123456789", "MODEL_API_KEY": "other", "MODEL_GATEWAY_URL": "http://x.example.com/", "MODEL_TIMEOUT_SECONDS": "soon"}
    cfg = client.model_config(found)
    assert (cfg.endpoint, cfg.host, cfg.timeout, cfg.key_hint(), "key" in cfg.public()) == ("http://x.example.com/v1/answers", "x.example.com", 20.0, "vk_123...(12 chars)", False)
    assert client.model_config({}) is None and client.model_config({"MODEL_API_KEY": "k", "MODEL_BASE_URL": "http://y"}).provider == "service (custom URL)"
    assert [client.retry_after(h, 0.0) for h in (None, {}, {"Retry-After": "3"}, {"retry-after-ms": "1500"}, {"retry-after": "-2"}, {"retry-after": "Thu, 01 Jan 1970 00:01:00 GMT"}, {"retry-after": "x"})] == [None, None, 3.0, 1.5, 0.0, 60.0, None]


def test_model_client_over_http(spark):
    """A local stand-in: one refusal, then answers; a call asks all questions at once."""
    asked = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append(body)
            refuse = len(asked) == 1
            out = {"error": {"message": "slow down"}} if refuse else {"model": "m", "answers": {q: {"probability": 0.75} for q in body["questions"]} if body["state"] != "half" else {}}
            data = json.dumps(out).encode()
            self.send_response(429 if refuse else 200)
            self.send_header("Retry-After", "0.1")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *_): ...

    server = ThreadingHTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        cfg = client.ModelConfig("k", f"http://127.0.0.1:{server.server_port}", "m", "service", "MODEL_API_KEY", 5.0)
        call = client.http_call(cfg, client.PROBE)
        first = call({"state": "x"})
        assert (first["error"], first["status"], first["retry_after"]) == ("rate_limit", 429, 0.1)
        assert call({"state": "half"})["error"] == "bad_response" and call({"state": "x"})["answers"] == {"is_rfq": {"probability": 0.75}}
        r = client.probe(spark, call).first()
        assert (r.ok, r.model, r.probability, r.error) == (True, "m", 0.75, None) and client.probe(spark, None).first().error == "config"
        assert asked[0]["model"] == "m" and set(asked[0]["questions"]) == {"is_rfq"}
        waits = []
        asked.clear()
        out = decider.ask(call, {"state": "x"}, decider.Pacing(pace=0.0), waits.append)
        assert "answers" in out and waits == [0.1]
    finally:
        server.shutdown()
        server.server_close()
    assert client.http_call(cfg, client.PROBE)({"state": "x"})["error"] == "network"


def test_columns_as_text(spark):
    """The lazy layer gives what PySpark's functions give, also where texts and columns are mixed."""
    df = spark.createDataFrame([(1, "a'b\\c\n", [1.5, 2.5]), (None, None, None)], "x int, s string, v array<double>")
    both = lambda f: (f(lazy), f(F))
    cases = [
        lambda f: f.when(f.col("x") > 0, f.lit("it's \\ \n")).when(f.col("x").isNull(), None).otherwise(f.concat("s", f.lit("q"))),
        lambda f: f.transform("v", lambda e, i: f.struct((-e).alias("n"), i.alias("i"), (e * f.col("x")).alias("p"))),
        lambda f: f.aggregate("v", f.lit(0.0), lambda a, e: a + e / 2),
        lambda f: f.filter("v", lambda e: ~(e < 2) & e.isNotNull() | f.lit(False)),
        lambda f: f.regexp_replace("s", r"[\\']", "-"),
        lambda f: f.array_join(f.array(f.lit("a"), f.col("s")), "|", "none"),
        lambda f: f.coalesce(f.col("x"), f.lit(1 << 40)),
        lambda f: f.get(f.col("v"), 0) % 1,
        lambda f: (f.lit(7) - f.col("x")) * 2 / f.lit(4.0),
        lambda f: f.col("s").eqNullSafe(None),
        lambda f: f.struct("x", f.col("s").alias("t"))["t"],
        lambda f: f.col("x").isin(1, 2),
    ]
    for case in cases:
        mine, theirs = both(case)
        assert isinstance(mine, lazy.Text)
        a, b = df.select(mine.alias("c")), df.select(theirs.alias("c"))
        assert a.collect() == b.collect() and a.schema == b.schema
    mixed = df.select((F.col("x") - lazy.col("x")).alias("a"), (lazy.col("x") - F.col("x")).alias("b"), lazy.when(F.col("x") == 1, lazy.lit(2)).otherwise(lazy.col("x")).alias("c"), (F.lit(5) > lazy.col("x")).alias("d")).first()
    assert tuple(mixed) == (0, 0, 2, True)
    assert df.select(lazy.let(lazy.col("x"), lambda v: v + v).alias("c")).first().c == 2


def test_inbox_config_and_records(spark, tmp_path):
    inbox = {"emails": [{"id": "E02", "subject": "s", "attachments": ["a.pdf", {"name": "b", "kind": "po"}], "expected": {"lane": "orders"}}, {"id": "E01"}], "paste_examples": [{"subject": "x"}]}
    (tmp_path / "inbox.json").write_text(json.dumps(inbox))
    rows = read_inbox(spark, str(tmp_path / "inbox.json")).orderBy("origin", "ord").collect()
    assert [(r.id, len(r.attachments), r.expected_lane) for r in rows] == [("X1", 0, None), ("E02", 2, "orders"), ("E01", 0, None)]
    config = {"shop": {"name": "S"}, "lanes": {"orders": {"id": "orders", "name": "O", "owner": "Own"}}, "customers": [{"domain": "a.b", "name": "n", "tier": "A", "account_manager": "m"}], "thresholds": {"rush_score": 1}, "sla_business_days": {"P1": 1}}
    (tmp_path / "shop.json").write_text(json.dumps(config))
    shop = read_config(spark, str(tmp_path / "shop.json"))
    assert (shop.name, shop.orders.owner, shop.customers, shop.bars()["rush_score"], shop.sla_days) == ("S", "Own", [("a.b", "n", "A", "m")], 1.0, {"P1": 1})
    raw = answers()
    for a in raw.values():
        if "probabilities" in a:
            a["probabilities"] = {p["key"]: p["p"] for p in a["probabilities"]}
    (tmp_path / "records.json").write_text(json.dumps({"records": {"k1": {"answers": raw, "latency_ms": 5.0}, "k2": "junk", "k3": {"latency_ms": 1}}}))
    (r,) = read_records(spark, str(tmp_path / "records.json")).collect()
    assert (r.key, r.latency_ms, r.answers.email_type.choice, r.answers.email_type.probabilities[0].key) == ("k1", 5.0, "new_rfq", "new_rfq")
    write_records(spark.createDataFrame([("b", 1), ("a", 2)], "key string, v int"), str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    (tmp_path / "broken.json").write_text("{nope")
    assert read_records(spark, str(tmp_path / "broken.json")).count() == 0 and read_inbox(spark, str(tmp_path / "broken.json")).count() == 0


def test_env_file(spark, tmp_path):
    (tmp_path / ".e").write_text("\ufeff# c\nexport A = 'x # y'\nB=plain # note\n\nC=\"q\"\nbad line\n")
    assert {r.name: r.value for r in read_env(spark, str(tmp_path / ".e")).collect()} == {"A": "x # y", "B": "plain", "C": "q"}


def test_files_are_accepted_by_their_bytes(spark, tmp_path):
    for name, data in (("a.bin", png(33, 21)), ("b.jpg", jpeg(640, 480)), ("c.pdf", b"%PDF-1.4 x"), ("d.pdf", b"<html>"), ("e.pdf", b"")):
        (tmp_path / name).write_bytes(data)
    got = {r.name: r for r in pdf_text(uploads.accept(read_files(spark, str(tmp_path)))).collect()}
    assert {(r.name, r.media, r.width, r.height) for r in got.values()} == {("a.png", "png", 33, 21), ("b.jpg", "jpg", 640, 480), ("c.pdf", "pdf", None, None)}
    assert got["c.pdf"].text == "" and got["c.pdf"].text_error and got["a.png"].text_error is None


def test_stream_equals_batch(spark, sf, tmp_path):
    schema = f"id long, from_name string, from_email string, subject string, attachments array<{ATTACHMENT}>, answers {ANSWERS}, expected_lane string"
    rows = bridge.inbox(spark, sf).limit(40).select("id", "from_name", "from_email", "subject", "attachments", F.col("answers").cast(ANSWERS), "expected_lane")
    rows.repartition(3).write.json(str(tmp_path / "in"))
    shop, customers = Shop(), bridge.customers(spark)
    messages = stream.message_stream(spark, str(tmp_path / "in"), schema, 1)
    decisions = stream.decide_stream(messages, shop, DAY, customers).select("id", "lane", "priority")
    stream.start(decisions, str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(180)
    out = {(r.id, r.lane, r.priority) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = stream.decide_stream(spark.read.schema(schema).json(str(tmp_path / "in")), shop, DAY, customers)
    assert out == {(r.id, r.lane, r.priority) for r in batch.collect()} and len(out) == 40
    seen = []
    stream.start_versions(stream.message_stream(spark, str(tmp_path / "in"), schema, 1).select("id"), str(tmp_path / "ck2"), lambda b: seen.extend((r.id, r.version) for r in b.collect()), once=True).awaitTermination(180)
    assert len({i for i, _ in seen}) == 40 and {v for _, v in seen} == {0, 1, 2}


def test_keys_are_taken_once_within_the_watermark(spark, tmp_path):
    spark.createDataFrame([("a", "2026-01-01T00:00:00", 1), ("a", "2026-01-01T00:01:00", 2), ("b", "2026-01-01T00:02:00", 3)], "key string, saved_ts string, v int").coalesce(1).write.json(str(tmp_path / "in"))
    records = stream.message_stream(spark, str(tmp_path / "in"), "key string, saved_ts timestamp, v int")
    stream.start(stream.first_answers(records), str(tmp_path / "out"), str(tmp_path / "ck"), once=True).awaitTermination(120)
    assert sorted(r.key for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]


def test_files_of_all_kinds_in_a_plan(spark, sf):
    """Specifications with nested rows, as columns: the file's text holds them."""
    line = "named_struct('part_number','p1','rev','A','description','bolt','material','AL','finish','','quantities',array(10D,2500D),'notes','n')"
    section = "array(named_struct('heading','Head','lines',array('one line','two lines')))"
    orders = bridge.po_specs(spark, sf).orderBy("id").limit(3).select("a")
    base = spark.range(1)
    others = [
        base.select(bridge.attachment(kind=F.lit("rfq_form"), rfq_number=F.lit("R7"), rfq_lines=F.expr(f"array({line})"), requirements=F.expr("array('one')")).alias("a")),
        base.select(bridge.attachment(kind=F.lit("document"), doc_type=F.lit("cert"), title=F.lit("Title"), sections=F.expr(section)).alias("a")),
        base.select(bridge.attachment(kind=F.lit("drawing"), shape=F.lit("ring"), legend=F.lit("itar"), revisions=F.expr("array(named_struct('rev','A','description','first','date','today'))")).alias("a")),
        base.select(bridge.attachment(kind=F.lit("model"), shape=F.lit("disc"), units=F.lit("mm")).alias("a")),
        base.select(bridge.attachment(kind=F.lit("name_only"), name=F.lit("x")).alias("a")),
    ]
    made = [r.f for df in [orders, *others] for r in df.select(layout.derived(F.col("a")).alias("f")).collect()]
    assert [m.error for m in made] == [None] * 7 + ["no file for kind name_only"]
    texts = [b" ".join(re.findall(rb"\((.*?)\) Tj", b"\n".join(whole_pdf(m.content)))) for m in made[:6]]  # lines in order
    assert all(b"PURCHASE ORDER" in t and b"ORDER TOTAL: $" in t for t in texts[:3])
    assert b"10 / 2,500" in texts[3] and b"1. one" in texts[3] and b"one line two lines" in texts[4] and b"CERTIFICATE" in texts[4] and b"A first today" in texts[5] and b"ARMS EXPORT" in texts[5]
    assert made[6].media == "model/step" and made[6].pages is None and made[7].content is None


def test_state_that_a_stream_advances(spark, tmp_path):
    """Uploads and requests in three micro-batches each; a batch that is run again changes nothing."""
    for i in range(3):
        rows = [(10 * i + k, 30, k % 2 == 0, 0.0 if k == 3 else 5000.0) for k in range(7)]
        spark.createDataFrame(rows, "ord long, size long, attached boolean, added_at double").coalesce(1).write.json(str(tmp_path / "in" / str(i)))
        spark.createDataFrame([(f"m{(2 * i + k) % 7}", k, f"k{(2 * i + k) % 7}") for k in range(3)], "id string, pos long, key string").coalesce(1).write.json(str(tmp_path / "asked" / str(i)))
    read = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / name / "*"))
    store = str(tmp_path / "store")
    files = read("in", "ord long, size long, attached boolean, added_at double")
    tables.start_table(files, store, str(tmp_path / "ck1"), tables.upload_store(300, lambda: 6000.0), once=True, keep=2).awaitTermination(120)
    assert tables._versions(spark, store) == [1, 2] and tables.current(spark, store, 1) is None
    kept = sorted(r.ord for r in tables.current(spark, store).collect())
    assert kept == [10 * i + k for i in (1, 2) for k in (0, 1, 2, 4, 5, 6)][-10:]
    again = tables.upload_store(300, lambda: 6000.0)(tables.current(spark, store, 2), spark.read.json(str(tmp_path / "in" / "2")).select("ord", "size", "attached", "added_at"), 2)
    assert sorted(r.ord for r in again.collect()) == kept
    ids = spark.createDataFrame([(f"m{i}",) for i in range(8)], "id string")
    items = str(tmp_path / "items")
    step = tables.requested_items(ids, spark.createDataFrame([("k1",)], "key string"))
    tables.start_table(read("asked", "id string, pos long, key string"), items, str(tmp_path / "ck2"), step, once=True).awaitTermination(120)
    state = {r.id: (r.status, r.queue.batch if r.queue else None) for r in tables.current(spark, items).collect()}
    assert state["m1"] == ("done", None) and state["m7"] == ("idle", None) and all(state[f"m{i}"][0] == "queued" for i in (0, 2, 3, 4, 5, 6))
    assert state["m2"][1] == 0 and state["m6"][1] == 2
