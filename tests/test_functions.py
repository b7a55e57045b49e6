"""Text, dates, answers and bytes, on literal cases."""

import datetime as dt
import random
import struct
import zlib

from pyspark.sql import functions as F

from triagelake.functions import answers as an
from triagelake.functions import binary, dates, geometry
from triagelake.functions import text as tx


def one(spark, *cols):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


def lit(x):
    return F.lit(x)


def test_clean_squeeze_strip(spark):
    got = one(
        spark,
        tx.clean(lit("a\r\n\tb—c–d “q” ‘r’ \x01x")),
        tx.clean(lit(None)),
        tx.squeeze(lit("  a \t\x0b b\n \n\n c\x0c ")),
        tx.strip(lit("\u2003 x\x1f\u00a0")),
        tx.domain(lit("A <a@B.com ")),
        tx.domain(lit("noat")),
        tx.domain(lit(None)),
        tx.domain(lit("x@y@sub.Known.com")),
    )
    assert got == ("a   b-c-d \"q\" 'r' x", "", "a b\n c", "x", "b.com", "noat", "", "sub.known.com")


def test_names_numbers_percents(spark):
    got = one(
        spark,
        *[tx.first_name(lit(x)) for x in ("Dr. Ana Diaz", "Purchasing Team", "", None, "a@b.c", "mrs Bo, Jr.", "  Zoë ")],
        *[tx.number(lit(x)) for x in ("1,250", "$4.50", "x", None)],
        *[tx.pct(lit(x)) for x in (0.125, 0.135, 0.5, 1.0)],
        tx.pct(lit(None).cast("double")),
        tx.quantity_list(F.array(lit(10.0), lit(25.0), lit(1000.0))),
        tx.quantity_list(lit(None).cast("array<double>")),
    )
    assert got == ("Ana", "there", "there", "there", "there", "Bo", "Zoë", 1250.0, 4.5, 0.0, 0.0, "12%", "14%", "50%", "100%", "n/a", "10 / 25 / 1,000", "NOT STATED")


def test_percent_is_half_even_like_python(spark):
    xs = [random.Random(0).random() for _ in range(2000)] + [i / 200 for i in range(201)]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", tx.pct(F.col("x")).alias("p")).collect()
    assert all(r.p == f"{round(r.x * 100)}%" for r in rows)


def test_file_names(spark):
    cases = [("../../etc/passwd", "png", "passwd.png"), ("C:\\Users\\x\\scan.PDF", "pdf", "scan.PDF"), ('bad"<name>.jpg', "jpg", "badname.jpg"), (None, "pdf", "upload.pdf"), ("a.jpeg", "jpg", "a.jpeg"), ("report.docx", "pdf", "report.pdf")]
    for name, media, want in cases:
        assert one(spark, tx.safe_filename(lit(name).cast("string"), lit(media))) == (want,)
    (long,) = one(spark, tx.safe_filename(lit("x" * 300 + ".pdf"), lit("pdf")))
    assert long == "x" * 92 + ".pdf"


def test_tidy_lines(spark):
    assert one(spark, tx.tidy_lines(lit("8\n8\nD D\nMATERIAL: 6061-T6\nA RELEASED TW\n12"))) == ("MATERIAL: 6061-T6\nA RELEASED TW",)
    assert one(spark, tx.tidy_lines(lit(None))) == ("",)


def test_business_days_equal_a_loop(spark):
    def loop(day, n):
        while n:
            day += dt.timedelta(days=1)
            n -= day.weekday() < 5
        return day

    cases = [(dt.date(2026, 9, 1) + dt.timedelta(days=i), n) for i in range(14) for n in range(1, 15)]
    rows = spark.createDataFrame(cases, "d date, n int").select("d", "n", dates.add_business_days(F.col("d"), F.col("n")).alias("due"), dates.friendly_date(F.col("d"), F.lit(dt.date(2026, 9, 4))).alias("f")).collect()
    assert all(r.due == loop(r.d, r.n) for r in rows)
    said = {r.d: r.f for r in rows}
    assert said[dt.date(2026, 9, 4)] == "today" and said[dt.date(2026, 9, 5)] == "tomorrow" and said[dt.date(2026, 9, 7)] == "Mon, Sep 7"


def probs(*ps, keys=("new_rfq", "quote_revision", "purchase_order", "order_followup", "vendor_or_solicitation", "other")):
    return F.array(*[F.struct(F.lit(k).alias("key"), F.lit(float(p)).alias("p")) for k, p in zip(keys, ps)])


def test_answers(spark):
    none = F.lit(None).cast("array<struct<key:string,p:double>>")
    got = one(
        spark,
        an.best_option(probs(0.3, 0.3, 0.2)),
        an.confidence(probs(0.92, 0.02, 0.02, 0.02, 0.01, 0.01)),
        an.confidence(probs(0.4)),
        an.confidence(none),
        an.pair(probs(0.02, 0.02, 0.46, 0.46, 0.02, 0.02))["confidence"],
        an.pair(probs(0.46, 0.02, 0.46, 0.02, 0.02, 0.02)),
        an.pair(probs(1.0)),
        an.expected_score(probs(0.1, 0.2, 0.3, 0.4, keys="0123")),
        an.top_two(probs(0.2, 0.2, 0.2), {"new_rfq": "New RFQ"}),
        an.top_two(none, {}),
    )
    assert got[0] == "new_rfq" and got[1] == max(0.0, min(1.0, (6 * 0.92 - 1) / 5)) and got[2:4] == (1.0, None)
    assert got[4] == (6 * 0.92 - 1) / 5 and got[5] is None and got[6] is None
    assert got[7] == 0 + 0.2 + 2 * 0.3 + 3 * 0.4 and got[8] == "New RFQ 20% vs quote_revision 20%" and got[9] == ""


def test_raw_answers_are_completed(spark):
    raw = F.struct(F.lit(None).cast("string").alias("choice"), F.lit(None).cast("double").alias("confidence"), probs(0.2, 0.8).alias("probabilities"))
    score = F.struct(F.lit(None).cast("double").alias("score"), F.lit(0.5).alias("confidence"), probs(0.5, 0.5, keys="01").alias("probabilities"), F.lit(None).cast("map<string,string>").alias("legend"))
    noul = F.struct(F.lit(None).cast("double").alias("noul"), F.lit(0.25).alias("probability"))
    c, s, n = one(spark, an.normal_choice(raw), an.normal_score(score, F.array(F.lit("low"), F.lit("high"))), an.normal_noul(noul))
    assert (c.choice, c.p, c.confidence_estimated) == ("quote_revision", 0.8, True) and abs(c.confidence - 0.6) < 1e-12
    assert (s.score, s.confidence, s.confidence_estimated, s.legend) == (0.5, 0.5, False, {"0": "low", "1": "high"}) and n.p == 0.25


def png(w, h):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 0, 0, 0, 0)) + chunk(b"IEND", b"")


def jpeg(w, h):
    return b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + b"JFIF\0" + b"\0" * 9 + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, h, w) + b"\1\1\x11\0" + b"\xff\xd9"


def test_bytes(spark):
    cases = [(png(33, 21), "png", (33, 21)), (jpeg(640, 480), "jpg", (640, 480)), (b"%PDF-1.4", "pdf", None), (b" " * 1000 + b"%PDF-", "pdf", None), (b"<html>", None, None), (b"", None, None), (b"\xff\xd8\xff\xe0\0", "jpg", None)]
    rows = spark.createDataFrame([(i, bytearray(c[0])) for i, c in enumerate(cases)], "i int, b binary").withColumn("m", binary.sniff(F.col("b")))
    for r in rows.select("i", "m", binary.image_size(F.col("b"), F.col("m")).alias("s")).collect():
        _, media, size = cases[r.i]
        assert r.m == media and (None if r.s is None or r.s.width is None else (r.s.width, r.s.height)) == size


def test_sizes_in_words(spark):
    size = lambda *d: F.array(*map(F.lit, d)) if d else F.lit(None).cast("array<double>")
    got = one(
        spark,
        geometry.size_phrase(size(2.0, 1.0, 1.5), lit("bushing"), lit("in")),
        geometry.size_phrase(size(0.25, 3.0), lit("disc"), lit(None).cast("string")),
        geometry.size_phrase(size(), lit("plate"), lit("in")),
        geometry.bbox_phrase(size(100.0, 2.25, 99.96), lit("block"), lit("mm")),
        geometry.bbox_phrase(size(5.0, 2.0), lit("shaft"), lit("in")),
    )
    assert got == ("Ø1.000 OD x Ø.500 ID x 2.000 LONG (IN)", "Ø3.000 x .250 THICK (IN)", "4.000 x 3.000 x 1.000 (IN)", "100 x 2.2 x 100 MM", "5.000 x 2.000 x 2.000 IN")
