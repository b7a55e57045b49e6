import datetime as dt
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from triagelake.llm import pseudonyms as ps
from triagelake.llm import quality_ratio as qr
from triagelake.llm import toxic_passages as tp
from triagelake.llm.queries import queries

from .conftest import ODD

BIG = "/root/testdata/sf0.1"


def labels_of(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")


# toxicity


def brute_segments(scores):
    """Ruzzo and Tompa's definition: the best segment, then the same left and right of it."""
    best, at = 0.0, None
    for i in range(len(scores)):
        s = 0.0
        for j in range(i, len(scores)):
            s += scores[j]
            if s > best + 1e-9:
                best, at = s, (i, j + 1)
    if at is None:
        return []
    a, b = at
    return brute_segments(scores[:a]) + [(round(best, 6), a, b)] + [(s, x + b, y + b) for s, x, y in brute_segments(scores[b:])]


def test_segments_equal_their_definition():
    rng = random.Random(0)
    for _ in range(300):
        scores = [rng.choice([-3, -2, -1, -0.5, 1, 2, 4]) + rng.random() / 10 for _ in range(rng.randint(0, 25))]
        assert [(round(s, 6), a, b) for s, a, b in tp.segments(np.array(scores))] == brute_segments(scores)


def test_toxicity_on_held_out_rows(spark):
    rows = queries()["op4_toxic_segments"](spark, BIG).collect()
    truth = {r.doc_id: r.toxic for r in labels_of(spark, BIG).collect()}
    assert len(rows) == 10_000 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    test = [(truth[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean([t == p for t, p in test]) > 0.97
    assert np.mean([p for t, p in test if t == 0]) < 0.01


def test_toxicity_odd(spark, odd, no_rows):
    labels = spark.createDataFrame([(i, i % 2) for i in (1, 5, 6, 7, 8, 10, 11)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    out = tp.score_toxicity(odd, labels).collect()
    assert Counter(r.doc_id for r in out) == Counter(i for i, _ in ODD)
    empty = {round(r.score, 9) for r in out if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1 and all(0 <= r.score <= 1 for r in out)
    assert tp.score_toxicity(no_rows, labels).collect() == []
    assert all(r.predicted == 0 for r in tp.score_toxicity(odd, labels.limit(0)).collect())
    assert tp.drop_toxic(odd, labels.limit(0)).columns == odd.columns


# quality


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    repeat = {i + k for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for k in range(3)}
    seen, dup = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat)


def test_quality_of_the_table(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    rows = queries()["op7_quality_ratio"](spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(docs)
    for r in rows:
        b = base(docs[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.base_failed and r.kept)
    truth = {r.doc_id: r.quality for r in labels_of(spark, "/root/testdata/sf0.01").collect()}
    judged = [(truth[r.doc_id], r.kept) for r in rows if r.doc_id in truth and not r.base_failed]
    assert np.mean([bool(q) == k for q, k in judged]) > 0.97


def test_quality_odd_and_brute_ratio(spark, odd, no_rows):
    labels = spark.createDataFrame([(1, 1), (5, 1), (8, 0), (9, 0), (6, 1), (None, 1), (7, None)], "doc_id long, quality int")
    model = qr.fit(odd, labels)
    out = {}
    for r in qr.judge(odd, labels, model=model).collect():
        out.setdefault(r.doc_id, []).append(r)
    for k, (i, t) in enumerate(ODD):
        want = base(t)
        assert any((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want for r in out[i]), t
    import pyarrow as pa
    import xxhash

    mix, top = 0x9E3779B97F4A7C15, (1 << 64) - 1
    texts = ["a b a", "", None, "one  two\nthree"]
    values = model.values(pa.array(texts))
    for t, v in zip(texts, values):
        h = [xxhash.xxh3_64_intdigest(w.encode()) for w in (t or "").split()]
        grams = h + [(((a * mix & top) ^ (b + mix & top)) * mix) & top for a, b in zip(h, h[1:])]
        want = np.mean([model.ratio[g >> 48] for g in grams]) if grams else 0
        assert v == pytest.approx(want)
    assert qr.judge(no_rows, labels).collect() == []
    assert len(qr.judge(odd, labels.limit(0)).collect()) == len(ODD)


def test_threshold():
    v, g = np.array([-1.0, 0.0, 0.5, 0.5, 2.0]), np.array([False, False, True, False, True])
    t = qr.best_threshold(v, g)
    assert 0 < t < 0.5
    assert qr.best_threshold(v, np.ones(5, bool)) == -float("inf")


def test_all_labels_count(spark):
    n = 24_000  # the last 2,000 have words of their own
    text = lambda i: f"{'good' if i % 2 else 'bad'} w{i % 97}" + f" late{i % 3}" * (i >= 22_000)
    docs = spark.createDataFrame([(i, text(i)) for i in range(n)] + [(None, "good x"), (7, "again seven"), (n + 5, "good unknown")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(n)], "doc_id int, quality int")
    model = qr.fit(docs, labels)
    import pyarrow as pa

    rows = [tuple(r) for r in docs.collect()]
    count = lambda texts: np.bincount(qr.hashed_ngrams(pa.array(texts))[0], minlength=qr.BUCKETS)
    target, raw = count([t for i, t in rows if i is not None and i < n and i % 2]), count([t for _, t in rows])
    assert np.allclose(model.ratio, np.log((target + 1) / (target.sum() + qr.BUCKETS)) - np.log((raw + 1) / (raw.sum() + qr.BUCKETS)))
    known = [(i, t) for i, t in rows if i is not None and i < n]
    values = np.round(qr.RatioModel(model.ratio.astype(np.float32), 0.0).values(pa.array([t for _, t in known])), 6)
    assert model.threshold == qr.best_threshold(values, np.array([i % 2 == 1 for i, _ in known]))


@pytest.mark.parametrize("seed", range(4))
def test_threshold_over_rows(spark, seed):
    rnd = np.random.default_rng(seed)
    g = rnd.random(3000) < [0.4, 0.02, 0.5, 1][seed]
    v = np.round(rnd.normal(0, [1, 0.001, 0, 1][seed], 3000) + 0.7 * g, 6)
    rows = spark.createDataFrame(list(zip(v.tolist(), g.tolist())), "v double, good boolean")
    assert qr.threshold_of(rows) == qr.best_threshold(v, g)


# pseudonyms

KEY = b"k" * 32


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1000])
def test_permutation_is_one_to_one(n):
    assert sorted(ps.permute(x, n, KEY, "t") for x in range(n)) == list(range(n))


def luhn(s):
    d = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d[::2] + [2 * x - 9 * (x > 4) for x in d[1::2]]) % 10 == 0


def test_formats_stay_valid():
    rng = random.Random(1)
    for _ in range(300):
        body = "".join(rng.choice("0123456789") for _ in range(15))
        card = body + ps._luhn_digit(body)
        new = ps._card(card, KEY)
        assert len(new) == 16 and luhn(new) and new != card
        spaced = " ".join(card[i : i + 4] for i in range(0, 16, 4))
        assert ps._card(spaced, KEY).replace(" ", "") == new
        d = dt.date(1950, 1, 1) + dt.timedelta(rng.randint(0, 30000))
        iso = ps._date(d.isoformat(), KEY)
        assert dt.date.fromisoformat(iso)
        assert ps._date(f"{d.day:02d}.{d.month:02d}.{d.year}", KEY) is not None
        ip = ".".join(str(rng.randint(0, 255)) for _ in range(4))
        assert all(0 <= int(x) < 256 for x in ps._ipv4(ip, KEY).split("."))
        area = rng.choice([rng.randint(1, 665), rng.randint(667, 899)])
        ssn = ps._ssn(f"{area:03d}-{rng.randint(1, 99):02d}-{rng.randint(1, 9999):04d}", KEY)
        assert re.fullmatch(r"\d{3}-\d{2}-\d{4}", ssn) and ssn[:3] not in ("000", "666") and ssn[0] != "9"
    assert ps._card("1234567890123456", KEY) is None and ps._ipv4("1.2.3.256", KEY) is None and ps._date("2024-02-30", KEY) is None
    assert ps._iban("GB82 WEST 1234 5698 7654 32", KEY) and ps._iban("GB82 WEST 1234 5698 7654 33", KEY) is None
    new = ps._iban("GB82WEST12345698765432", KEY)
    assert ps._iban(new, KEY) and new[:2] == "GB" and new[4:8].isalpha()
    new = ps._email("Ana.Diaz+7@mail.x.org", KEY)
    assert re.fullmatch(r"[A-Z][a-z]{2}\.[A-Z][a-z]{3}\+\d@[a-z]{4}\.[a-z]\.org", new) and not new.endswith(".x.org")
    assert ps._email("Bo@mail.x.org", KEY).partition("@")[2] == new.partition("@")[2]  # one host, one pseudonym


def test_values_are_found_whole_and_linked():
    text = "Ask ana.diaz@mail7.example.com, or ANA.DIAZ@mail7.example.com. +1 (017) 555-7713 is 97.51.17.173 on.4111111111111111 5500005555555559 but not 4111111111111112; token = \"9233a8ecf7c5b09fe5949719b6b82bc439e9329b\". Born 1980-02-29, 1.2.3 v2"
    found = ps.find(text, KEY)
    assert [k for _, _, k, _ in found] == ["email", "email", "phone", "ipv4", "card", "card", "secret", "date"]
    assert found[0][3].lower() == found[1][3].lower() and all(text[a:b] != new for a, b, _, new in found)
    assert ps.find("x" * 300_000 + "1" * 300_000 + "a." * 100_000, KEY) == []


def test_ibans_before_upper_case_words_and_short_dates():
    for text in ("BE68 5390 0754 7034 IN", "BE68539007547034 PLEASE", "PAY XX12 ABCD BE68 5390 0754 7034 NOW OR NEVER", "BE68 5390 0754 7034 GB82 WEST 1234 5698 7654 32 OK"):
        found = ps.find(text, KEY)
        got = [text[a:b].replace(" ", "") for a, b, k, _ in found if k == "iban"]
        assert got == ["BE68539007547034", *(["GB82WEST12345698765432"] if "GB82" in text else [])]
        assert all(ps._iban(new, KEY) and len(new) == b - a for a, b, _, new in found)
    assert ps.find("BE68 5390 0754 7035 IN", KEY) == []
    text = "1/5/2020 3.4.1987 2021-7-9 12/5/2020 01/05/2020"
    found = ps.find(text, KEY)
    assert [k for _, _, k, _ in found] == ["date"] * 5
    news = [new for _, _, _, new in found]
    parts = lambda s: list(map(int, re.split(r"[-/.]", s)))
    assert parts(news[0]) == parts(news[4]) and len(news[4]) == 10 and len({tuple(parts(x)) for x in news}) == 4
    assert all(not re.search(r"(?<!\d)0", x) for x in news[:3])
    assert ps.find("31/2/2020 1.2.3 0/5/2020 1.2.2020.7", KEY) == []


def test_pseudonyms_of_the_table(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = queries()["op8_feistel_pseudonyms"](spark, sf).collect()
    assert len(rows) == len(docs) and sum(r.n_email + r.n_phone + r.n_ipv4 + r.n_card + r.n_secret for r in rows) > 5
    for r in rows:
        old = docs[r.doc_id]
        for m in re.finditer(r"\S+@\S+\.com|\b[0-9a-f]{40}\b|\+1 \(\d{3}\) \d{3}-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b", old):
            if not (m[0].isdigit() and not luhn(m[0])):
                assert m[0] not in r.text
        assert len(old.split()) == len(r.text.split())
        if not any(getattr(r, f"n_{k}") for k, *_ in ps.KINDS):
            assert r.text == old


def test_pseudonyms_odd(odd, no_rows):
    out = ps.pseudonymise(odd, "key")
    assert out.columns == odd.columns and Counter((r.doc_id, r.text) for r in out.collect()) == Counter(ODD)
    assert ps.pseudonymise(no_rows, "key").collect() == []


@pytest.mark.parametrize("n", [2, 3, 10, 97, 256, 1000])
def test_no_value_stays_itself(n):
    out = [ps.permute(x, n, KEY, "t") for x in range(n)]
    assert sorted(out) == list(range(n)) and all(x != y for x, y in enumerate(out))
    assert [ps.feistel(ps.feistel(x, n, KEY, "t"), n, KEY, "t", back=True) for x in range(n)] == list(range(n))
    assert ps.permute(0, 1, KEY, "t") == 0


def test_many_values_of_one_text():
    """Values are found as by trying each match against all that were taken."""
    rng = random.Random(3)
    kinds = ["10.0.0.{}", "4111111111111111", "2020-01-{:02d}", "a{}@b.org", "+1 (017) 555-77{:02d}", "word"]
    text = " ".join(rng.choice(kinds).format(rng.randint(10, 28)) for _ in range(600))
    taken = []
    for kind, pattern, _, make in ps._COMPILED:
        for m in pattern.finditer(text):
            if all(m.end() <= a or b <= m.start() for a, b, *_ in taken) and make(m[0], KEY) is not None:
                taken.append((m.start(), m.end(), kind, make(m[0], KEY)))
    assert ps.find(text, KEY) == sorted(taken) and len(taken) > 400


def test_log_odds_equal_their_definition(spark):
    """The classifier's scores from the training rows, feature by feature."""
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), labels_of(spark, BIG)
    train = [(r.text, r.toxic) for r in tp.training_rows(docs, labels).collect()]
    known = {r.doc_id: r.toxic for r in labels.collect()}
    assert len(train) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in known)
    counts = {}
    for text, toxic in train:
        here = Counter()
        for w, n in Counter(tp.words(text)).items():
            n = min(n, tp.PER_TEXT)
            here[""] += n
            for f in tp.features(w):
                here[f] += n
        for f, n in here.items():
            counts.setdefault(f, [0, 0])[toxic] += min(n, tp.PER_TEXT) if f else n
    n0, n1 = counts.pop("")
    weight = tp.PRIOR * (n0 + n1)
    want = {}
    for f, (c, t) in counts.items():
        prior = tp.PRIOR * (c + t)
        a, b = t + prior, c + prior
        odds = np.log(a / (n1 + weight - a)) - np.log(b / (n0 + weight - b))
        if abs(z := odds / np.sqrt(1 / a + 1 / b)) >= tp.SIGNIFICANT_Z:
            want[f] = (z, odds)
    model = tp.fit(docs, labels)
    assert len(want) <= tp.FEATURES and model.scores.keys() == want.keys()
    assert all(np.allclose(model.scores[f], want[f]) for f in want)
    # and every score of the query follows from the best segments by their definition
    rows = {r.doc_id: r.score for r in tp.score_toxicity(docs.where("doc_id < 150 and n_chars < 900"), labels).collect()}
    again = tp.fit(docs.where("doc_id < 150 and n_chars < 900"), labels)
    for r in docs.where("doc_id < 150 and n_chars < 900").collect():
        seq = tp.words(r.text)
        shift = again.log_k + np.log(max(len(seq), 1))
        found = sorted(((again.scale * s - shift, a, b) for s, a, b in brute_segments([again.word_score(w) for w in seq])), reverse=True)
        assert rows[r.doc_id] == pytest.approx(again.score(again.evidence(found)), abs=1e-4)


def test_verdicts_of_the_whole_table(spark, sf):
    """Every row's ratio, threshold and verdict by plain loops over words."""
    import xxhash

    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    good = {r.doc_id: r.quality > 0 for r in labels_of(spark, sf).collect()}
    mix, mask = 0x9E3779B97F4A7C15, (1 << 64) - 1

    def buckets(text):
        h = [xxhash.xxh3_64_intdigest(w) for w in text.encode().split()]
        two = [((((x * mix) & mask) ^ ((y + mix) & mask)) * mix) & mask for x, y in zip(h, h[1:])]
        return [x >> 48 for x in h + two]

    grams = {i: buckets(t) for i, t in docs.items()}
    raw, target = Counter(x for g in grams.values() for x in g), Counter(x for i, g in grams.items() if good.get(i) for x in g)
    n, m = sum(raw.values()), sum(target.values())
    ratio = lambda x: np.float32(np.log((target[x] + 1) / (m + qr.BUCKETS)) - np.log((raw[x] + 1) / (n + qr.BUCKETS)))
    value = {i: round(float(np.sum([ratio(x) for x in g], dtype=float)) / max(len(g), 1), 6) for i, g in grams.items()}
    known = [i for i in docs if i in good]
    threshold = qr.best_threshold(np.array([value[i] for i in known]), np.array([good[i] for i in known]))
    rows = queries()["op7_quality_ratio"](spark, sf).collect()
    assert list(rows[0].asDict())[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert len(rows) == len(docs)
    for r in rows:
        assert r.log_ratio == pytest.approx(value[r.doc_id], abs=2e-6)
        if abs(value[r.doc_id] - threshold) > 1e-5:
            assert r.kept == (not r.base_failed and value[r.doc_id] >= threshold)
