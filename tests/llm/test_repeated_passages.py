import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from triagelake.llm import repeated_passages as rp
from triagelake.llm.queries import queries

from .conftest import ODD


CONTRACT = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def brute(docs, least):
    """By the text of every window."""
    seen = Counter()
    for _, t in docs:
        b = (t or "").encode()
        seen.update(hashlib.blake2b(b[i : i + least], digest_size=16).digest() for i in range(len(b) - least + 1))
    out = []
    for i, t in docs:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - least + 1):
            if seen[hashlib.blake2b(b[s : s + least], digest_size=16).digest()] > 1:
                gone[s : s + least] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def test_query_equals_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = Counter(tuple(r)[:5] for r in queries()["op3_suffix_sort"](spark, sf).collect())
    assert got == brute(docs, 400)
    assert any(0 < r[2] < r[1] for r in got)


def random_docs(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    passages = [" ".join(word() for _ in range(rng.randint(5, 60))) for _ in range(8)]
    docs = []
    for i in range(150):
        t = " ".join(rng.choice([word(), rng.choice(passages), "xy" * rng.randint(1, 40)]) for _ in range(rng.randint(0, 12)))
        docs.append((i, t if rng.random() < 0.9 else (docs[-1][1] if docs else "")))
    return docs + [(500, None), (501, ""), (502, "q" * 700), (None, passages[0] + passages[1])]


@pytest.mark.parametrize("limit", [1000, 3, 30])
def test_random_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(rp, "SORT_BYTES", 3000)
    docs = random_docs(limit)
    df = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, row int").repartition(3)
    got = Counter(tuple(r) for r in rp.remove_repeats(df, least=40, gram=12, limit=limit, reach=30).select(*CONTRACT).collect())
    assert got == brute(docs, 40)


def test_odd(odd, no_rows):
    assert Counter(tuple(r) for r in rp.remove_repeats(odd).select(*CONTRACT).collect()) == brute(ODD, 400)
    assert rp.remove_repeats(no_rows).collect() == []


def test_segments_and_collisions(monkeypatch):
    rng = random.Random(9)
    data = bytes(rng.choice(b"ab") for _ in range(5000))
    whole = rp.anchors(data, 60, 20)
    monkeypatch.setattr(rp, "SEGMENT", 700)
    parts = rp.anchors(data, 60, 20)
    owner = lambda a: np.repeat(a[0], np.diff(np.append(a[1], len(data) - 59)))
    assert (owner(whole) == owner(parts)).all()
    groups = [[(bytes(rng.choice(b"ab") for _ in range(30)) + b"G" + bytes(rng.choice(b"ab") for _ in range(n)), 30) for n in (20, 30, 40, 30, 5)] for _ in range(20)]
    groups = [list(dict.fromkeys(g)) for g in groups]
    right = rp.repeats(groups, 6)
    monkeypatch.setattr(rp, "_prefix", lambda data, powers: np.zeros(len(data) + 1, np.uint64))  # all hashes collide
    assert rp.repeats(groups, 6) == right
    assert sum(map(len, right)) > 20


def test_suffix_order():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 30))) for _ in range(100)]
    at = np.array([rng.randint(0, len(t)) for t in texts])
    ctx = rp._Contexts(texts, at)
    order = rp.merge_sort(ctx, np.array([0, 40]), np.array([40, 60]), True).tolist()
    assert order == sorted(range(40), key=lambda e: (texts[e][at[e] :], e)) + sorted(range(40, 100), key=lambda e: (texts[e][at[e] :], e))
    order = rp.merge_sort(ctx, np.array([0]), np.array([100]), False).tolist()
    assert order == sorted(range(100), key=lambda e: (texts[e][: at[e]][::-1], e))


@pytest.mark.parametrize("limit", [1000, 5])
def test_passages_too_short_to_go_are_noted(spark, limit):
    """A passage of 330 bytes in many texts of their own words: nothing goes, all of these texts are noted."""
    rng = random.Random(5)
    own = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8))) for _ in range(n))
    passage = own(60)[:330]
    docs = [(i, own(90) + " " + passage + " " + own(90) if i < 30 else own(200)) for i in range(60)]
    rows = rp.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), limit=limit).collect()
    assert all(r.n_removed == 0 and (r.longest_shared >= 200) == (r.doc_id < 30) and r.longest_shared <= 340 for r in rows)
