import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from triagelake.llm import balanced_shards as shards
from triagelake.llm import near_duplicates as near
from triagelake.llm.components import components
from triagelake.llm.queries import queries

from .conftest import ODD


def check_shards(rows, docs, k):
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    slots, load, of = defaultdict(list), [0] * k, {}
    for r in rows:
        slots[r.shard].append(r.slot)
        load[r.shard] += r.size
        assert of.setdefault((r.size, r.text_crc32), r.shard) == r.shard
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < k
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return load


def test_shards_of_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    load = check_shards(queries()["op1_karmarkar_karp"](spark, sf).collect(), docs, 16)
    assert max(load) <= 1.005 * max(sum(load) / 16, max(len(t.encode()) + 1 for _, t in docs))


def test_odd_shards(odd, no_rows):
    check_shards(shards.balanced_shards(odd, 3).collect(), ODD, 3)
    assert shards.balanced_shards(no_rows).collect() == []


def test_levels_and_a_heavy_group(spark, monkeypatch):
    for name, v in (("BUCKET_ITEMS", 40), ("BUNDLES", 8), ("DRIVER_ITEMS", 60), ("SLOT_ROWS", 100)):
        monkeypatch.setattr(shards, name, v)
    rng = random.Random(1)
    docs = [(i, "z" * rng.randint(1, 400) + str(i)) for i in range(900)] + [(10_000 + i, "copy" * 90) for i in range(300)]
    load = check_shards(shards.balanced_shards(spark.createDataFrame(docs, "doc_id long, text string"), 16).collect(), docs, 16)
    heavy = 300 * 361
    rest = sorted(load)[:-1]
    assert max(load) == heavy and max(rest) - min(rest) < 400


def test_differencing():
    part = shards.difference([8, 7, 6, 5, 4], 2)
    sums = [sum(w for w, p in zip([8, 7, 6, 5, 4], part) if p == k) for k in (0, 1)]
    assert sorted(sums) == [14, 16]
    rng = random.Random(2)
    w = [rng.randint(1, 10**6) for _ in range(3000)]
    load = [0] * 16
    for x, p in zip(w, shards.difference(w, 16)):
        load[p] += x
    assert max(load) - min(load) < 10
    start = [5000, 0, 100]
    load = list(start)
    for x, p in zip([10] * 900, shards.difference([10] * 900, 3, start)):
        load[p] += 10
    assert load[0] == 5000 and abs(load[1] - load[2]) <= 10


def fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g.encode(), 42) >> b & 1)
    return sum(1 << b for b in range(64) if 2 * votes[b] > len(grams))


def brute_components(fps, radius=3):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    fs = list(parent)
    for i, a in enumerate(fs):
        for b in fs[:i]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {f: find(f) for f in fs}


def check_near(rows, docs):
    fp = [(i, fingerprint(t)) for i, t in docs]
    root = brute_components({f for _, f in fp})
    least = {}
    for i, f in fp:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in rows) == Counter((i, f"{f:016x}", least.get(root[f])) for i, f in fp)
    return root


def test_near_duplicates_of_the_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    root = check_near(queries()["op2_simhash_pigeonhole"](spark, sf).collect(), docs)
    assert len(set(root.values())) < len(docs)


def test_near_duplicates_odd(spark, odd, no_rows):
    check_near(near.near_duplicates(odd).collect(), ODD)
    assert near.near_duplicates(no_rows).collect() == []
    kept = near.keep_first(odd).collect()
    assert odd.columns == near.keep_first(odd).columns and len(kept) == len({fingerprint(t) for _, t in ODD}) and {2} == {r.doc_id for r in kept if not (r.text or "").strip()}
    assert near.keep_first(no_rows).collect() == []


@pytest.mark.parametrize("block", [8192, 30])
def test_links_of_dense_clusters(spark, monkeypatch, block):
    monkeypatch.setattr(near, "BLOCK", block)
    rng = random.Random(3)
    fps = {rng.getrandbits(64) for _ in range(300)} | {0, (1 << 64) - 1}
    for c in list(fps)[:4]:
        for _ in range(150):
            x = c
            for _ in range(rng.randint(0, 6)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    root = brute_components(fps)
    df = spark.createDataFrame([(near._signed(f),) for f in fps], "f long")
    links = near.fingerprint_links(df)
    got = {r.node % (1 << 64): r.component for r in components(links).collect()}
    sets = lambda m: {frozenset(k for k in m if m[k] == v) for v in set(m.values())}
    assert sets(got) == {s for s in sets(root) if len(s) > 1}
    assert all(((r.a ^ r.b) % (1 << 64)).bit_count() <= 3 for r in links.collect())


def test_thresholds_follow_the_pigeonhole_sum():
    rng = np.random.default_rng(0)
    bits = (rng.random((500, 64)) < 0.5).astype(float)
    for n in (500, 10**6, 10**10):
        plan = near.allocate(n, bits.T @ bits * (n / 500))
        used = [b for part, _ in plan for b in part]
        assert len(used) == len(set(used)) and all(t >= 0 for _, t in plan)
        # every error pattern of three bits leaves some partition within its threshold
        for _ in range(300):
            e = set(rng.choice(64, 3, replace=False).tolist())
            assert any(len(e & set(part)) <= t for part, t in plan)


def test_no_column_is_lost(spark, sf):
    """Columns with the names of internal ones come back as they were, and identifiers may be texts."""
    from triagelake.llm import benchmark_leaks, repeated_passages, similar_texts, toxic_passages

    names = ["key", "id", "sha", "rows", "__key", "__id", "__toxicity", "__block_leaks_0", "runs", "items", "f", "bands", "size"]
    rows = [(f"d{i}", t, *[f"{n}{i}" for n in names]) for i, t in enumerate(["same text of some words here"] * 3 + ["x" * 900, "x" * 900, None, "", "another text of other words"])]
    docs = spark.createDataFrame(rows, "doc_id string, text string, " + ", ".join(f"`{n}` string" for n in names))
    whole = lambda df: sorted(map(tuple, df.collect()), key=str)
    firsts = [r for r in rows if r[0] in ("d0", "d3", "d5", "d7")]
    assert whole(near.keep_first(docs)) == sorted(firsts, key=str) and near.keep_first(docs).columns == docs.columns
    assert whole(similar_texts.keep_first_similar(docs)) == sorted(firsts, key=str)
    labels = spark.createDataFrame([], "doc_id string, toxic int")
    assert whole(toxic_passages.drop_toxic(docs, labels)) == sorted(rows, key=str)
    items = spark.createDataFrame([("i", "some words here"), (None, "other words"), ("", "text of other words")], "item_id string, text string")
    for block in (1 << 20, 20):
        found = benchmark_leaks.benchmark_leaks(docs, items, block_bytes=block)
        assert found.columns == [*docs.columns, "leaks"] and whole(found.drop("leaks")) == sorted(rows, key=str)
        assert {r.doc_id: (r.leaks.n_words, r.leaks.n_hit, r.leaks.n_items) for r in found.collect()} == {"d0": (6, 3, 1), "d1": (6, 3, 1), "d2": (6, 3, 1), "d3": (1, 0, 0), "d4": (1, 0, 0), "d5": (0, 0, 0), "d6": (0, 0, 0), "d7": (5, 4, 2)}
    gone = {r.doc_id: r.n_removed for r in repeated_passages.remove_repeats(docs).collect()}
    assert gone == {**{f"d{i}": 0 for i in range(8)}, "d3": 900, "d4": 900}
