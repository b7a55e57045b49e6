import random

import corpus_pipeline
import numpy as np
import pytest

from triagelake.llm import similar_texts as st


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else frozenset()


def brute_kept(rows, similarity=0.8):
    """The identifiers that stay: the least of what is linked by exact similarity."""
    sets = {i: grams(t) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = sets[a], sets[b]
            if x == y or 10 * len(x & y) >= round(10 * similarity) * len(x | y) > 0:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {find(i) for i in ids}


@pytest.mark.parametrize("at", ["sf0.001", "sf0.01"])
def test_stage_drops_what_is_similar(spark, at):
    docs = spark.read.parquet(f"/root/testdata/{at}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = corpus_pipeline.near_dedup(spark, docs, f"/root/testdata/{at}")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(brute_kept(rows))


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(st, "BLOCK_BYTES", 4096)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(100)]
    rows = [(i, " ".join([*words[: rng.randint(80, 100)], *[f"x{rng.randint(0, 9)}" for _ in range(rng.randint(0, 9))]])) for i in range(60)]
    kept = st.keep_first_similar(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r.doc_id for r in kept.collect()} == brute_kept(rows)


def test_similar_odd(odd, no_rows):
    kept = st.keep_first_similar(odd).collect()
    assert sum(not (r.text or "").strip() for r in kept) == 1 and sum(r.doc_id == 9 for r in kept) == 1
    assert st.keep_first_similar(no_rows).collect() == []


def test_links_are_those_of_the_similarity():
    sets = [np.arange(a, a + 20, dtype=np.uint64).tobytes() for a in (0, 1, 2, 3, 40, 41)] + [b""]
    f = np.arange(7)
    assert len(st.similar_links(f, sets, 0.8)) == 4 and st.similar_links(f, sets, 0.95) == []
