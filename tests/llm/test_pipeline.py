from collections import Counter
from itertools import combinations

import corpus_pipeline
from triagelake.llm import benchmark_leaks
from triagelake.llm.common import shared_path

from .test_benchmark_leaks import words
from .test_tokens import library


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def test_stages_and_their_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    first, tables = docs, []
    for name, stage in corpus_pipeline.STAGES:
        at = shared_path(spark, name)
        stage(spark, docs, sf).write.parquet(at)
        docs = spark.read.parquet(at)
        tables.append(docs)
    toxic, near, clean, pii, coded = tables
    for t in tables[:-1]:
        assert t.columns == first.columns
    rows = lambda t: {r.doc_id: r.text for r in t.collect()}
    a, b, c, d = map(rows, (toxic, near, clean, pii))
    assert 0.7 * first.count() < len(a) <= first.count()
    # the stage's rule: groups of texts whose sets of five-word shingles reach a Jaccard similarity of 0.8
    sets = {i: shingle_set(t) for i, t in a.items()}
    root = {i: i for i in a}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(sorted(a), 2):
        x, y = sets[i], sets[j]
        if (not x and not y) or (x and y and len(x & y) >= 0.8 * len(x | y)):
            i, j = sorted((top(i), top(j)))
            root[j] = i
    assert b == {i: a[i] for i in a if root[i] == i}
    grams = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = words(r.text)
        grams |= {tuple(w[i : i + 10]) for i in range(len(w) - 9)}
    hit = lambda t: any(tuple(w[i : i + 10]) in grams for w in [words(t)] for i in range(len(w) - 9))
    assert not any(hit(t) for t in c.values()) and any(hit(t) for t in b.values())
    assert all(c.get(i) == t for i, t in b.items() if not hit(t))
    assert d.keys() == c.keys()
    tok = library("word_bpe_49k.json")
    assert {r.doc_id: (r.n_tokens, r.ids) for r in coded.collect()} == {i: (len(x), x) for i, t in d.items() for x in [tok.encode(t or "", add_special_tokens=False).ids]}
    assert Counter(map(str, corpus_pipeline.run(spark, sf).collect())) == Counter(map(str, coded.collect()))


def test_stages_on_odd_rows(spark, odd, no_rows, sf):
    for docs in (odd, no_rows):
        at = shared_path(spark, "odd")
        docs.write.parquet(at)
        docs = spark.read.parquet(at)
        for name, stage in corpus_pipeline.STAGES:
            at = shared_path(spark, name)
            stage(spark, docs, sf).write.parquet(at)
            docs = spark.read.parquet(at)
    assert docs.count() == 0
    assert benchmark_leaks.remove_leaks(benchmark_leaks.benchmark_leaks(odd, spark.read.parquet(f"{sf}/benchmark.parquet"))).count() == odd.count()
