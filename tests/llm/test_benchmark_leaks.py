import hashlib
import random
import re

from triagelake.llm import benchmark_leaks as leaks
from triagelake.llm.queries import queries

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(text, items, n=10):
    seq = words(text)
    hit, found = set(), set()
    for item, t in items:
        w = words(t)
        for win in {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else ():
            for i in range(len(seq) - len(win) + 1):
                if tuple(seq[i : i + len(win)]) == win:
                    hit.update(range(i, i + len(win)))
                    found.add(str(item))
    return len(seq), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_query_equals_brute_force(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    grams = {}
    for item, t in items:
        w = words(t)
        assert len(w) >= 10
        for i in range(len(w) - 9):
            grams.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    dirty = 0
    for r in queries()["op6_suffix_automaton"](spark, sf).collect():
        seq, hit, found = words(docs[r.doc_id]), set(), set()
        for i in range(len(seq) - 9):
            if g := grams.get(tuple(seq[i : i + 10])):
                hit.update(range(i, i + 10))
                found |= g
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == (len(seq), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
        dirty += r.contaminated
    assert dirty


def test_random_texts_with_short_items_and_blocks(spark):
    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice("a b c") for _ in range(n))
    items = [(k, text(rng.choice([1, 2, 3, 5, 9, 10, 11, 14, 30]))) for k in range(12)] + [(99, ""), (98, None), (97, "..."), (None, "a b c a b c a b c a b c")]
    items = [x for x in items if x[1] is None or len(words(x[1])) > 3 or not words(x[1])]
    docs = [(k, text(rng.randint(0, 120)).replace("a", rng.choice(["a", "A", "é"]))) for k in range(60)] + [(None, None), (70, "")]
    d = spark.createDataFrame([(*x, 0) for x in docs], "doc_id long, text string, leaks int").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for block in (1 << 20, 200):
        out = leaks.benchmark_leaks(d, b, block_bytes=block).collect()
        assert len(out) == len(docs)
        for r in out:
            want = brute(r.text, [("" if i is None else i, t) for i, t in items])
            assert (r.leaks.n_words, r.leaks.n_hit, r.leaks.n_items, r.leaks.items_sha256) == want
            runs = r.leaks.runs
            assert sum(runs[1::2]) - sum(runs[::2]) == r.leaks.n_hit and runs == sorted(runs)
    assert leaks.benchmark_leaks(d.limit(0), b).collect() == []
    assert all(r.leaks.n_hit == 0 for r in leaks.benchmark_leaks(d, b.limit(0)).collect())


def test_removal(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, f"Start here, {passage.upper()}; then the end. " + "clean words go on " * 5), (2, passage), (3, "nothing at all"), (4, None)], "doc_id long, text string")
    out = {r.doc_id: r.text for r in leaks.remove_leaks(leaks.benchmark_leaks(docs, spark.createDataFrame([(1, passage)], "item_id long, text string"))).collect()}
    assert 2 not in out and out[3] == "nothing at all" and out[4] is None
    assert out[1].startswith("Start here, ; then the end. clean") and "eleven" not in out[1].lower()


def test_the_stage_cuts_short_items(spark, tmp_path):
    import corpus_pipeline

    items = [("short", "which planet is red"), ("long", " ".join(f"q{k}" for k in range(12)))]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rest = " ".join(f"w{k}" for k in range(20))
    texts = [f"{rest} Which planet is RED? {rest}", f"{rest} {items[1][1]} {rest}", f"{rest} planet is red {rest}"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in corpus_pipeline.decontaminate(spark, docs, str(tmp_path)).collect()}
    assert out == {0: f"{rest} ? {rest}", 1: f"{rest}  {rest}", 2: texts[2]}
