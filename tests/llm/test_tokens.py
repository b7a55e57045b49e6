import hashlib
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from triagelake.llm import pair_bpe, sorted_tables, token_counts
from triagelake.llm.common import shared_path, tokenizer_path
from triagelake.llm.queries import queries

from .conftest import ODD


def library(name):
    return Tokenizer.from_file(tokenizer_path(name))


def documents(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_token_counts_equal_the_library(spark, sf):
    tok, docs = library("byte_bpe_50k.json"), documents(spark, sf)
    rows = queries()["op10_token_counts"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        n = len(tok.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_tokens, r.over_limit, r.n_bytes) == (n, n > 512, len(docs[r.doc_id].encode()))


def test_token_counts_of_odd_texts(odd, no_rows):
    tok = library("byte_bpe_50k.json")
    got = {r["rank"]: r.n_tokens for r in token_counts.token_counts(odd).collect()}
    assert got == {k: len(tok.encode(t or "", add_special_tokens=False).ids) for k, (_, t) in enumerate(ODD)}
    assert token_counts.token_counts(no_rows).collect() == []


def test_long_texts_are_cut_at_safe_boundaries():
    enc = token_counts.encoder(tokenizer_path("byte_bpe_50k.json"))
    text = "Some words, some  gaps\n and a <|endoftext|> here. " * 500
    pieces = token_counts.safe_pieces(text, 1000, enc.special)
    assert "".join(pieces) == text and len(pieces) > 10
    assert sum(len(x) for x in enc.library(pieces)) == len(enc.library([text])[0])
    import pyarrow as pa

    assert token_counts.count_tokens(pa.array([text, None, text]), enc, 500, 700).tolist() == [len(enc.library([text])[0]), 0, len(enc.library([text])[0])]


def digest(tok, text):
    ids = tok.encode(text or "", add_special_tokens=False).ids
    decoded = tok.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_pair_bpe_equals_the_library(spark, sf):
    tok, docs = library("word_bpe_49k.json"), documents(spark, sf)
    rows = queries()["op5_pair_index_bpe"](spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digest(tok, docs[r.doc_id])


def test_pair_bpe_on_odd_texts(odd, no_rows):
    tok = library("word_bpe_49k.json")
    got = {r["rank"]: (r.c.n_tokens, r.c.ids_sha256, r.c.decoded_sha256) for r in odd.select("rank", pair_bpe.bpe_digests(odd.text).alias("c")).collect()}
    for k, (_, t) in enumerate(ODD):
        assert got[k] == digest(tok, t), t
    assert pair_bpe.bpe_table(no_rows).collect() == []
    back = odd.select("rank", pair_bpe.bpe_decode(pair_bpe.bpe_encode(odd.text)).alias("d")).collect()
    assert {r["rank"]: r.d for r in back} == {k: tok.decode(tok.encode(t or "", add_special_tokens=False).ids, skip_special_tokens=False) for k, (_, t) in enumerate(ODD)}


def test_pair_bpe_with_separators_and_special_strings(spark):
    tok = library("word_bpe_49k.json")
    texts = ["a \x1c b<|endoftext|>", "<|startoftext|>x\x1fy \x1d\x1e<|endoftext|> \x0b z\u0085w\u00a0v \u2003u\u2028t<|endoftext|>", "a \x1c b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pair_bpe.bpe_table(docs).collect()}
    assert got == {k: digest(tok, t) for k, t in enumerate(texts)}


def test_pair_index_merges_words_together():
    bpe, tok = pair_bpe.PairIndexBPE(tokenizer_path("word_bpe_49k.json")), library("word_bpe_49k.json")
    words = ["aaaaaaa", "banana", "b", "ananas", "thethethe", "aaaa"]
    flat, counts = bpe.merge_words([w.encode() for w in words])
    assert [x.tolist() for x in np.split(flat, np.cumsum(counts)[:-1])] == [tok.encode(w, add_special_tokens=False).ids for w in words]


def test_what_is_kept_is_bounded_by_bytes():
    import pyarrow as pa

    store = token_counts.ChunkStore(1000)
    asked = []

    def encode(chunks):
        asked.append(len(chunks))
        return np.array([ord(c[0]) for c in chunks.to_pylist()], np.uint32), np.ones(len(chunks), np.int64)

    for chunks in (["a", "b"], ["b", "c", "b"], [chr(200 + i) for i in range(80)], ["a", "b"], []):
        flat, counts = store.ids(pa.array(chunks, pa.large_string()), encode)
        assert flat.tolist() == [ord(c) for c in chunks] and counts.tolist() == [1] * len(chunks)
    assert asked == [2, 1, 80, 2]


def expected_tables(rows):
    tok = library("byte_bpe_50k.json")
    out, start = [], 0
    for doc_id, text in rows:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_sorted_tables_equal_brute_force(spark, sf):
    docs = documents(spark, sf)
    rows = [tuple(r) for r in queries()["op9_sorted_tables"](spark, sf).orderBy("doc_id").collect()]
    assert rows == expected_tables(sorted(docs.items()))


def test_sorted_tables_odd(spark, odd, no_rows):
    to = shared_path(spark, "sst")
    manifest = sorted_tables.write_tables(odd, to, shards=3)
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in sorted_tables.read_tables(spark, to).collect())
    starts = [g[0] for g in got]
    assert starts == [0, *np.cumsum([g[2] for g in got]).tolist()[:-1]]
    ids = [g[1] for g in got]
    assert ids[0] is None and ids[1:] == sorted(i for i, _ in ODD if i is not None)
    assert sorted((g[2], g[3]) for g in got) == sorted((e[2], e[3]) for e in expected_tables(ODD))
    store, root = sorted_tables._store(to)
    found = 0
    for m in manifest:
        with store.open_input_file(f"{root}/{m['file']}") as f:
            reader = sorted_tables.TableReader(f)
            found += len(reader.get(9)) + len(reader.get(None)) + len(reader.get(1))
            assert reader.get(77) == []
    assert found == 4
    to = shared_path(spark, "sst")
    assert sorted_tables.write_tables(no_rows, to) == []
    assert sorted_tables.read_tables(spark, to).collect() == []


def test_a_damaged_block_is_noticed(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    at = str(tmp_path / "a.sst")
    w = sorted_tables.TableWriter(local.open_output_stream(at), 4)
    for i in range(-5, 2000):
        w.add(sorted_tables.key_of(i), np.arange(i % 50, dtype=np.uint32))
    w.close()
    with local.open_input_file(at) as f:
        r = sorted_tables.TableReader(f)
        assert [k for k, _, _ in r] == list(range(-5, 2000))
        assert len(r.get(1234)[0]) == 1234 % 50 and len(r.firsts) > 1
    data = bytearray(open(at, "rb").read())
    data[20] ^= 1
    open(at, "wb").write(data)
    with local.open_input_file(at) as f, pytest.raises(ValueError):
        list(sorted_tables.TableReader(f))


def test_shards_of_text_identifiers(spark):
    rows = [("b", "one two"), ("a", "three"), (None, "none"), ("é", ""), ("b", "four five six"), ("", None)]
    at = shared_path(spark, "text-ids")
    sorted_tables.write_tables(spark.createDataFrame(rows, "doc_id string, text string"), at, shards=2)
    got = sorted_tables.read_tables(spark, at).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None, "", "a", "b", "b", "é"]
    assert [r.start for r in got] == list(np.cumsum([0, *[r.n_tokens for r in got]])[:-1]) and sum(r.n_tokens for r in got) == len(got) + 7


def test_ids_of_a_table(spark, odd):
    tok = library("word_bpe_49k.json")
    got = {(r.doc_id, tuple(r.ids)) for r in pair_bpe.bpe_ids(odd).collect()}
    assert got == {(i, tuple(tok.encode(t or "", add_special_tokens=False).ids)) for i, t in ODD}


def test_partitions_follow_the_size(spark, sf, monkeypatch, no_rows):
    from triagelake.llm import common

    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    least = common.scan_parallelism(spark)
    assert common.size_parallelism(docs) == common.size_parallelism(no_rows) == least
    monkeypatch.setattr(common, "TASK_BYTES", 10_000)
    assert least < common.size_parallelism(docs) < 1000
    assert common.size_parallelism(docs.crossJoin(docs.select("doc_id"))) < 2000  # sizes add up, whatever a join makes
