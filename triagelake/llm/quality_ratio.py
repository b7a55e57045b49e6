"""Quality rules: simple counts, and a hashed n-gram likelihood ratio.

Words and pairs of neighbours are hashed into a fixed number of buckets. Two multinomials over the
buckets are estimated with add-one smoothing: one from the trusted target (documents labelled as
good), one from all documents. A document's verdict is the mean over its n-grams of the log of their
ratio, held against a threshold that is fixed from all labelled rows once; nothing is drawn at random.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, text_or_empty
from .token_counts import byte_batches

BUCKETS = 1 << 16
#: Bits of the sieve that keeps most texts without a label out of a shuffle, as a power of two: 8 MB at most.
SIEVE_BITS = 26
#: Log ratios have six decimals, so a cell of this many to one has 1,000 values at most.
CELLS = 1000
#: Fixed value: characters that count as symbols.
SYMBOLS = "#*$%&|<>"
_MIX = np.uint64(0x9E3779B97F4A7C15)


def hashed_ngrams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each text's words and pairs, text after text, and how many each text has. Each distinct
    word of the batch is hashed once."""
    import xxhash

    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    lens = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.to_pylist()
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass")) if w else 0 for w in words), np.uint64, len(words))
    ids = h[coded.indices.to_numpy()] if len(words) else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(lens)), lens)
    real = ids != 0
    ids, owner = ids[real], owner[real]
    n = np.bincount(owner, minlength=len(lens))
    pair = owner[1:] == owner[:-1]
    two = ((ids[:-1] * _MIX) ^ (ids[1:] + _MIX)) * _MIX
    all_ids = np.concatenate([ids, two[pair]])
    all_owner = np.concatenate([owner, owner[1:][pair]])
    order = np.argsort(all_owner, kind="stable")
    return (all_ids[order] >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64), n + np.maximum(n - 1, 0)


def _parts(texts: pa.Array) -> Iterator[pa.Array]:
    texts = pc.fill_null(texts.cast(pa.string()), "")
    for a, b in byte_batches(pc.binary_length(texts).to_numpy(zero_copy_only=False), 4 << 20):
        yield texts.slice(a, b - a)


def bucket_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often each bucket occurs in the documents. Tasks add up first; the driver gets a row a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for b in batches:
            for part in _parts(b.column("text")):
                total += np.bincount(hashed_ngrams(part)[0], minlength=BUCKETS)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    out = np.zeros(BUCKETS, np.int64)
    for r in rows:
        out[r[0]] = r[1]
    return out


def sieved(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of docs (__doc, ...) whose identifier has a bit of those of marks (__id): all that marks
    has, and a few others. The bits are of a fixed size, so they are broadcast whatever the number of marks."""
    at = lambda c: F.pmod(F.xxhash64(F.col(c).cast("string")), F.lit(1 << SIEVE_BITS))
    place, block = F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))), F.shiftright("at", 15)
    bits = cut(marks.select(at("__id").alias("at")).groupBy(block.alias("__block")).agg(place.alias("__bits")))
    bit = F.col("__at").bitwiseAND(F.lit(32767))
    byte = F.conv(F.hex(F.substring("__bits", (F.shiftright(bit, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    has = F.pmod(F.floor(byte / F.pow(F.lit(2.0), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1
    own = docs.where(F.col("__doc").isNotNull()).withColumn("__at", at("__doc"))
    return own.join(F.broadcast(bits), F.shiftright("__at", 15) == F.col("__block")).where(has).select(*docs.columns)


@dataclass
class RatioModel:
    ratio: np.ndarray  # ln(target / raw) of each bucket
    threshold: float

    def values(self, texts: pa.Array) -> np.ndarray:
        """The mean log ratio of each text's n-grams; 0 for texts without words."""
        out = []
        for part in _parts(texts):
            buckets, n = hashed_ngrams(part)
            sums = np.bincount(np.repeat(np.arange(len(n)), n), self.ratio[buckets], len(n))
            out.append(sums / np.maximum(n, 1))
        return np.concatenate(out) if out else np.zeros(0)


def _ratio_column(text: Column, ratio: np.ndarray) -> Column:
    model = RatioModel(ratio.astype(np.float32), 0.0)

    @F.arrow_udf(T.DoubleType())
    def value(texts: pa.Array) -> pa.Array:
        return pa.array(np.round(model.values(texts), 6))

    return value(text)


def best_threshold(values: np.ndarray, good: np.ndarray) -> float:
    """The cut that gets the most of both kinds right on average (equal weight for a kind); the least such.
    Below everything if one kind is missing."""
    if not good.any() or good.all():
        return -float("inf")
    order = np.argsort(values, kind="stable")
    v, g = values[order], good[order]
    bad_below = np.concatenate([[0], np.cumsum(~g)]) / (~g).sum()
    good_above = 1 - np.concatenate([[0], np.cumsum(g)]) / g.sum()
    gain = bad_below + good_above
    gain[1:-1][v[1:] == v[:-1]] = -1
    k = int(np.argmax(gain))
    if k == 0:
        return -float("inf")
    return float(v[-1]) + 1e-6 if k == len(v) else float(v[k - 1] + v[k]) / 2


def threshold_of(scored: DataFrame) -> float:
    """best_threshold of all rows (v, of six decimals, and good). Rows are counted by value; the driver gets
    the counts of cells of values, and running sums are made within the cells."""
    counts = scored.groupBy("v").agg(F.count_if(~F.col("good")).alias("bad"), F.count_if("good").alias("good"))
    counts = cut(counts.withColumn("cell", F.floor(F.col("v") * CELLS)))
    cells = counts.groupBy("cell").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.min("v").alias("v")).orderBy("cell").collect()
    n_bad, n_good = sum(r.bad for r in cells), sum(r.good for r in cells)
    if not n_bad or not n_good:
        return -float("inf")
    starts, bad, good = [], 0, 0
    for r, then in zip(cells, [*cells[1:], None]):
        starts.append((r.cell, bad, good, then.v if then else None))
        bad, good = bad + r.bad, good + r.good
    starts = scored.sparkSession.createDataFrame(starts, "cell long, bad_before long, good_before long, next_cell double")
    order = Window.partitionBy("cell").orderBy("v")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = counts.select("cell", "v", F.sum("bad").over(upto).alias("bad"), F.sum("good").over(upto).alias("good"), F.lead("v").over(order).alias("then"))
    cuts = sums.join(F.broadcast(starts), "cell")
    gain = (F.col("bad_before") + F.col("bad")) / F.lit(n_bad) + (1 - (F.col("good_before") + F.col("good")) / F.lit(n_good))
    best = cuts.select(F.struct(gain.alias("gain"), (-F.col("v")).alias("low"), F.coalesce("then", "next_cell").alias("then")).alias("s")).agg(F.max("s").alias("s")).first().s
    if best.gain <= 1:  # as good as below everything
        return -float("inf")
    v = -best.low
    return v + 1e-6 if best.then is None else (v + best.then) / 2


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> RatioModel:
    """Raw counts over all documents, the target over all that are labelled as good, and the threshold from
    all labelled ones. Labels of one identifier that disagree count as not good.

    Texts without a label stay where they are; those labelled as good (and a few others that the sieve
    lets through) are dealt by identifier once. Scores are joined with labels as pairs of numbers. Joins
    are hash joins at any size."""
    marks = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").alias("__id")).agg((F.min("quality") > 0).alias("good"))
    marks = cut(marks)
    plain = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text"))
    same, right = F.col("__doc") == F.col("__id"), marks.where("good")
    target = bucket_counts(sieved(plain, right).join(right.hint("shuffle_hash"), same, "left_semi"), "text")
    raw = bucket_counts(plain, "text")
    ratio = np.log((target + 1) / (target.sum() + BUCKETS)) - np.log((raw + 1) / (raw.sum() + BUCKETS))
    scores = sieved(plain, marks).select("__doc", _ratio_column(F.col("text"), ratio).alias("v"))
    return RatioModel(ratio, threshold_of(scores.join(marks.hint("shuffle_hash"), same).select("v", "good")))


BASE = T.StructType([T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")])


def _base(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode("utf-8", "surrogatepass")
    seq = raw.split()  # ASCII white space only
    n = len(seq)
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    seen, dup = set(), 0
    for line in raw.split(b"\n"):
        if line in seen:
            dup += 1
        elif line.strip():
            seen.add(line)
    repeat = 0
    if n > 2:
        grams = list(zip(seq, seq[1:], seq[2:]))
        if len(first := set(grams)) < len(grams):
            once, twice = set(), set()
            for g in grams:
                (twice if g in once else once).add(g)
            end = 0
            for i, g in enumerate(grams):
                if g in twice:
                    repeat += i + 3 - max(end, i)
                    end = i + 3
            del first
    return n, chars, sum(map(text.count, SYMBOLS)), dup, repeat


@F.pandas_udf(BASE)
def base_counts(texts: pd.Series) -> pd.DataFrame:
    """n_words, word_chars (code points in words), n_symbols, n_dup_lines, n_repeat_words of whole texts; all 0
    for null and empty ones. A row for each row, repeats included."""
    return pd.DataFrame([_base(t or "") for t in texts], columns=[f.name for f in BASE])


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: RatioModel | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the base counts, base_failed, kept, and the log ratio.

    Null is as empty: no words, base failed. Labels with null parts are left out; without labels of both
    kinds every text that passes the base rules is kept. A verdict follows from the text and the model."""
    model = model or fit(docs, labels, id_col, text_col)
    text = text_or_empty(text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), base_counts(text).alias("b"), _ratio_column(text, model.ratio).alias("log_ratio"))
    failed = (F.col("b.n_words") < 50) | (100 * F.col("b.n_repeat_words") > 50 * F.col("b.n_words"))
    kept = ~F.col("base_failed") & (F.col("log_ratio") >= F.lit(model.threshold))
    return found.select("doc_id", "b.*", failed.alias("base_failed"), "log_ratio").select("doc_id", *BASE.names, "base_failed", kept.alias("kept"), "log_ratio")
