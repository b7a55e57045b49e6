"""Toxicity by maximum-scoring segments.

Words get log-odds of toxic against clean training text with an informative Dirichlet prior; what is
not significant counts as ordinary and gets one small negative score. A linear-time scan finds every
maximal-scoring segment of a text's words. Segments are judged as extreme values: with lambda and K of
the clean words' scores, lambda * S - ln(K * n) is standard Gumbel for ordinary text of n words; the
significant segments of a text are taken together by the sum statistic, and a logistic curve, fitted
on the training rows, turns this evidence into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, scan_parallelism

#: The classifier is fitted on at most so many labelled rows (those of the least hash of their identifier).
TRAIN_ROWS = 10_000
#: Features with a score of their own, at most; the most significant ones.
FEATURES = 20_000
SIGNIFICANT_Z = 4.0
#: Pseudo-counts of the prior as a share of all counts, dealt out as the features are distributed in them.
PRIOR = 0.05
#: A feature counts so often in one text at most, so that one text's repetitions prove nothing.
PER_TEXT = 3
PREFIXES = (4, 5, 6, 7, 8)
#: A segment is significant if ordinary text of this length has a better one with at most this probability.
SEGMENT_P = 0.05
#: Words whose scores a worker keeps, and letters of them, beside those of one text.
CACHE_WORDS, CACHE_LETTERS = 100_000, 4 << 20
#: Features that a task counts before it hands them on.
COUNT_ROWS = 100_000
_WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def features(word: str) -> list[str]:
    """A word itself and its beginnings: "=word", "^word's beginning"."""
    return ["=" + word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]


def segments(scores: np.ndarray) -> list[tuple[float, int, int]]:
    """Every maximal-scoring segment (score, begin, end), in order: Ruzzo and Tompa's scan, over the
    positive scores and the sums between them."""
    at = np.flatnonzero(scores > 0)
    if not len(at):
        return []
    total = np.cumsum(scores)
    # each candidate: begin, end, sum before it, sum up to its end, the last candidate before it with a lesser sum
    found: list[tuple[int, int, float, float, int]] = []
    before = np.where(at > 0, total[at - 1], 0.0).tolist()
    for i, low, high in zip(at.tolist(), before, total[at].tolist()):
        begin, j = i, len(found) - 1
        while True:
            while j >= 0 and found[j][2] >= low:
                j = found[j][4]
            if j < 0 or found[j][3] >= high:
                found.append((begin, i + 1, low, high, j))
                break
            begin, _, low, _, before_j = found[j]
            del found[j:]
            j = before_j
    return [(high - low, a, b) for a, b, low, high, _ in found]


@dataclass
class ToxicityModel:
    scores: dict[str, tuple[float, float]] = field(default_factory=dict)  # feature -> (z, score)
    ordinary: float = -0.01
    scale: float = 1.0  # lambda
    log_k: float = math.log(0.1)
    intercept: float = -2.0
    slope: float = 1.0
    cache: dict[str, float] = field(default_factory=dict, repr=False)
    letters: int = 0

    def word_score(self, word: str) -> float:
        best = max((self.scores[f] for f in features(word) if f in self.scores), key=lambda x: abs(x[0]), default=None)
        return self.ordinary if best is None else best[1]

    def word_scores(self, seq: list[str]) -> np.ndarray:
        new = [w for w in set(seq) if w not in self.cache]
        if len(self.cache) + len(new) > CACHE_WORDS or self.letters > CACHE_LETTERS:
            self.cache, self.letters, new = {}, 0, list(set(seq))
        self.cache.update((w, self.word_score(w)) for w in new)
        self.letters += sum(map(len, new))
        return np.fromiter(map(self.cache.__getitem__, seq), np.float64, len(seq))

    def passages(self, seq: list[str]) -> list[tuple[float, int, int]]:
        """Segments with their normalised scores (Gumbel's variable), the best first."""
        if not seq:
            return []
        shift = self.log_k + math.log(len(seq))
        return sorted(((self.scale * s - shift, a, b) for s, a, b in segments(self.word_scores(seq))), reverse=True)

    @staticmethod
    def significant(normal: float) -> bool:
        return -math.expm1(-math.exp(-normal)) <= SEGMENT_P if normal > -20 else False

    def evidence(self, passages: list[tuple[float, int, int]]) -> float:
        """-ln of the chance, in ordinary text, of segments as good as the r best, for the r at which it is least."""
        best = sum_ = 0.0
        if passages:
            n = passages[0][0]
            best = -math.log(-math.expm1(-math.exp(-n))) if n < 30 else n
        for r, (n, _, _) in enumerate(passages, 1):
            if n <= 0:
                break
            sum_ += n
            t = sum_ + math.lgamma(r + 1)
            # P = e**-t * t**(r-1) / (r! (r-1)!)
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r) if r > 1 else n)
        return math.log1p(max(0.0, best))

    def score(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-max(-50.0, min(50.0, self.intercept + self.slope * evidence))))


def held_out(id_col: Column) -> Column:
    return F.crc32(F.encode(id_col.cast("string"), "UTF-8")) % 5 == 0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> DataFrame:
    """(text, toxic) of at most `limit` labelled rows that are not held out; conflicting labels count as toxic;
    of texts with one identifier the least counts, so the rows' order means nothing."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").alias("__id"))
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("__id"), "__id")
        .limit(limit)
    )
    # at most `limit` rows of two numbers
    text = docs.select(F.col(id_col).alias("__doc"), F.col(text_col).alias("text")).where("text is not null")
    one = text.join(F.broadcast(chosen), F.col("__doc") == F.col("__id")).groupBy("__id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    return one.select("text", F.col("toxic").cast("int").alias("toxic"))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from labelled rows that are not held out. With no rows, or rows of one kind only, every text
    gets a score below one half. The driver gets at most FEATURES features and `limit` pairs of numbers."""
    spark = docs.sparkSession
    train = cut(training_rows(docs, labels, id_col, text_col, limit).repartition(min(64, scan_parallelism(spark))))

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        frame_of = lambda rows: pd.DataFrame([(f, *n) for f, n in rows.items()], columns=["feature", "clean", "toxic"])
        for frame in frames:
            rows: dict[str, list[int]] = {"": [0, 0]}
            for text, toxic in zip(frame["text"], frame["toxic"]):
                here: Counter = Counter()
                for w, n in Counter(words(text)).items():
                    n = min(n, PER_TEXT)
                    here[""] += n
                    for f in features(w):
                        here[f] += n
                for f, n in here.items():
                    rows.setdefault(f, [0, 0])[int(toxic > 0)] += min(n, PER_TEXT) if f else n
                if len(rows) > COUNT_ROWS:
                    yield frame_of(rows)
                    rows = {"": [0, 0]}
            yield frame_of(rows)
        give_back()

    counts = cut(train.mapInPandas(count, "feature string, clean long, toxic long").groupBy("feature").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")))
    totals = counts.where("feature = ''").first()
    model = ToxicityModel()
    if totals is None or not totals.clean or not totals.toxic:
        return model
    n0, n1 = float(totals.clean), float(totals.toxic)
    prior, weight = (F.col("clean") + F.col("toxic")) * PRIOR, PRIOR * (n0 + n1)
    t, c = F.col("toxic") + prior, F.col("clean") + prior
    odds = F.log(t / (n1 + weight - t)) - F.log(c / (n0 + weight - c))
    scored = counts.where("feature != ''").select("feature", "clean", "toxic", odds.alias("odds"), F.sqrt(1 / t + 1 / c).alias("sd")).withColumn("z", F.col("odds") / F.col("sd"))
    chosen = scored.where(F.abs("z") >= SIGNIFICANT_Z).orderBy(F.abs("z").desc(), "feature").limit(FEATURES).collect()
    model.scores = {r.feature: (r.z, r.odds) for r in chosen}
    # what the significant words leave for the others
    mass = [sum(r[k] for r in chosen if r.feature[0] == "=") for k in ("clean", "toxic")]
    model.ordinary = min(-1e-3, math.log((n1 - mass[1] + 1) / (n1 + 1)) - math.log((n0 - mass[0] + 1) / (n0 + 1)))
    plain = model

    def clean_scores(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: Counter = Counter()
        for frame in frames:
            for text in frame["text"]:
                seen.update(np.round(plain.word_scores(words(text)), 2).tolist())
        yield pd.DataFrame(list(seen.items()), columns=["score", "n"])

    # scores lie on a grid of hundredths: a bounded number of rows
    hist = train.where("toxic = 0").mapInPandas(clean_scores, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    model.scale = _lambda([(r.score, r.n) for r in hist])
    stats = train.select("toxic", _statistics(model)(F.col("text")).alias("s")).select("toxic", "s.*").toPandas()
    best = stats.loc[(stats["toxic"] == 0) & stats["best"].notna(), "best"]
    if len(best) > 20:
        # the median of ordinary texts' best segments is Gumbel's, -ln ln 2
        model.log_k += float(best.median()) + math.log(math.log(2))
        stats = train.select("toxic", _statistics(model)(F.col("text")).alias("s")).select("toxic", "s.*").toPandas()
    model.intercept, model.slope = _logistic(stats["evidence"].to_numpy(), (stats["toxic"] > 0).to_numpy(float))
    model.cache = {}
    return model


def _lambda(hist: list[tuple[float, int]]) -> float:
    """The positive root of sum p * exp(lambda * score) = 1; 1 where the scores have none."""
    s, n = np.array([h[0] for h in hist]), np.array([h[1] for h in hist], float)
    if not len(s) or s.max() <= 0 or (s * n).sum() >= 0:
        return 1.0
    low, high = 1e-6, 1.0
    p = n / n.sum()
    excess = lambda x: float((p * np.exp(np.minimum(x * s, 700))).sum()) - 1
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(80):
        mid = (low + high) / 2
        low, high = (mid, high) if excess(mid) < 0 else (low, mid)
    return high


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (not negative) by Newton steps with a little ridge."""
    a = b = 0.0
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -50, 50)))
        w = p * (1 - p)
        g = np.array([(y - p).sum(), ((y - p) * x).sum() - 1e-3 * b])
        h = np.array([[w.sum() + 1e-6, (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + 1e-3]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
        if np.abs(step).max() < 1e-9:
            break
    return float(a), float(max(b, 0.0))


_STATISTICS = T.StructType([T.StructField("best", T.DoubleType()), T.StructField("evidence", T.DoubleType())])


def _statistics(model: ToxicityModel):
    @F.pandas_udf(_STATISTICS)
    def statistics(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for text in texts:
            found = model.passages(words(text))
            rows.append((found[0][0] if found else None, model.evidence(found)))
        return pd.DataFrame(rows, columns=["best", "evidence"]).astype(float)

    return statistics


FOUND = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("n_passages", T.LongType()), T.StructField("spans", T.ArrayType(T.LongType()))])


def toxicity(text: Column, model: ToxicityModel) -> Column:
    """A struct column: score (0 to 1), n_passages (significant segments), spans (their words: begin, end, ...).
    Null and empty texts have no passage and the least score that the model gives."""

    @F.pandas_udf(FOUND)
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for text in texts:
                found = model.passages(words(text))
                spans = sorted((a, b) for n, a, b in found if model.significant(n))
                rows.append((model.score(model.evidence(found)), len(spans), [x for s in spans for x in s]))
            yield pd.DataFrame(rows, columns=["score", "n_passages", "spans"])
        model.cache.clear()
        give_back()

    return find(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, held_out (null identifiers: false), score, predicted, n_passages.
    A score is a function of the text alone."""
    model = fit(docs, labels, id_col, text_col)
    found = docs.select(F.col(id_col).alias("doc_id"), toxicity(F.col(text_col), model).alias("f"))
    return found.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "f.score", (F.col("f.score") >= 0.5).cast("int").alias("predicted"), "f.n_passages")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows whose score is one half or more; columns stay as they are."""
    model = fit(docs, labels, id_col, text_col)
    return docs.where(toxicity(F.col(text_col), model)["score"] < 0.5)
