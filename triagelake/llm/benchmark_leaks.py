"""Benchmark decontamination with a generalised suffix automaton over normalised words.

The automaton holds all factors of all items. Training words stream through it; at every word it
gives the length of the longest match that ends there. A match of a whole window ends at a word
exactly if that length reaches the window's (long items), or if a short item's end lies on the
state's suffix path (items shorter than a window).
"""

from __future__ import annotations

import hashlib
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache, reduce
from itertools import chain

import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, own

WINDOW = 10
#: UTF-8 bytes of item texts in one automaton (which takes some 120 times that in a worker, if all words differ);
#: a larger benchmark is handled in blocks of this size, one after the other.
BLOCK_BYTES = 2 << 20
#: Fixed value: the words of normalised text, on UTF-8 bytes after ASCII lower-casing.
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def words(text: str | None) -> list[bytes]:
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class SuffixAutomaton:
    """Generalised suffix automaton of word sequences: transitions, link and length for each state."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.len = array("i", [-1]), array("i", [0])
        own: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        ends: dict[int, list[int]] = {}
        for k, (_, seq) in enumerate(items):
            at = 0
            for w in seq:
                at = self._extend(at, w)
        for k, (_, seq) in enumerate(items):  # the states along an item, once the structure stands
            at = 0
            for w in seq:
                at = self.next[at][w]
                own.setdefault(at, set()).add(k)
            if 0 < len(seq) < window:
                ends.setdefault(at, []).append(k)
        order = sorted(range(1, len(self.link)), key=self.len.__getitem__)
        for v in reversed(order):  # an item that holds a state's string holds its suffixes
            if self.link[v] > 0 and v in own:
                own.setdefault(self.link[v], set()).update(own[v])
        #: For the state that holds the strings of window length: the items with that window.
        self.at_window = {v: own[v] for v in order if self.len[self.link[v]] < window <= self.len[v]}
        #: For each state, short items that end with it: their names and the longest one's words.
        self.short: dict[int, tuple[int, set[int]]] = {}
        for v in order:
            length, found = self.short.get(self.link[v], (0, set()))
            if v in ends:
                length, found = self.len[v], found | set(ends[v])
            if found:
                self.short[v] = (length, found)

    def _extend(self, last: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.len
        if w in nxt[last]:
            q = nxt[last][w]
            return q if size[q] == size[last] + 1 else self._clone(last, q, w)
        cur = len(link)
        nxt.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if size[q] == size[p] + 1 else self._clone(p, q, w)
        return cur

    def _clone(self, p: int, q: int, w: bytes) -> int:
        nxt, link, size = self.next, self.link, self.len
        c = len(link)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        size.append(size[p] + 1)
        link[q] = c
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = c
            p = link[p]
        return c

    def stream(self, seq: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit runs [begin, end) of a document's words, in order and apart, and the items found."""
        nxt, link, size, window, short = self.next, self.link, self.len, self.window, self.short
        root = nxt[0]
        at_window = self.at_window
        runs: list[list[int]] = []
        found: set[int] = set()
        v = length = 0
        for i, w in enumerate(seq):
            if not v and w not in root:
                continue
            to = nxt[v].get(w)
            while to is None and v:
                v = link[v]
                length = size[v]
                to = nxt[v].get(w)
            if to is None:
                length = 0
                continue
            v, length = to, length + 1
            hit = 0
            if length >= window:
                u = v
                while size[link[u]] >= window:
                    u = link[u]
                hit = window
                found |= at_window[u]
            # a whole short item is the longest string of its state; the state's own may not be matched yet
            if (short_here := short.get(v if size[v] <= length else link[v])) is not None:
                hit = max(hit, short_here[0])
                found |= short_here[1]
            if hit:
                begin = i + 1 - hit
                if runs and begin <= runs[-1][1]:
                    while len(runs) > 1 and begin <= runs[-2][1]:
                        runs.pop(-2)
                    runs[-1][0] = min(begin, runs[-1][0])
                    runs[-1][1] = i + 1
                else:
                    runs.append([begin, i + 1])
        return [(a, b) for a, b in runs], found


Item = tuple[str | None, str]


def item_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[list[Item]]:
    """The distinct items in blocks of at most block_bytes of text each (an item above that stands alone). They
    come partition by partition, so the driver holds one partition and one block at a time."""
    block: list[Item] = []
    held = 0
    for r in benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct().toLocalIterator():
        n = len(r.t.encode("utf-8", "surrogatepass")) + 64
        if block and held + n > block_bytes:
            yield block
            block, held = [], 0
        block.append((r.i, r.t))
        held += n
    if block:
        yield block


@lru_cache(maxsize=2)
def _automaton(key: str, shared, window: int) -> SuffixAutomaton:
    """A worker's automaton of the block named key."""
    return SuffixAutomaton([(i, words(t)) for i, t in shared.value], window)


HITS = T.StructType([T.StructField("runs", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))])


def hits_column(spark: SparkSession, block: list[Item], text: Column, window: int) -> tuple[Column, Broadcast]:
    """A struct column for one block: hit runs (begin, end, begin, end, ...) and items (null identifiers too); and
    the broadcast it reads. Each Python worker builds its automaton once."""
    shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex

    @F.pandas_udf(HITS)
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = _automaton(key, shared, window)
        for texts in batches:
            rows = []
            for text in texts:
                runs, found = auto.stream(words(text))
                rows.append(([x for r in runs for x in r], list({auto.names[k] for k in found})))
            yield pd.DataFrame(rows, columns=["runs", "items"])
        del auto
        _automaton.cache_clear()
        give_back()

    return hits(text), shared


def _merged(parts: list[list[int]]) -> list[tuple[int, int]]:
    runs: list[list[int]] = []
    for a, b in sorted((p[i], p[i + 1]) for p in parts for i in range(0, len(p), 2)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(b, runs[-1][1])
        else:
            runs.append([a, b])
    return [(a, b) for a, b in runs]


LEAKS = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("longest_hit", T.LongType()),
        T.StructField("n_items", T.LongType()),
        T.StructField("items_sha256", T.StringType()),
        T.StructField("runs", T.ArrayType(T.LongType())),
    ]
)


def _leaks(n: int, parts: list[list[int]], names: list[list[str | None]]) -> tuple:
    merged = _merged([list(map(int, p)) for p in parts])
    found = {x for p in names for x in p}
    ids = [*([""] if None in found else []), *sorted(x for x in found if x is not None)]  # null as an empty one of its own
    return (int(n), sum(b - a for a, b in merged), max((b - a for a, b in merged), default=0), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), [x for r in merged for x in r])


@F.pandas_udf(LEAKS)
def _summary(texts: pd.Series, runs: pd.Series, items: pd.Series) -> pd.DataFrame:
    none = lambda x: [] if x is None else list(x)
    return pd.DataFrame([_leaks(len(words(t)), none(r), [none(p) for p in none(i)]) for t, r, i in zip(texts, runs, items)], columns=[f.name for f in LEAKS])


def _without(text: str | None, runs, max_run: int) -> str | None:
    """The text without its hit runs of max_run words or more."""
    cut = [(int(runs[i]), int(runs[i + 1])) for i in range(0, len(runs), 2) if runs[i + 1] - runs[i] >= max_run] if runs is not None else []
    if text is None or not cut:
        return text
    spans, parts, at = _positions(text), [], 0
    for a, b in cut:
        parts.append(text[at : spans[a][0]])
        at = spans[b - 1][1]
    return "".join([*parts, text[at:]])


def _one_block(spark: SparkSession, block: list[tuple[str, str]], text: Column, window: int, max_run: int | None) -> Column:
    """All of it in one function, so that a task has one Python worker. With max_run the struct also has
    `cleaned`, the text without long hit runs."""
    shared, key = spark.sparkContext.broadcast(block), uuid.uuid4().hex
    names = [f.name for f in LEAKS] + (["cleaned"] if max_run else [])

    @F.pandas_udf(T.StructType([*LEAKS.fields, *([T.StructField("cleaned", T.StringType())] if max_run else [])]))
    def leaks(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        auto = _automaton(key, shared, window)
        for texts in batches:
            rows = []
            for text in texts:
                seq = words(text)
                runs, found = auto.stream(seq)
                row = _leaks(len(seq), [[x for r in runs for x in r]], [[auto.names[k] for k in found]])
                rows.append((*row, _without(text, row[-1], max_run)) if max_run else row)
            yield pd.DataFrame(rows, columns=names)
        del auto
        _automaton.cache_clear()
        give_back()

    return leaks(text)


def benchmark_leaks(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", out_col: str = "leaks", window: int = WINDOW, block_bytes: int = BLOCK_BYTES, max_run: int | None = None
) -> DataFrame:
    """docs with one more column, a struct: n_words, n_hit (words inside any occurrence of a window),
    longest_hit (words of the longest hit run), n_items, items_sha256, runs (hit runs as word positions
    begin, end, begin, end, ...).

    Null and empty texts have no words and no hits; null item texts hold no window. Items without
    words match nothing. Rows are neither lost nor merged; a column named out_col is replaced.
    A benchmark of one block takes one pass without a shuffle. A larger one takes a pass a block, of which
    only texts with hits are written (by digest), and a join at the end; building it runs these passes. A
    null item_id counts as an item of its own with an empty name. max_run has no effect there."""
    spark, text = docs.sparkSession, F.col(text_col)
    blocks = item_blocks(benchmark, item_col, item_text_col, block_bytes)
    first, second = next(blocks, []), next(blocks, None)
    if second is None:
        return docs.withColumn(out_col, _one_block(spark, first, text, window, max_run))
    # every block by itself: its hits are written before the next one is made
    sha, runs, items = own(docs, "sha", "runs", "items")
    digest = F.unhex(F.sha2(text, 256))
    texts = docs.where(text.isNotNull()).select(digest.alias(sha), text.alias("t"))
    parts = []
    for block in chain([first, second], blocks):
        hits, shared = hits_column(spark, block, F.col("t"), window)
        parts.append(cut(texts.select(sha, hits.alias("h")).where(F.size("h.runs") > 0).select(sha, "h.*").dropDuplicates([sha])))
        shared.destroy()
    found = reduce(DataFrame.unionByName, parts).groupBy(sha).agg(F.collect_list("runs").alias(runs), F.collect_list("items").alias(items))
    joined = docs.withColumn(sha, digest).join(cut(found), sha, "left")
    return joined.withColumn(out_col, _summary(text, F.col(runs), F.col(items))).drop(sha, runs, items)


def _positions(text: str) -> list[tuple[int, int]]:
    """Character spans of the words, equal to those that words() finds."""
    return [m.span() for m in re.finditer(r"[0-9A-Za-z\x80-\U0010ffff]+", text)]


def remove_leaks(docs: DataFrame, text_col: str = "text", leaks_col: str = "leaks", max_run: int = WINDOW, max_share: float = 0.8) -> DataFrame:
    """Takes out the hit runs. A document leaves as a whole if the share of its words that are hit is
    above max_share; else every hit run of max_run words or more is cut from its text (a hit run below
    that length stays). leaks_col is dropped."""

    @F.pandas_udf("string")
    def cleaned(texts: pd.Series, runs: pd.Series) -> pd.Series:
        return pd.Series([_without(t, r, max_run) for t, r in zip(texts, runs)], dtype=object)

    leaks = F.col(leaks_col)
    # made already, where benchmark_leaks was given the same max_run
    done = leaks["cleaned"] if "cleaned" in docs.schema[leaks_col].dataType.names else cleaned(F.col(text_col), leaks["runs"])
    kept = docs.where(~(leaks["n_hit"] > max_share * leaks["n_words"]) | (leaks["n_hit"] == 0))
    return kept.withColumn(text_col, F.when(leaks["longest_hit"] >= max_run, done).otherwise(F.col(text_col))).drop(leaks_col)


__all__ = ["SuffixAutomaton", "benchmark_leaks", "remove_leaks", "words"]
