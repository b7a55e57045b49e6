"""Removal of repeated passages by a hash-compared suffix sort.

A passage is repeated if its MIN bytes start anywhere else, too. Every window of MIN bytes chooses
an anchor, the place in its first REACH bytes whose gram of GRAM bytes has the least hash; equal windows
choose equal anchors. So only suffixes that begin at anchors are sorted (a sparse suffix array), and only
those whose gram occurs more than once:

1. Prefix polynomial hashes give the hash of any substring in constant time.
2. A mergesort orders the suffixes at an anchor; two suffixes are compared by a binary search for
   their common extension over these hashes, so a comparison takes logarithmic time. The same
   hashes order what stands before the anchors.
3. Neighbours' common extensions are verified byte by byte; a group in which a hash collision has
   misled the sort is sorted again by its bytes.
4. Classes of equal left extension are merged from the longest to the shortest. An anchor that
   enters a larger class meets only its two neighbours in suffix order, so a group of n anchors
   takes n log n pairs, never all. A pair with left extension L and right extension R repeats the
   windows that begin between MIN - R and L bytes before the anchor, and shares L + R bytes.

Arithmetic is modulo 2**64 with an odd base: equal substrings always have equal hashes, so nothing
repeated is missed; unequal ones with equal hashes are found out in step 3.
"""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, give_back, scan_parallelism, size_parallelism, text_or_empty
from .quality_ratio import sieved

MIN, GRAM = 400, 100
#: Bytes of the windows that choose anchors: equal windows of MIN bytes begin with equal ones of these, so they have
#: an anchor in common, and so have shared strings between the two lengths, which are noted.
REACH = 300
#: A string of so many bytes that stands at two places is worth a note, though it may be too short to go.
NOTED = 256
#: Contexts of one key that are sorted in one task; the windows of more are told apart by longer keys.
LIMIT = 1000
#: Bytes that are sorted at once (a larger group is sorted alone).
SORT_BYTES = 2 << 20
SEGMENT = 1 << 22
_BASE = 0x9E3779B97F4A7C15 | 1
_INDEX_BITS = 23  # of a place in a segment; the rest of 64 bits orders grams


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(_BASE, -1, 1 << 64)
#: Powers for a segment are made once a worker; those for contexts are short.
_POW: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(11, (n - 1).bit_length())
    if size not in _POW:
        _POW[size] = (_powers(size, _BASE), _powers(size, _INVERSE))
    return _POW[size]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _prefix(data: np.ndarray, powers: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=out[1:])
    return out


def anchors(data: bytes, least: int = MIN, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors of a text: places, the first window start of each (it owns the starts up to the next
    one's), and the grams' hashes. Empty for texts shorter than a window."""
    places, firsts, hashes = [], [], []
    n, span = len(data), least - gram + 1
    for begin in range(0, max(0, n - least + 1), SEGMENT):
        end = min(n, begin + SEGMENT + least - 1)
        part = np.frombuffer(data, np.uint8, end - begin, begin)
        powers, inverse = _tables(len(part) + 1)
        prefix = _prefix(part, powers[: len(part)])
        count = len(part) - gram + 1
        h = _mixed((prefix[gram:] - prefix[:-gram]) * inverse[:count])
        order = (h & ~np.uint64((1 << _INDEX_BITS) - 1)) | np.arange(count, dtype=np.uint64)
        blocks = -(-count // span)
        padded = np.full(blocks * span, ~np.uint64(0))
        padded[:count] = order
        padded = padded.reshape(blocks, span)
        ahead = np.minimum.accumulate(padded, axis=1).ravel()
        behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
        starts = count - span + 1
        at = (np.minimum(behind[:starts], ahead[span - 1 : span - 1 + starts]) & np.uint64((1 << _INDEX_BITS) - 1)).astype(np.int64)
        first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        places.append(at[first] + begin)
        firsts.append(first + begin)
        hashes.append(h[at[first]].view(np.int64))
    if not places:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(places), np.concatenate(firsts), np.concatenate(hashes)


class _Contexts:
    """Strings with an anchor each, and the hashes that compare what stands after and before it."""

    def __init__(self, texts: list[bytes], at: np.ndarray):
        self.texts, self.at = texts, at
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.after, self.before = size - at, at
        self.base = np.cumsum(size) - size
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        powers, self.inverse = _tables(int(size.max()) + 1)
        self.prefix = np.zeros(len(self.data) + 1, np.uint64)
        # some contexts at once: the sums take eight bytes for one, what they are made from three times that
        step = max(1, (1 << 18) // int(size.max()))
        for k in range(0, len(texts), step):
            sizes = size[k : k + step]
            begin, end = int(self.base[k]), int(self.base[k] + sizes.sum())
            rel = np.arange(begin, end) - np.repeat(self.base[k : k + step], sizes)
            self.prefix[begin : end + 1] = _prefix(self.data[begin:end], powers[rel]) + self.prefix[begin]

    def _hash(self, x: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of the substrings of contexts x from begin to end, places counted from the context's start."""
        b = self.base[x]
        return (self.prefix[b + end] - self.prefix[b + begin]) * self.inverse[begin]

    def right(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common extensions after the anchors, by binary search."""
        low, high = np.zeros(len(x), np.int64), np.minimum(self.after[x], self.after[y])
        ax, ay = self.at[x], self.at[y]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self._hash(x, ax, ax + mid) == self._hash(y, ay, ay + mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def left(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        low, high = np.zeros(len(x), np.int64), np.minimum(self.before[x], self.before[y])
        ax, ay = self.at[x], self.at[y]
        while (low < high).any():
            mid = (low + high + 1) >> 1
            same = self._hash(x, ax - mid, ax) == self._hash(y, ay - mid, ay)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def less(self, x: np.ndarray, y: np.ndarray, forward: bool) -> np.ndarray:
        """Whether x sorts before y; what ends first sorts first, equal ones by number."""
        n = self.right(x, y) if forward else self.left(x, y)
        room = self.after if forward else self.before
        end_x, end_y = n == room[x], n == room[y]
        step = n if forward else -n - 1
        last = len(self.data) - 1
        cx = self.data[np.clip(self.base[x] + self.at[x] + step, 0, last)]
        cy = self.data[np.clip(self.base[y] + self.at[y] + step, 0, last)]
        return np.where(end_x & end_y, x < y, np.where(end_x, True, np.where(end_y, False, cx < cy)))


def merge_sort(ctx: _Contexts, starts: np.ndarray, sizes: np.ndarray, forward: bool) -> np.ndarray:
    """The contexts' numbers, sorted inside each group (a run from starts, of sizes) by merging runs of
    doubling length; the place of an element in the other run is found by binary search."""
    order = np.arange(int(sizes.sum()))
    group = np.repeat(np.arange(len(sizes)), sizes)
    local = order - starts[group]
    size = sizes[group]
    run = 1
    while run < int(sizes.max(initial=0)):
        live = np.flatnonzero(size > run)
        u, s, base = local[live], size[live], starts[group[live]]
        q = u // run
        other = (q ^ 1) * run
        low = np.minimum(other, s)
        high = np.minimum(other + run, s)
        first, me = low.copy(), order[live]
        while (open_ := low < high).any():
            at = np.flatnonzero(open_)
            mid = (low[at] + high[at]) >> 1
            before = ctx.less(order[base[at] + mid], me[at], forward)
            low[at], high[at] = np.where(before, mid + 1, low[at]), np.where(before, high[at], mid)
        new = order.copy()
        new[base + (q // 2) * 2 * run + (u - q * run) + (low - first)] = me
        order, run = new, run * 2
    return order


def _exact(texts: list[bytes], at: list[int], members: list[int], forward: bool) -> tuple[list[int], list[int]]:
    """Order and neighbours' common extensions by the bytes themselves."""
    part = (lambda e: texts[e][at[e] :]) if forward else (lambda e: texts[e][: at[e]][::-1])
    order = sorted(members, key=lambda e: (part(e), e))
    common = []
    for x, y in zip(order, order[1:]):
        a, b = part(x), part(y)
        n = min(len(a), len(b))
        common.append(next((i for i in range(n) if a[i] != b[i]), n))
    return order, common


def _verified(texts, at, order: list[int], common: list[int], forward: bool) -> bool:
    for x, y, n in zip(order, order[1:], common):
        a, b, i, j = texts[x], texts[y], at[x], at[y]
        if (a[i : i + n] != b[j : j + n]) if forward else (a[i - n : i] != b[j - n : j]):
            return False
    return True


def _group_pairs(order_r: list[int], common_r: list[int], order_l: list[int], common_l: list[int], least: int) -> tuple[dict[int, list[tuple[int, int]]], dict[int, int]]:
    """For the members of a group: ranges (from, to) of the bytes before the anchor at which a repeated
    window begins; and the longest string about the anchor that another member shares."""
    found: dict[int, list[tuple[int, int]]] = {}
    longest: dict[int, int] = {}
    rank = {e: r for r, e in enumerate(order_r)}
    n = len(order_r)
    table = [np.array(common_r)] if n > 64 else []
    while table and len(table[-1]) > 1 << (len(table) - 1):
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))

    def extension(r: int, s: int) -> int:
        if s - r <= 64:
            return min(common_r[r:s])
        k = (s - r).bit_length() - 1
        return int(min(table[k][r], table[k][s - (1 << k)]))

    parent = list(range(n))
    classes = [[rank[e]] for e in order_l]

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in sorted(range(n - 1), key=lambda i: -common_l[i]):
        depth, a, b = common_l[i], find(i), find(i + 1)
        if len(classes[a]) > len(classes[b]):
            a, b = b, a
        small, large = classes[a], classes[b]
        for r in small:
            j = bisect.bisect(large, r)
            for k in (j - 1, j):
                if 0 <= k < len(large):
                    s = large[k]
                    right = extension(min(r, s), max(r, s))
                    for e in (order_r[r], order_r[s]):
                        longest[e] = max(longest.get(e, 0), depth + right)
                    if least - right <= depth:
                        span = (max(0, least - right), depth)
                        found.setdefault(order_r[r], []).append(span)
                        found.setdefault(order_r[s], []).append(span)
        large += small
        large.sort()
        classes[a], parent[a] = [], b
    return found, longest


def repeats(groups: list[list[tuple[bytes, int]]], least: int = MIN, longest: list[dict[int, int]] | None = None) -> list[dict[int, list[tuple[int, int]]]]:
    """For each group of distinct contexts (string, anchor's place in it): the repeated ranges of members. To
    `longest`, if it is given, each group adds its members' longest shared strings."""
    texts = [t for g in groups for t, _ in g]
    at = np.array([a for g in groups for _, a in g], np.int64)
    sizes = np.array([len(g) for g in groups], np.int64)
    starts = np.cumsum(sizes) - sizes
    if not texts:
        longest += [{} for _ in groups] if longest is not None else []
        return [{} for _ in groups]
    ctx = _Contexts(texts, at)
    places, sorted_ = at.tolist(), {}
    for forward in (True, False):
        order = merge_sort(ctx, starts, sizes, forward)
        common = (ctx.right if forward else ctx.left)(order[:-1], order[1:])
        sorted_[forward] = (order.tolist(), common.tolist())
    out = []
    for s, n in zip(starts.tolist(), sizes.tolist()):
        both = []
        for forward in (True, False):
            order, common = sorted_[forward][0][s : s + n], sorted_[forward][1][s : s + n - 1]
            if not _verified(texts, places, order, common, forward):
                order, common = _exact(texts, places, list(range(s, s + n)), forward)
            both += [order, common]
        spans, shared = _group_pairs(*both, least) if n > 1 else ({}, {})
        out.append({e - s: x for e, x in spans.items()})
        if longest is not None:
            longest.append({e - s: x for e, x in shared.items()})
    return out


def _settle(group: list[tuple[int, int, int, bytes]], answer: dict[int, list[tuple[int, int]]], members: dict, least: int) -> Iterator[tuple[int, int, int]]:
    """(row, first start, last start) of repeated windows; group: distinct (ctx, place) in order."""
    for e, (text, place) in enumerate(group):
        rows = members[(text, place)]
        last = len(text) - least  # the last window start inside the context
        if len(rows) > 1:
            spans = [(0, last)]
        else:
            spans = [(max(0, place - to), min(last, place - frm)) for frm, to in answer.get(e, ())]
        for lo, hi in spans:
            if lo <= hi:
                for row, first in rows:
                    yield row, first + lo, first + hi


def _emit(frames: Iterator[pd.DataFrame], least: int) -> Iterator[pd.DataFrame]:
    """From rows (gram, sha, first: places in that text, place, ctx), sorted by gram, to (sha, lo, hi,
    longest): runs of repeated windows' starts, and (lo and hi -1) shared strings of NOTED bytes or more."""
    held: list[dict] = []
    size, gram, now = 0, None, {}

    def flush(groups: list[dict]) -> pd.DataFrame:
        distinct = [list(g) for g in groups]
        out, shared = [], []
        for g, d, ans, notes in zip(groups, distinct, repeats(distinct, least, shared), shared):
            out += [(*x, 0) for x in _merge_starts(list(_settle(d, ans, g, least)))]
            best: dict[bytes, int] = {}
            for e, context in enumerate(d):
                n = len(context[0]) if len(g[context]) > 1 else notes.get(e, 0)
                for row, _ in g[context] if n >= NOTED else ():
                    best[row] = max(best.get(row, 0), n)
            out += [(row, -1, -1, n) for row, n in best.items()]
        return pd.DataFrame(out, columns=["sha", "lo", "hi", "longest"])

    for frame in frames:
        for g, row, first, place, text in zip(frame["gram"].tolist(), frame["sha"].tolist(), frame["first"].tolist(), frame["place"].tolist(), frame["ctx"].tolist()):
            if g != gram:
                if now and (len(now) > 1 or any(len(m) > 1 for m in now.values())):
                    held.append(now)
                    size += sum(len(t) for t, _ in now)
                    if size > SORT_BYTES:
                        yield flush(held)
                        held, size = [], 0
                gram, now = g, {}
            now.setdefault((text, place), []).extend((row, f) for f in first)
    if now:
        held.append(now)
    if held:
        yield flush(held)
    held, now = [], {}
    give_back()


def _merge_starts(rows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[list[int]] = []
    for row, lo, hi in sorted(rows):
        if out and out[-1][0] == row and lo <= out[-1][2] + 1:
            out[-1][2] = max(hi, out[-1][2])
        else:
            out.append([row, lo, hi])
    return [tuple(x) for x in out]


def _narrower(offsets: int) -> list[int]:
    """How many neighbouring window offsets share a key at each level: all (the gram itself is the key),
    fewer, and at last one, where the key is the whole window."""
    out = [offsets]
    while out[-1] > 1:
        out.append(-(-out[-1] // 7))
    return out


#: What a sorted group gives: runs of starts, or a note.
FOUND = "sha binary, lo long, hi long, longest long"


def _crowded_notes(crowd: DataFrame, gram: int, step: int = 26) -> DataFrame:
    """(cid, lo, hi, longest), with lo and hi -1: contexts of common grams that share a string of NOTED bytes about
    the anchor with another one. Keys are what all windows of `step` neighbouring offsets have in common, so
    a note is of NOTED - step + 1 bytes."""
    at, a = F.col("place"), F.col("a")
    each = crowd.select("cid", "place", "ctx", F.explode(F.sequence(F.lit(0), F.lit(max(NOTED - gram, 0)), F.lit(step))).alias("a"))
    each = each.where((a <= at) & (at - a + NOTED <= F.length("ctx")))
    keyed = each.select("cid", F.xxhash64("a", F.substring("ctx", (at - a + 1).cast("int"), F.lit(NOTED - step + 1))).alias("key"))
    twice = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    none = F.lit(-1).cast("long")
    return keyed.join(twice, "key", "left_semi").select("cid").distinct().select("cid", none.alias("lo"), none.alias("hi"), F.lit(NOTED - step + 1).cast("long").alias("longest"))


def _crowded_windows(crowd: DataFrame, least: int, offsets: int, limit: int) -> DataFrame:
    """(cid, lo, hi, longest): the repeated window starts of contexts (cid, place, ctx; all distinct) whose
    grams are too common to be sorted in one task, and notes of what they share.

    A window begins some offset before the anchor. Offsets are dealt into ever narrower ranges; all windows
    of a range share the bytes from the anchor's farthest to its nearest, a longer string than the gram,
    and only contexts that agree in it meet. Groups within the limit are sorted as any other; larger ones go
    on to the next level, where at last a key is a window's own bytes and whoever shares it is a hit."""
    parts = scan_parallelism(crowd.sparkSession)
    at, last = F.col("place"), F.length("ctx") - least
    # the offsets that a context's windows have, and the range that is still to be searched
    live = crowd.select("cid", F.lit(0).alias("a"), F.lit(offsets).alias("b"))
    found = None
    for width in _narrower(offsets)[1:]:
        cuts = F.sequence(F.col("a"), F.col("b") - 1, F.lit(width))
        each = live.join(crowd, "cid").select("cid", "place", "ctx", "b", F.explode(cuts).alias("a"))
        each = each.withColumn("b", F.least("b", F.col("a") + width)).where((F.col("a") <= at) & (F.col("b") > at - last))
        shared = F.substring("ctx", (at - F.col("a") + 1).cast("int"), (F.lit(least + 1) - F.col("b") + F.col("a")).cast("int"))
        if width == 1:
            keyed = each.select("cid", shared.alias("key"), (at - F.col("a")).alias("lo"))
            twice = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
            hits = keyed.join(twice, "key", "left_semi").select("cid", F.col("lo").cast("long").alias("lo"), F.col("lo").cast("long").alias("hi"), F.lit(least).cast("long").alias("longest"))
            return hits if found is None else found.unionByName(hits)
        keyed = cut(each.select("cid", "a", "b", F.xxhash64("a", "b", shared).alias("key")))
        counts = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        met = cut(keyed.join(counts, "key"))
        few = met.where(F.col("n") <= limit).select("key", "cid").join(crowd, "cid")
        rows = few.select(F.col("key").alias("gram"), F.col("cid").alias("sha"), F.array(F.lit(0).cast("long")).alias("first"), "place", "ctx")
        sorted_ = rows.repartition(parts, "gram").sortWithinPartitions("gram").mapInPandas(lambda frames: _emit(frames, least), FOUND)
        hits = sorted_.select(F.col("sha").alias("cid"), "lo", "hi", "longest")
        found = hits if found is None else found.unionByName(hits)
        live = met.where(F.col("n") > limit).select("cid", "a", "b")
        if not live.limit(1).count():
            break
    return found


def _some(texts: DataFrame, marks: DataFrame) -> DataFrame:
    """The texts (sha, text) that marks (sha, ...) names, and a few others: most of the rest are kept out of the
    shuffle by bits of a fixed size."""
    found = sieved(texts.select(F.col("sha").alias("__doc"), "text"), marks.select(F.col("sha").alias("__id")))
    return found.select(F.col("__doc").alias("sha"), "text")


def repeated_windows(texts: DataFrame, base: DataFrame, least: int = MIN, gram: int = GRAM, limit: int = LIMIT, reach: int = REACH) -> DataFrame:
    """(sha, runs, longest): for distinct texts, the starts of repeated windows, and the longest shared string that
    was seen about an anchor (null if none has NOTED bytes). texts: sha, text; base: sha, place,
    first, gram. A text that occurs twice is itself a repetition, so it does no harm if copies of it meet."""
    each = base.where(F.size("place") > 0).groupBy("sha").agg(F.any_value("place").alias("place"), F.any_value("first").alias("first"), F.any_value("gram").alias("gram"))
    each = cut(each)
    one = each.select("sha", F.posexplode("gram").alias("k", "gram"))
    # a table of its own: the join with it can be split where a gram is common
    shared = cut(one.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1"))
    marks = cut(one.join(shared, "gram").groupBy("sha").agg(F.collect_list(F.struct("k", (F.col("n") > limit).alias("hot"))).alias("ks")))
    wanted = marks.join(each, "sha")

    def contexts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last = None
        for frame in frames:
            out, size = [], 0
            for sha, text, ks, place, first, grams in zip(frame["sha"], frame["text"], frame["ks"], frame["place"], frame["first"], frame["gram"]):
                if sha == last:
                    continue
                last, data = sha, text.encode("utf-8", "surrogatepass")
                places: dict[tuple, list[int]] = {}  # a context that stands in a text again and again is one row
                for e in ks:
                    k = e["k"]
                    end = int(first[k + 1]) - 1 if k + 1 < len(first) else len(data) - reach
                    begin = int(first[k])
                    places.setdefault((int(grams[k]), int(place[k]) - begin, data[begin : end + least], e["hot"]), []).append(begin)
                for (g, at, ctx, hot), firsts in places.items():
                    out.append((g, sha, firsts, at, ctx, hot))
                    size += len(ctx)
                    if size > 8 << 20:
                        yield pd.DataFrame(out, columns=["gram", "sha", "first", "place", "ctx", "hot"])
                        out, size = [], 0
            yield pd.DataFrame(out, columns=["gram", "sha", "first", "place", "ctx", "hot"])

    joined = wanted.join(_some(texts, marks), "sha").select("sha", "text", "ks", "place", "first", "gram")
    ctx = joined.mapInPandas(contexts, "gram long, sha binary, first array<long>, place long, ctx binary, hot boolean")
    parts = size_parallelism(texts)
    crowded = shared.where(F.col("n") > limit).limit(1).count() > 0
    if crowded:
        ctx = cut(ctx)
    cool = ctx.where("not hot").drop("hot").repartition(parts, "gram").sortWithinPartitions("gram")
    found = cool.mapInPandas(lambda frames: _emit(frames, least), FOUND)
    if crowded:
        many = ctx.where("hot").select("sha", "first", "place", "ctx", F.unhex(F.sha2(F.concat(F.col("place").cast("string").cast("binary"), F.lit(b":"), F.col("ctx")), 256)).alias("cid"))
        kinds = cut(many.groupBy("cid").agg(F.sum(F.size("first")).alias("n"), F.any_value("place").alias("place"), F.any_value("ctx").alias("ctx")))
        # all windows of a context that occurs twice are repeated
        whole = kinds.where((F.col("n") > 1) & (F.length("ctx") >= least)).select("cid", F.lit(0).cast("long").alias("lo"), (F.length("ctx") - least).cast("long").alias("hi"), F.length("ctx").cast("long").alias("longest"))
        hits = whole.unionByName(_crowded_windows(kinds.drop("n"), least, reach - gram + 1, limit)).unionByName(_crowded_notes(kinds.drop("n"), gram))
        # a table of its own, so that the join is split where a context stands in many texts
        runs = cut(hits.groupBy("cid").agg(F.array_distinct(F.collect_list(F.when(F.col("lo") >= 0, F.struct("lo", "hi")))).alias("rs"), F.max("longest").alias("longest")))
        back = many.select("cid", "sha", "first").join(runs, "cid").select("sha", "longest", F.explode_outer(F.flatten(F.transform("first", lambda f: F.transform("rs", lambda r: F.struct((f + r["lo"]).alias("lo"), (f + r["hi"]).alias("hi")))))).alias("r"))
        found = found.unionByName(back.select("sha", F.coalesce("r.lo", F.lit(-1)).alias("lo"), F.coalesce("r.hi", F.lit(-1)).alias("hi"), "longest"))
    return found.groupBy("sha").agg(F.collect_list(F.when(F.col("lo") >= 0, F.struct("lo", "hi"))).alias("runs"), F.max("longest").alias("longest"))


def _covered(runs, least: int) -> list[list[int]]:
    out: list[list[int]] = []
    for lo, hi in sorted((r["lo"], r["hi"]) for r in runs):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi + least)
        else:
            out.append([lo, hi + least])
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = MIN, gram: int = GRAM, limit: int = LIMIT, reach: int = REACH) -> DataFrame:
    """One row for each row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256,
    longest_shared (bytes of the longest string seen about an anchor that another place has, too: a note of
    passages that may be too short to go; 0 below NOTED; it is no longer than a context, so a lower bound).

    Every byte inside a string of `least` bytes that starts at another place, too, of the same or any
    other document, is removed; null is as empty. Identifiers may be of any type, null, or repeated. A text that occurs more than once as a whole goes
    entirely (if it is long enough), and is searched for once. Texts are named by their SHA-256, so
    nothing depends on the order in which rows are read."""
    text = text_or_empty(text_col)
    texts = docs.select(F.unhex(F.sha2(text, 256)).alias("sha"), text.alias("text"))
    schema = pa.schema([("n_bytes", pa.int64()), ("sha", pa.binary()), ("place", pa.list_(pa.int32())), ("first", pa.list_(pa.int32())), ("gram", pa.list_(pa.int64()))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[] for _ in schema]
            for text in b.column("text"):
                data = text.as_buffer().to_pybytes()
                values = (len(data), hashlib.sha256(data).digest(), *anchors(data, reach, gram))
                for col, v in zip(out, values):
                    col.append(v)
            made = [pa.array(c, f.type) for c, f in zip(out, schema)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *made], names=["doc_id", *schema.names])

    plain = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    kind = plain.schema["doc_id"].dataType.simpleString()
    base = cut(plain.mapInArrow(scan, f"doc_id {kind}, n_bytes long, sha binary, place array<int>, first array<int>, gram array<long>"))
    copies = base.groupBy("sha").agg(F.count("*").alias("copies"))
    found = repeated_windows(texts, base, least, gram, limit, reach).join(copies.where("copies = 1"), "sha", "left_semi")

    @F.pandas_udf("n_removed long, n_spans long, kept_sha256 string")
    def kept(texts: pd.Series, runs: pd.Series) -> pd.DataFrame:
        out = []
        for text, r in zip(texts, runs):
            data, digest, at = text.encode("utf-8", "surrogatepass"), hashlib.sha256(), 0
            spans = _covered(r, least)
            for a, b in spans:
                digest.update(data[at:a])
                at = b
            digest.update(data[at:])
            out.append((sum(b - a for a, b in spans), len(spans), digest.hexdigest()))
        return pd.DataFrame(out, columns=["n_removed", "n_spans", "kept_sha256"])

    found = cut(found)
    repeated = found.where(F.size("runs") > 0)
    some = repeated.join(_some(texts, repeated), "sha").select("sha", kept("text", "runs").alias("k"))
    all_gone = (F.col("copies") > 1) & (F.col("n_bytes") >= least)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        base.select("doc_id", "n_bytes", "sha")
        .join(copies, "sha")
        .join(some, "sha", "left")
        .join(found.select("sha", "longest"), "sha", "left")
        .select(
            "doc_id",
            "n_bytes",
            F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("k.n_removed", F.lit(0))).cast("long").alias("n_removed"),
            F.when(all_gone, 1).otherwise(F.coalesce("k.n_spans", F.lit(0))).cast("long").alias("n_spans"),
            F.when(all_gone, nothing).otherwise(F.coalesce("k.kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
            F.when(all_gone, F.col("n_bytes")).otherwise(F.coalesce("longest", F.lit(0))).cast("long").alias("longest_shared"),
        )
    )
