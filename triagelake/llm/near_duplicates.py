"""SimHash near-duplicates, searched by the generalised pigeonhole principle.

The 64 bits are grouped into partitions of correlated bits. If partition i allows t_i differing bits
and the t_i (each -1 or more) sum to r - m + 1, fingerprints within r bits agree within t_i in some
partition i. Which thresholds are cheapest is found by dynamic programming over candidate counts
that are estimated from the bits of all fingerprints. Each fingerprint is put under its value in
every partition, and probes the values within t_i of its own; what meets there is verified on all
64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, own, scan_parallelism, text_or_empty
from .components import components

RADIUS = 3
#: Fingerprints of one value that meet in one task; above, they meet in pairs of blocks of this size.
BLOCK = 8192
#: A probe (a shuffled row) costs as much as this many candidate checks.
PROBE_COST = 50
SMALL = 24


def majority(h: np.ndarray) -> int:
    """The fingerprint of hashes: a bit is 1 if it is set in over half of them."""
    h = np.ascontiguousarray(h, "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        ones += np.unpackbits(h[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _fingerprint(text: str) -> int:
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not w:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    grams = zip(w, w[1:], w[2:]) if len(w) > 2 else [w]
    return majority(np.array([digest(join(g), 42) for g in grams], "<u8"))


@F.pandas_udf(T.LongType())
def simhash(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """SimHash of the whole text's 3-word shingles, as a signed long; null and wordless texts have 0. A value for
    each row, repeats included: equal texts have equal ones."""
    for texts in batches:
        yield pd.Series(np.array([_fingerprint(t) if t else 0 for t in texts], np.uint64).view(np.int64))
    give_back()


def _bits(f: np.ndarray) -> np.ndarray:
    return np.unpackbits(f.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints (column f), and how many have bits i and j both: a matrix of fixed size."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((64, 64), np.int64)
        for frame in frames:
            x = _bits(frame["f"].to_numpy()).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        i, j = np.triu_indices(64)
        yield pd.DataFrame({"i": i, "j": j, "n": total[i, j]})

    rows = fps.select("f").mapInPandas(count, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n")).collect()
    both = np.zeros((64, 64))
    for r in rows:
        both[r.i, r.j] = both[r.j, r.i] = r.n
    return fps.count(), both


def correlated_partitions(n: int, both: np.ndarray, m: int) -> list[list[int]]:
    """Bits in m partitions of near equal width; each is grown from the bit of the strongest ties left by
    the bit that is most correlated, on average, with those it has."""
    p = np.diag(both) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    left, out = list(range(64)), []
    for k in range(m):
        width = 64 // m + (k < 64 % m)
        part = [max(left, key=lambda b: (corr[b, left].sum(), -b))]
        left.remove(part[0])
        while len(part) < width:
            b = max(left, key=lambda b: (corr[b, part].mean(), -b))
            part.append(b)
            left.remove(b)
        out.append(sorted(part))
    return out


def near_share(n: int, both: np.ndarray, bits: list[int], most: int) -> list[float]:
    """The estimated share of pairs that differ in at most 0, 1, ..., most of the bits."""
    p = np.diag(both)[bits] / max(n, 1)
    dist = np.zeros(most + 1)
    dist[0] = 1
    for d in 2 * p * (1 - p):
        dist[1:] = dist[1:] * (1 - d) + dist[:-1] * d
        dist[0] *= 1 - d
    return np.cumsum(dist).tolist()


def allocate(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions (bits) with their thresholds, those of -1 left out: the cheapest over 2 to 6 partitions."""
    best: tuple[float, list[tuple[list[int], int]]] = (float("inf"), [])
    for m in range(2, radius + 4):
        parts = correlated_partitions(n, both, m)
        # state: the sum of thresholds so far; value: cost and the thresholds
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for bits in parts:
            share = near_share(n, both, bits, radius)
            probes, costs = 0, {-1: 0.0}
            for t in range(radius + 1):
                probes += len(list(combinations(range(len(bits)), t))) if t else 1
                costs[t] = n * n / 2 * share[t] + PROBE_COST * n * probes
            step: dict[int, tuple[float, list[int]]] = {}
            for total, (cost, chosen) in table.items():
                for t, c in costs.items():
                    if total + t not in step or cost + c < step[total + t][0]:
                        step[total + t] = (cost + c, [*chosen, t])
            table = step
        cost, chosen = table[radius - m + 1]
        if cost < best[0]:
            best = (cost, [(bits, t) for bits, t in zip(parts, chosen) if t >= 0])
    return best[1]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _variants(bits: list[int], t: int) -> list[int]:
    return [_signed(sum(1 << b for b in c)) for k in range(t + 1) for c in combinations(bits, k)]


def _forest(f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is within the radius: one for each fingerprint that another one reaches."""
    out: list[tuple[int, int]] = []
    left = f.copy()
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            near = np.bitwise_count((left ^ x).view(np.uint64)) <= radius
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                queue += list(found)
                left = left[~near]
    return out


def _links(keys: np.ndarray, f: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within the runs of equal keys. Small runs: pairs at each distance; large ones: a forest."""
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    sizes = np.diff(np.append(starts, len(keys)))
    out: list[tuple[int, int]] = []
    run = np.repeat(np.arange(len(starts)), sizes)
    small = np.repeat(sizes, sizes)
    at = np.flatnonzero((small > 1) & (small <= SMALL))
    g, x = run[at], f[at]
    for d in range(1, SMALL):
        if len(g) <= d:
            break
        same = g[d:] == g[:-d]
        if not same.any():
            break
        a, b = x[:-d][same], x[d:][same]
        near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
        out += list(zip(a[near].tolist(), b[near].tolist()))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL]):
        out += _forest(f[s : s + n], radius)
    return out


def fingerprint_links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between distinct fingerprints (column f) that connect all that are within the radius.

    Each link is between two fingerprints within the radius, and two such fingerprints are always
    connected by links. A value that more than BLOCK fingerprints share is dealt in pairs of blocks,
    so a task holds two blocks at most; a run of k fingerprints gives at most SMALL * k / 2 links."""
    n, both = bit_counts(fps)
    plan = allocate(n, both, radius)
    keyed = None
    for i, (bits, t) in enumerate(plan):
        mask = _signed(sum(1 << b for b in bits))
        one = fps.select("f", F.lit(i).alias("part"), F.explode(F.array(*[F.lit(v).cast("long") for v in _variants(bits, t)])).alias("v"))
        one = one.select("f", "part", F.col("f").bitwiseAND(F.lit(mask).cast("long")).bitwiseXOR(F.col("v")).alias("value"))
        keyed = one if keyed is None else keyed.unionByName(one)
    hot = keyed.groupBy("part", "value").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("part", "value", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))
    dealt = keyed.join(hot, ["part", "value"], "left").withColumn("own", F.pmod(F.xxhash64("f"), F.coalesce("blocks", F.lit(1))).cast("int"))
    meets = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = dealt.select("f", "part", "value", "own", F.explode(meets).alias("other"))
    key = F.xxhash64("part", "value", F.least("own", "other"), F.greatest("own", "other"))
    rows = dealt.select(key.alias("key"), "f").repartition(scan_parallelism(fps.sparkSession), "key").sortWithinPartitions("key", "f")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, f = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for frame in frames:
            keys, f = np.concatenate([keys, frame["key"].to_numpy()]), np.concatenate([f, frame["f"].to_numpy()])
            whole = np.searchsorted(keys, keys[-1]) if len(keys) else 0  # the last run may go on
            if whole:
                yield pd.DataFrame(_links(keys[:whole], f[:whole], radius), columns=["a", "b"], dtype=np.int64)
                keys, f = keys[whole:], f[whole:]
        if len(keys):
            yield pd.DataFrame(_links(keys, f, radius), columns=["a", "b"], dtype=np.int64)

    return rows.mapInPandas(search, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """One row for each row of docs: doc_id, sha (of the text), f (the fingerprint), fingerprint (16 hex
    digits), component (the least fingerprint reachable), component_id (the smallest identifier reachable
    through links, null if all are null).

    Null and empty texts have fingerprint zero and are linked as any other. Equal fingerprints are one
    node whatever their number; a hot fingerprint's rows meet its component in a join that is split
    where it is skewed."""
    text = text_or_empty(text_col)
    base = cut(docs.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("sha"), simhash(text).alias("f")))
    fps = cut(base.groupBy("f").agg(F.min("doc_id").alias("first")))
    found = components(fingerprint_links(fps, radius))
    labelled = fps.join(found.withColumnRenamed("node", "f"), "f", "left").select("f", "first", F.coalesce("component", "f").alias("component"))
    named = labelled.groupBy("component").agg(F.min("first").alias("component_id"))
    of = labelled.join(named, "component").select("f", "component", "component_id")
    hexed = F.lpad(F.lower(F.hex("f")), 16, "0")
    return base.join(of, "f").select("doc_id", "sha", "f", hexed.alias("fingerprint"), "component", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: that of the smallest identifier (null identifiers come last;
    among equal ones the text of the least SHA-256). Columns stay as they are; of rows with the same
    identifier and text any one stays, whole."""
    return keep_least(docs, near_duplicates(docs, id_col, text_col, radius), id_col, text_col)


def keep_least(docs: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """docs with the row of each component of found (doc_id, sha, component) that keep_first takes."""
    one = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")
    keys = found.groupBy("component", "doc_id", "sha").agg(F.count("*").alias("rows"))
    least = cut(keys.groupBy("component").agg(F.min_by("rows", one).alias("rows"), F.min(one).alias("s")).select(F.col("s.doc_id").alias("__id"), F.col("s.sha").alias("__sha"), "rows"))
    key, id_, sha, rows = own(docs, "key", "id", "sha", "rows")
    marked = docs.withColumn(key, F.unhex(F.sha2(text_or_empty(text_col), 256)))
    least = least.select(F.col("__id").alias(id_), F.col("__sha").alias(sha), F.col("rows").alias(rows))
    same = F.col(id_col).eqNullSafe(F.col(id_)) & (F.col(key) == F.col(sha))
    stay = marked.join(least.where(F.col(rows) == 1), same, "left_semi")
    if least.where(F.col(rows) > 1).limit(1).count():  # the same row again and again
        stay = stay.unionByName(marked.join(least.where(F.col(rows) > 1), same, "left_semi").dropDuplicates([id_col, key]))
    return stay.drop(key)


__all__ = ["allocate", "keep_first", "keep_least", "near_duplicates", "simhash"]
