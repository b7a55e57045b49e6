"""Near-duplicates by the Jaccard similarity of five-word shingles.

Candidates are what the SimHash search of near_duplicates finds among fingerprints of five-word shingles, and
verified on their whole shingle sets before they are linked. At a similarity of 0.8 two fingerprints differ in
some 10 of 64 bits, far beyond any radius that partitions can search; so texts that agree in a band of a
MinHash sketch are candidates, too. Texts of the same shingle set are one node whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, give_back, scan_parallelism, text_or_empty
from .components import components
from .near_duplicates import RADIUS, fingerprint_links, keep_least, majority
from .quality_ratio import sieved

WORDS = 5
SIMILARITY = 0.8
#: A pair of similarity s agrees in no band with probability (1 - s**ROWS)**BANDS: 3e-5 at 0.8.
BANDS, ROWS = 20, 4
#: Bytes of shingle sets of one band value that meet in one task; above, they meet in pairs of such blocks.
BLOCK_BYTES = 16 << 20
_RNG = np.random.default_rng(20)
_ADD, _MUL = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS, 1), np.uint64)
_MUL = _MUL | np.uint64(1)
SKETCH = T.StructType([T.StructField("f", T.LongType()), T.StructField("size", T.LongType()), T.StructField("simhash", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])


def shingles(text: str) -> np.ndarray:
    """Hashes of the text's distinct shingles, in ascending order; a text of fewer words is one shingle."""
    import xxhash

    w = text.encode("utf-8", "surrogatepass").lower().split()  # ASCII letters and ASCII white space only
    if not w:
        return np.zeros(0, np.uint64)
    digest, join = xxhash.xxh3_64_intdigest, b" ".join
    return np.unique(np.array([digest(join(w[i : i + WORDS])) for i in range(max(len(w) - WORDS + 1, 1))], np.uint64))


def _sketch(text: str) -> tuple[int, int, int, list[int]]:
    import xxhash

    s = shingles(text)
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(s), 4096):
        low = np.minimum(low, ((s[at : at + 4096] ^ _ADD) * _MUL).min(axis=1))
    bands = [xxhash.xxh3_64_intdigest(low[b * ROWS : (b + 1) * ROWS].tobytes(), b) for b in range(BANDS)]
    f, h, *bands = np.array([xxhash.xxh3_64_intdigest(s.tobytes()), majority(s), *bands], np.uint64).view(np.int64).tolist()
    return f, len(s), h, bands


@F.pandas_udf(SKETCH)
def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """f (a digest of the shingle set), its size, its SimHash, and the values of the MinHash bands."""
    for texts in batches:
        yield pd.DataFrame([_sketch(t) for t in texts], columns=SKETCH.names)
    give_back()


@F.pandas_udf(T.BinaryType())
def shingle_bytes(texts: pd.Series) -> pd.Series:
    return pd.Series([shingles(t).tobytes() for t in texts], dtype=object)


def similar_links(f: np.ndarray, sets: list[bytes], similarity: float) -> list[tuple[int, int]]:
    """Links that connect all that reach the similarity: one for each set that another one reaches."""
    sizes = np.array([len(s) // 8 for s in sets])
    _, ids = np.unique(np.frombuffer(b"".join(sets), np.uint64), return_inverse=True)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.zeros(len(ids) + 1, bool)
    left, out = np.flatnonzero(sizes), []
    flat, owner = ids, np.repeat(np.arange(len(f)), sizes)
    alive = np.ones(len(f), bool)
    while len(left):
        queue = [left[0]]
        alive[left[0]] = False
        while queue:
            x = queue.pop()
            own = ids[starts[x] : starts[x + 1]]
            marked[own] = True
            common = np.bincount(owner[marked[flat]], minlength=len(f))
            marked[own] = False
            near = np.flatnonzero(alive & (common > 0) & (common >= similarity * (sizes[x] + sizes - common) - 1e-9))
            out += [(int(f[x]), int(f[y])) for y in near]
            alive[near] = False
            queue += near.tolist()
            if 2 * alive[owner].sum() < len(flat):  # the others are settled or in the queue
                flat, owner = flat[alive[owner]], owner[alive[owner]]
        left = left[alive[left]]
    return out


def _simhash_keys(nodes: DataFrame) -> DataFrame:
    """(f, sha, size, key): nodes with one fingerprint meet under it; fingerprints within the radius meet, a node
    for each, under a key of their own."""
    some = nodes.where("size > 0").select("f", "sha", "size", "simhash")
    same = some.select("f", "sha", "size", F.xxhash64(F.lit("same"), "simhash").alias("key"))
    one = cut(some.groupBy("simhash").agg(F.min(F.struct("f", "sha", "size")).alias("s")).select("simhash", "s.*"))
    pairs = cut(fingerprint_links(one.select(F.col("simhash").alias("f")), RADIUS).distinct())
    ends = F.explode(F.array("a", "b")).alias("simhash")
    near = pairs.select(F.xxhash64(F.lit("near"), "a", "b").alias("key"), ends).join(one, "simhash")
    return same.unionByName(near.select("f", "sha", "size", "key"))


def _candidate_links(docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Verified links between nodes (f, sha, size, simhash, bands). docs: __doc (sha) and text."""
    spark = docs.sparkSession
    keyed = nodes.select("f", "sha", "size", F.explode("bands").alias("key")).unionByName(_simhash_keys(nodes))
    meet = keyed.groupBy("key").agg(F.count("*").alias("n"), F.ceil(8 * F.sum("size") / BLOCK_BYTES).cast("int").alias("blocks")).where("n > 1 and blocks > 0")
    rows = cut(keyed.join(meet, "key").select("f", "sha", "key", "blocks"))
    wanted = cut(rows.groupBy(F.col("sha").alias("__id")).agg(F.first("f").alias("f")))
    texts = sieved(docs, wanted).groupBy("__doc").agg(F.first("text").alias("text"))
    sets = texts.join(wanted.hint("shuffle_hash"), F.col("__doc") == F.col("__id")).select("f", shingle_bytes("text").alias("set"))
    dealt = rows.withColumn("own", F.pmod(F.xxhash64("f"), F.col("blocks")).cast("int"))
    dealt = dealt.select("f", "key", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    key = F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other"))
    dealt = dealt.select("f", key.alias("key")).join(sets.hint("shuffle_hash"), "f")
    dealt = dealt.repartition(scan_parallelism(spark), "key").sortWithinPartitions("key", "f")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, f, sets = np.zeros(0, np.int64), np.zeros(0, np.int64), []

        def links(end: int) -> pd.DataFrame:
            out, at = [], np.flatnonzero(np.append(True, keys[1:end] != keys[: end - 1]))
            for a, b in zip(at, [*at[1:], end]):
                out += similar_links(f[a:b], sets[a:b], similarity) if b - a > 1 else []
            return pd.DataFrame(sorted(set(out)), columns=["a", "b"], dtype=np.int64)

        for frame in frames:
            keys, f = np.concatenate([keys, frame["key"].to_numpy()]), np.concatenate([f, frame["f"].to_numpy()])
            sets += list(frame["set"])
            whole = int(np.searchsorted(keys, keys[-1])) if len(keys) else 0  # the last run may go on
            if whole:
                yield links(whole)
                keys, f, sets = keys[whole:], f[whole:], sets[whole:]
        if len(keys):
            yield links(len(keys))
        give_back()

    return dealt.mapInPandas(search, "a long, b long")


def similar_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row for each row of docs: doc_id, sha (of the text), component (a node reachable through
    texts that reach the similarity one after the other). Null and wordless texts are one node."""
    text = text_or_empty(text_col)
    sha = F.unhex(F.sha2(text, 256))
    base = cut(docs.select(F.col(id_col).alias("doc_id"), sha.alias("sha"), sketch(text).alias("s")).select("doc_id", "sha", "s.*"))
    nodes = cut(base.groupBy("f").agg(F.min(F.struct("sha", "size", "simhash", "bands")).alias("s")).select("f", "s.*"))
    found = components(_candidate_links(docs.select(sha.alias("__doc"), text.alias("text")), nodes, similarity))
    # nodes without links are their own components; copies of a node meet found's one row in a split join
    return base.join(found.withColumnRenamed("node", "f"), "f", "left").select("doc_id", "sha", F.coalesce("component", "f").alias("component"))


def keep_first_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """docs with one row of each component of similar texts: that which keep_first takes. Columns stay as they
    are, whatever their names; repeated rows are one, null and wordless texts one component; an empty table
    stays empty."""
    return keep_least(docs, similar_texts(docs, id_col, text_col, similarity), id_col, text_col)


__all__ = ["keep_first_similar", "shingles", "similar_texts"]
