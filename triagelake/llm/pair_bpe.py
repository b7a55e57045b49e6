"""BPE encoding and decoding with a pair occurrence index.

The new words of a batch lie in one symbol sequence. Each mergeable pair is mapped to all the
positions where it stands; ranks with positions are taken in ascending order, all positions of a
rank are merged in one sweep, and the pairs that this makes enter the lists of their ranks. A sweep
is a handful of array operations however many positions it has.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import give_back, tokenizer_path
from .token_counts import ChunkStore, byte_batches, joined, taken

#: Bytes of text whose new words are merged together, and whose ids are put together at once.
BATCH_BYTES, JOIN_BYTES = 4 << 20, 1 << 20
#: Bytes of chunks and their ids that a worker keeps from batch to batch and from task to task.
KEPT_BYTES = 32 << 20
#: Letters whose normal form or case may depend on others; the rest are their own NFC form.
_NOT_PLAIN = r"[^\x21-\x7e\xa1-\xac\xae-˿]"


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 bytes for
    themselves, the others in ascending order from U+0100 on."""
    own = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    rest = iter(range(256))
    return [chr(b) if b in own else chr(256 + next(rest)) for b in range(256)]


class PairIndexBPE:
    """Merges words by a pair occurrence index."""

    def __init__(self, path: str):
        import regex

        self.path = path
        spec = json.load(open(path, encoding="utf-8"))
        self.vocab: dict[str, int] = spec["model"]["vocab"]
        self.suffix: str = spec["model"]["end_of_word_suffix"] or ""
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        v, self.letters = self.vocab, byte_letters()
        names = {i: s for s, i in v.items()} | {i: s for s, i in self.added.items()}
        self.tokens = pa.array([names.get(i, "") for i in range(max(names) + 1)], pa.large_string())
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        #: For each rank: the two symbols and what they become; then the pairs' codes, sorted, with their ranks.
        self.pairs = np.array([(v[a], v[b], v[a + b]) for a, b in merges], np.int64)
        codes = self.pairs[:, 0] << 32 | self.pairs[:, 1]
        self.code_rank = np.argsort(codes, kind="stable")
        self.codes = codes[self.code_rank]
        #: A byte's symbol inside a word, and at a word's end.
        self.inner = np.array([v[x] for x in self.letters], np.int64)
        self.final = np.array([v[x + self.suffix] for x in self.letters], np.int64)
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern + r"|\n").findall  # a line's end parts chunks
        self.kept = ChunkStore(KEPT_BYTES)

    @cached_property
    def lib(self):
        """The library, for letters whose normal form is not obvious."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of symbols, -1 for those that don't merge (a border is -1, no symbol)."""
        code = left << 32 | right
        at = np.searchsorted(self.codes, code)
        at[at == len(self.codes)] = 0
        return np.where((self.codes[at] == code) & (left >= 0), self.code_rank[at], -1)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, one after the other, and how many each has. All words share one index; a
        border keeps them apart."""
        if not words:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        end = np.cumsum(size + 1)  # of each word with its border
        n = int(end[-1])
        sym = np.full(n + 1, -1)
        letters = np.ones(n, bool)
        letters[end - 1] = False
        data = np.frombuffer(b"".join(words), np.uint8)
        sym[:n][letters] = self.inner[data]
        last = np.cumsum(size) - 1
        sym[(end - 2)[size > 0]] = self.final[data[last[size > 0]]]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        # the index: positions in the order of their ranks, and where each rank's begin; later ones in lists
        rank = self._ranks(sym[:-1], sym[1:])
        places = np.flatnonzero(rank >= 0)
        places = places[np.argsort(rank[places], kind="stable")]
        first, begin = np.unique(rank[places], return_index=True)
        listed = dict(zip(first.tolist(), zip(begin.tolist(), [*begin[1:].tolist(), len(places)])))
        added: dict[int, list[int]] = {}
        active = first.tolist()  # ascending, so a heap already
        while active:
            r = heapq.heappop(active)
            b, e = listed.pop(r, (0, 0))
            p = places[b:e]
            if (more := added.pop(r, None)) is not None:
                p = np.unique(np.concatenate([p, np.array(more)]))
            x, y, xy = self.pairs[r].tolist()
            j = after[p]
            # a symbol that another merge has taken since it was listed is no longer what it was
            still = (sym[p] == x) & (sym[j] == y)
            if not still.all():
                p, j = p[still], j[still]
            if x == y and len(p) > 1:
                p, j = self._apart(p, j)
            if not len(p):
                continue
            sym[p], sym[j] = xy, -2
            k = after[j]
            after[p], before[k] = k, p
            h = before[p]
            at = np.concatenate([p, h])
            new = self._ranks(sym[at], sym[np.concatenate([k, p])])
            made = np.flatnonzero(new >= 0)
            for q, i in zip(new[made].tolist(), at[made].tolist()):
                if q in added:
                    added[q].append(i)
                else:
                    added[q] = [i]
                    if q not in listed:
                        heapq.heappush(active, q)
        alive = sym[:n] >= 0
        return sym[:n][alive].astype(np.uint32), np.add.reduceat(alive, end - size - 1, dtype=np.int64)

    @staticmethod
    def _apart(p: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of positions of a symbol twice, in ascending order, those that are merged from left to right: in a
        run of the symbol, every second one."""
        taken_, keep = -1, []
        for k, (a, b) in enumerate(zip(p.tolist(), j.tolist())):
            if a != taken_:
                keep.append(k)
                taken_ = b
        return p[keep], j[keep]

    def pre_tokens(self, chunk: str) -> list[bytes]:
        """Normalised pre-tokens of a chunk without ASCII white space, by the library."""
        from_letter = {c: b for b, c in enumerate(self.letters)}
        norm = self.lib.normalizer.normalize_str(chunk)
        return [bytes(from_letter[c] for c in piece) for piece, _ in self.lib.pre_tokenizer.pre_tokenize_str(norm)]

    def _encode_new(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, one after the other, and how many each has."""
        odd = pc.match_substring_regex(chunks, _NOT_PLAIN)
        some = odd.to_numpy(zero_copy_only=False)
        plain = chunks.filter(pc.invert(odd)) if some.any() else chunks
        words: dict[str, int] = {}
        of: list[int] = []  # the words of all chunks
        line: list[int] = []  # and where each chunk's end
        if len(plain):
            for w in self.pieces(joined(plain, "\n").lower()):
                if w == "\n":
                    line.append(len(of))
                else:
                    of.append(words.setdefault(w, len(words)))
            line.append(len(of))
        number = {w.encode("utf-8"): i for w, i in words.items()}
        for c in chunks.filter(odd).to_pylist() if some.any() else ():
            of += [number.setdefault(w, len(number)) for w in self.pre_tokens(c)]
            line.append(len(of))
        ids, n = self.merge_words(list(number))
        flat, size = taken(ids, np.cumsum(n) - n, n, np.array(of, np.int64))
        ends = np.concatenate([[0], np.cumsum(size)])[np.array(line, np.int64)]
        counts = np.diff(np.concatenate([[0], ends]))
        if not some.any():
            return flat, counts
        place = np.empty(len(chunks), np.int64)
        place[~some], place[some] = np.arange(len(plain)), len(plain) + np.arange(some.sum())
        return taken(flat, np.cumsum(counts) - counts, counts, place)

    def _special(self, text: str) -> np.ndarray:
        """A text that has strings of added tokens: these first, the rest between them as chunks."""
        ids, at = [], 0
        for m in [*self.split_added.finditer(text), None]:
            chunks = pc.ascii_split_whitespace(pa.array([text[at : m.start() if m else len(text)]], pa.large_string())).flatten()
            if len(chunks):
                ids.append(self.kept.ids(chunks, self._encode_new)[0])
            if m:
                ids.append(np.array([self.added[m[0]]], np.uint32))
                at = m.end()
        return np.concatenate([np.zeros(0, np.uint32), *ids])

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of some texts after the other, and how many each has; batch by batch, in order."""
        hard = pa.array(np.zeros(len(texts), bool))
        for s in self.added:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        hard = hard.to_numpy(zero_copy_only=False)
        easy = texts if not hard.any() else pc.if_else(pa.array(hard), "", texts)
        lists = pc.ascii_split_whitespace(easy)
        offsets = lists.offsets.to_numpy().astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        index = coded.indices.to_numpy()
        offsets -= offsets[0]
        # white space at a text's ends makes empty chunks, which have no ids
        known, begin, size = self.kept.find(coded.dictionary, self._encode_new)
        sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
        for a, b in byte_batches(sizes, JOIN_BYTES):
            flat, each = taken(known, begin, size, index[offsets[a] : offsets[b]])
            counts = np.diff(np.concatenate([[0], np.cumsum(each)])[offsets[a : b + 1] - offsets[a]])
            if hard[a:b].any():
                parts = np.split(flat, np.cumsum(counts)[:-1])
                for k in np.flatnonzero(hard[a:b]):
                    parts[k] = self._special(texts[a + int(k)].as_py())
                    counts[k] = len(parts[k])
                flat = np.concatenate(parts)
            yield flat, counts

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """The text of each run of ids: tokens joined by a space, as the library does without a decoder."""
        ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        return pc.binary_join(pa.LargeListArray.from_arrays(pa.array(ends), self.tokens.take(pa.array(ids))), pa.scalar(" ", pa.large_string()))


@lru_cache(maxsize=2)
def pair_index_bpe(path: str) -> PairIndexBPE:
    """One for each Python worker and file; what it keeps is bounded by bytes."""
    return PairIndexBPE(path)


CODED = T.StructType([T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])


def _texts(texts: pa.Array) -> Iterator[pa.Array]:
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    for a, b in byte_batches(sizes, BATCH_BYTES):
        yield texts.slice(a, b - a)


def _slices(data, ends: np.ndarray) -> Iterator[memoryview]:
    view, at = memoryview(data), 0
    for e in ends.tolist():
        yield view[at:e]
        at = e


def _digests(bpe: PairIndexBPE, texts: pa.Array) -> pa.Array:
    n, of_ids, of_text = [np.zeros(0, np.int64)], [], []
    for part in _texts(texts):
        for flat, counts in bpe.encode(part):
            n.append(counts)
            of_ids += [hashlib.sha256(x).hexdigest() for x in _slices(flat.astype("<u4").tobytes(), 4 * np.cumsum(counts))]
            of_text += [hashlib.sha256(x.as_buffer()).hexdigest() for x in bpe.decode(flat, counts)]
    return pa.StructArray.from_arrays([pa.array(np.concatenate(n)), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], CODED.names)


def bpe_digests(text: Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    """A struct column: n_tokens, ids_sha256, decoded_sha256 of a text's encoding and its decoding.
    Null is as empty: no ids, and the digests of no bytes."""
    path = tokenizer_path(vocabulary)

    @F.arrow_udf(CODED)
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _digests(pair_index_bpe(path), texts)
            del texts
        give_back()

    return digests(text)


def _encoded(bpe: PairIndexBPE, texts: pa.Array) -> pa.Array:
    """Arrays of ids, put together from whole buffers."""
    flat, n = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
    for part in _texts(texts):
        for ids, counts in bpe.encode(part):
            flat.append(ids.astype(np.int32))
            n.append(counts)
    return pa.ListArray.from_arrays(pa.array(np.cumsum(np.concatenate(n)).astype(np.int32)), pa.array(np.concatenate(flat)))


def bpe_encode(text: Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    """The ids of each text as an array column; null is as empty."""
    path = tokenizer_path(vocabulary)

    @F.arrow_udf("array<int>")
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield _encoded(pair_index_bpe(path), texts)
            del texts
        give_back()

    return encode(text)


def bpe_decode(ids: Column, vocabulary: str = "word_bpe_49k.json") -> Column:
    """The text of each array of ids, special tokens included: tokens joined by a space, as the library
    does without a decoder. Null and empty arrays give the empty text."""
    path = tokenizer_path(vocabulary)

    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        counts = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False)
        return pair_index_bpe(path).decode(rows.flatten().to_numpy(zero_copy_only=False), counts).cast(pa.string())

    return decode(ids)


def bpe_ids(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row for each row of docs, repeats included: its identifier, n_tokens, and ids as an array of ints
    (empty for null and empty texts). Other columns are left out."""
    coded = docs.select(F.col(id_col).alias("k"), bpe_encode(F.col(text_col), vocabulary).alias("ids"))
    return coded.select(F.col("k").alias(id_col), F.size("ids").cast("long").alias("n_tokens"), "ids")


def bpe_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    """One row for each row of docs, repeats included: its identifier (of any type, null too), n_tokens,
    ids_sha256, decoded_sha256. Other columns are left out, so their names clash with nothing; a table
    without rows gives one without rows."""
    coded = docs.select(F.col(id_col).alias("k"), bpe_digests(F.col(text_col), vocabulary).alias("c"))
    return coded.select(F.col("k").alias(id_col), "c.*")
