"""Token counts: batch encoding inside Arrow functions that return lengths only.

A byte-level BPE never merges across a pre-token, and a space that stands after a non-space always
begins a pre-token. Such a space is a safe boundary: texts are split there, every distinct chunk of
a batch is encoded once by the library, and counts (or ids) are put together from the chunks.
Texts with runs of white space before a space, or with the string of a special token, are encoded
whole by the library.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, tokenizer_path

BATCH_BYTES = 8 << 20
LONG_BYTES = 1 << 20
#: Bytes of chunks and their ids that a worker keeps from batch to batch and from task to task.
KEPT_BYTES = 32 << 20
#: White space (any) and then a space: splitting at that space would cut a run of white space.
_RUN = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_SPACE = _RUN[:-1]
#: What is empty, or has white space at an end.
_ENDS = rf"^$|^{_SPACE}|{_SPACE}$"
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def taken(flat: np.ndarray, begin: np.ndarray, size: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of flat that index names, one after the other, and their sizes; run i has size[i] from begin[i]."""
    n = size[index]
    ends = np.cumsum(n)
    shift = begin[index] - (ends - n)
    return flat[np.repeat(shift, n) + np.arange(int(ends[-1]) if len(ends) else 0)], n


def joined(strings: pa.Array, by: str) -> str:
    return pc.binary_join(pa.LargeListArray.from_arrays([0, len(strings)], strings), pa.scalar(by, pa.large_string()))[0].as_py()


class ChunkStore:
    """Ids of chunks that were encoded before, bounded by bytes: what does not fit makes the store start
    anew. It outlives a task, so a worker encodes a frequent chunk once. Chunks stay in one Arrow array."""

    def __init__(self, most_bytes: int):
        self.most_bytes = most_bytes
        self._empty()

    def _empty(self) -> None:
        self.known = pa.array([], pa.large_string())
        self.flat = np.zeros(0, np.uint32)
        self.ends = np.zeros(1, np.int64)  # entry i + 1: where chunk i's ids end

    @property
    def used(self) -> int:
        return self.known.nbytes + self.flat.nbytes + self.ends.nbytes

    def find(self, chunks: pa.Array, encode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For distinct chunks: a buffer of ids, and where in it each chunk's begin and how many there are.
        encode(new chunks) gives their ids one after the other, and how many each has."""
        chunks = chunks.cast(pa.large_string())
        if self.used + chunks.nbytes > self.most_bytes:
            self._empty()
        at = pc.index_in(chunks, value_set=self.known)
        if at.null_count:
            new = chunks.filter(pc.is_null(at))
            ids, counts = encode(new)
            place = np.full(len(chunks), -1)
            missing = at.is_null().to_numpy(zero_copy_only=False)
            place[~missing] = at.drop_null().to_numpy()
            place[missing] = len(self.known) + np.arange(len(new))
            self.known = pa.concat_arrays([self.known, new])
            self.ends = np.concatenate([self.ends, len(self.flat) + np.cumsum(counts)])
            self.flat = np.concatenate([self.flat, ids])
        else:
            place = at.to_numpy()
        return self.flat, self.ends[place], self.ends[place + 1] - self.ends[place]

    def ids(self, chunks: pa.Array, encode) -> tuple[np.ndarray, np.ndarray]:
        """The ids of chunks (repeats are fine), one after the other, and how many each has."""
        coded = chunks.dictionary_encode()
        flat, begin, size = self.find(coded.dictionary, encode)
        return taken(flat, begin, size, coded.indices.to_numpy())


class ChunkEncoder:
    """Encodes with the tokenizers library, each distinct chunk once while the store holds it."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        #: Chunks by what follows their space, and texts' first chunks, which have none.
        self.kept, self.heads = ChunkStore(KEPT_BYTES), ChunkStore(KEPT_BYTES // 8)
        self.begins_with_space = np.zeros(self.tok.get_vocab_size(), bool)
        for token, i in self.tok.get_vocab().items():
            self.begins_with_space[i] = token.startswith("Ġ")

    def library(self, texts: list[str]) -> list[np.ndarray]:
        """Ids as the library gives them for whole texts."""
        return [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word with a space before it; no word has white space at its ends. They are encoded as
        one text, in which only a word's first token begins with a space."""
        ids = self.library([" " + joined(words, " ")])[0]
        first = np.flatnonzero(self.begins_with_space[ids])
        if len(first) != len(words):  # a vocabulary of another kind
            return _end_to_end(self.library([" " + w for w in words.to_pylist()]))
        return ids, np.diff(first, append=len(ids))

    def _new_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        odd = pc.match_substring_regex(words, _ENDS)
        some = odd.to_numpy(zero_copy_only=False)
        plain = words.filter(pc.invert(odd)) if some.any() else words
        parts = [self._words(plain.slice(at, 4096)) for at in range(0, len(plain), 4096)]
        parts.append(_end_to_end(self.library([" " + w for w in words.filter(odd).to_pylist()])))
        flat, counts = (np.concatenate(x) for x in zip(*parts))
        if not some.any():
            return flat, counts
        place = np.empty(len(words), np.int64)
        place[~some], place[some] = np.arange(len(plain)), len(plain) + np.arange(some.sum())
        return taken(flat, np.cumsum(counts) - counts, counts, place)

    def _simple(self, texts: pa.Array) -> np.ndarray:
        hard = pc.match_substring_regex(texts, _RUN)
        for s in self.special:
            hard = pc.or_(hard, pc.match_substring(texts, s))
        return ~hard.to_numpy(zero_copy_only=False)

    def _split(self, texts: pa.Array):
        """A buffer of ids, where each distinct chunk's begin in it and how many they are, then the texts'
        chunks as indices into these, and where each text's chunks begin."""
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        offsets = lists.offsets.to_numpy().astype(np.int64)
        starts = (offsets - offsets[0])[:-1]
        index = coded.indices.to_numpy().astype(np.int64)
        words = coded.dictionary
        # a text's first chunk has no space before it
        head, own = np.unique(index[starts], return_inverse=True)
        index[starts] = len(words) + own
        flat, begin, size = self.kept.find(words, self._new_words)
        first, at, n = self.heads.find(words.take(pa.array(head)), lambda new: _end_to_end(self.library(new.to_pylist())))
        first, n = taken(first, at, n, np.arange(len(n)))
        # the first chunks' ids follow a copy of the buffer's part that is in use
        ids, size = taken(flat, begin, size, np.arange(len(size)))
        size = np.concatenate([size, n])
        return np.concatenate([ids, first]), np.cumsum(size) - size, size, index, starts

    def lengths(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts), np.int64)
        simple = self._simple(texts)
        if simple.any():
            _, _, size, index, starts = self._split(texts.filter(pa.array(simple)))
            out[simple] = np.add.reduceat(size[index], starts)
        if not simple.all():
            whole = texts.filter(pa.array(~simple)).to_pylist()
            out[~simple] = [len(x) for x in self.library(whole)]
        return out

    def ids(self, texts: pa.Array) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
        simple = self._simple(texts)
        if simple.any():
            flat, begin, size, index, starts = self._split(texts.filter(pa.array(simple)))
            ids, n = taken(flat, begin, size, index)
            cuts = np.cumsum(np.add.reduceat(n, starts))[:-1]
            for i, part in zip(np.flatnonzero(simple), np.split(ids, cuts), strict=True):
                out[i] = part
        for i in np.flatnonzero(~simple):
            out[i] = self.library([texts[int(i)].as_py()])[0]
        return out


def _end_to_end(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.zeros(0, np.uint32), *parts]), np.fromiter(map(len, parts), np.int64, len(parts))


@lru_cache(maxsize=4)
def encoder(path: str) -> ChunkEncoder:
    """One encoder (with its cache) for each Python worker and file."""
    return ChunkEncoder(path)


def safe_pieces(text: str, size: int, special: list[str]) -> list[str]:
    """text cut into pieces of about size characters, each cut before a single space between two words.
    Where a special token's string could be cut, or no such space exists, the piece stays longer."""
    if len(text) <= size or any(s in text for s in special if " " in s):
        return [text]
    pieces, at = [], 0
    while len(text) - at > size and (m := _SAFE.search(text, at + size)):
        pieces.append(text[at : m.start()])
        at = m.start()
    return [*pieces, text[at:]]


def byte_batches(sizes: np.ndarray, target: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about target bytes each; a row that is larger stands alone."""
    begin, total = 0, 0
    for i, n in enumerate(sizes.tolist()):
        if i > begin and total + n > target:
            yield begin, i
            begin, total = i, 0
        total += n
    if begin < len(sizes):
        yield begin, len(sizes)


def count_tokens(texts: pa.Array, enc: ChunkEncoder, batch_bytes: int = BATCH_BYTES, long_bytes: int = LONG_BYTES) -> np.ndarray:
    texts = pc.fill_null(texts, "")
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros(len(texts), np.int64)
    for a, b in byte_batches(sizes, batch_bytes):
        part = texts.slice(a, b - a)
        if b - a == 1 and sizes[a] > long_bytes:
            pieces = safe_pieces(part[0].as_py(), long_bytes, enc.special)
            for p in pieces:
                out[a] += int(enc.lengths(pa.array([p]))[0])
        else:
            out[a:b] = enc.lengths(part)
    return out


def token_counts(docs: DataFrame, text_col: str = "text", out_col: str = "n_tokens", vocabulary: str = "byte_bpe_50k.json") -> DataFrame:
    """docs with one more column: the tokens of each whole text, as the library counts them without
    added special tokens (their strings inside a text are special tokens, its default).

    Null and empty texts have 0. Rows are neither lost nor merged; other columns stay as they are
    (a column named out_col is replaced)."""
    path = tokenizer_path(vocabulary)

    @F.arrow_udf("long")
    def lengths(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        enc = encoder(path)
        for texts in batches:
            yield pa.array(count_tokens(texts.cast(pa.string()), enc))
        give_back()

    return docs.withColumn(out_col, lengths(F.col(text_col)))
