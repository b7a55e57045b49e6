"""Token ids in sorted-string-table shards.

File format (little-endian unless said otherwise), one file a shard:

    blocks   each: u32 stored size, u32 crc32 of what is stored, then zstandard of the entries
    entry    varint shared, varint rest, varint value size, rest bytes of the key, value;
             shared counts the leading bytes that the key has in common with the key before it in
             the block (0 for a block's first)
    value    u64 ids of the shard's documents before this one, u32 count, ids as u16 or u32
    index    for each block: u16 size and bytes of its first key, u64 offset, u32 entries
    bloom    u32 bits, u8 probes, then the bits
    footer   u64 index offset, u64 bloom offset, u64 entries, u64 ids, u8 bytes of an id, 8 bytes magic

A key is 0x00 for a null identifier; 0x01 and the signed 64-bit number, big-endian, with its sign bit
flipped; or 0x02 and a text's UTF-8 bytes. So keys sort as identifiers do.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import give_back, scan_parallelism, size_parallelism, tokenizer_path
from .token_counts import BATCH_BYTES, byte_batches, encoder

MAGIC = b"TLSSTBL1"
BLOCK_BYTES = 64 << 10
SHARD_BYTES = 256 << 20
BLOOM_BITS_PER_KEY, BLOOM_PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQB8s")


def key_of(doc_id: int | str | None) -> bytes:
    if isinstance(doc_id, str):
        return b"\x02" + doc_id.encode("utf-8", "surrogatepass")
    return b"\x00" if doc_id is None else b"\x01" + struct.pack(">Q", (int(doc_id) + (1 << 63)) & ((1 << 64) - 1))


def id_of(key: bytes) -> int | str | None:
    if key[:1] == b"\x02":
        return key[1:].decode("utf-8", "surrogatepass")
    return None if key == b"\x00" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(b: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        x = b[at]
        at += 1
        n |= (x & 127) << shift
        if x < 128:
            return n, at
        shift += 7


def _probes(key: bytes, bits: int, probes: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & ((1 << 64) - 1), (h >> 64) | 1
    return [(a + i * b) % bits for i in range(probes)]


class TableWriter:
    """Writes one shard; keys must come in ascending order (equal keys may follow each other)."""

    def __init__(self, out, id_bytes: int):
        import zstandard

        self.out, self.id_bytes, self.dtype = out, id_bytes, np.uint16 if id_bytes == 2 else np.uint32
        self.zip = zstandard.ZstdCompressor(level=1)
        self.at = self.entries = self.ids = 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self._new_block()

    def _new_block(self) -> None:
        self.block, self.last, self.first, self.held = bytearray(), b"", b"", 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        shared = 0
        if self.held:
            shared = next((i for i, (x, y) in enumerate(zip(key, self.last)) if x != y), min(len(key), len(self.last)))
        else:
            self.first = key
        value = struct.pack("<QI", self.ids, len(ids)) + ids.astype(self.dtype).tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.held += 1
        self.entries += 1
        self.ids += len(ids)
        if not self.keys or self.keys[-1] != key:
            self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.held:
            stored = self.zip.compress(bytes(self.block))
            self.index.append((self.first, self.at, self.held))
            self._put(struct.pack("<II", len(stored), zlib.crc32(stored)) + stored)
            self._new_block()

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def close(self) -> None:
        self._flush()
        index_at = self.at
        self._put(b"".join(struct.pack("<H", len(k)) + k + struct.pack("<QI", at, n) for k, at, n in self.index))
        bloom_at = self.at
        bits = max(64, BLOOM_BITS_PER_KEY * len(self.keys))
        flags = bytearray((bits + 7) // 8)
        for k in self.keys:
            for p in _probes(k, bits, BLOOM_PROBES):
                flags[p >> 3] |= 1 << (p & 7)
        self._put(struct.pack("<IB", bits, BLOOM_PROBES) + bytes(flags))
        self._put(_FOOTER.pack(index_at, bloom_at, self.entries, self.ids, self.id_bytes, MAGIC))
        self.out.close()


class TableReader:
    """Reads one shard; get() takes one block from the file, found by Bloom filter and binary search."""

    def __init__(self, file):
        import zstandard

        self.file, self.unzip = file, zstandard.ZstdDecompressor()
        size = file.size()
        foot = self._at(size - _FOOTER.size, _FOOTER.size)
        self.index_at, bloom_at, self.entries, self.ids, id_bytes, magic = _FOOTER.unpack(foot)
        if magic != MAGIC:
            raise ValueError("not a shard of token ids")
        self.dtype = np.dtype("<u2" if id_bytes == 2 else "<u4")
        raw, at = self._at(self.index_at, bloom_at - self.index_at), 0
        self.firsts, self.offsets = [], []
        while at < len(raw):
            (n,) = struct.unpack_from("<H", raw, at)
            self.firsts.append(raw[at + 2 : at + 2 + n])
            self.offsets.append(struct.unpack_from("<QI", raw, at + 2 + n)[0])
            at += 14 + n
        head = self._at(bloom_at, 5)
        self.bits, self.probes = struct.unpack("<IB", head)
        self.flags = self._at(bloom_at + 5, (self.bits + 7) // 8)

    def _at(self, offset: int, size: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(size)

    def _block(self, i: int) -> Iterator[tuple[bytes, int, np.ndarray]]:
        size, crc = struct.unpack("<II", self._at(self.offsets[i], 8))
        stored = self._at(self.offsets[i] + 8, size)
        if zlib.crc32(stored) != crc:
            raise ValueError("a block's checksum is wrong")
        raw, at, key = self.unzip.decompress(stored), 0, b""
        while at < len(raw):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            start, count = struct.unpack_from("<QI", raw, at)
            yield key, start, np.frombuffer(raw, self.dtype, count, at + 12)
            at += n

    def __iter__(self) -> Iterator[tuple[int | str | None, int, np.ndarray]]:
        for i in range(len(self.offsets)):
            for key, start, ids in self._block(i):
                yield id_of(key), start, ids

    def may_hold(self, key: bytes) -> bool:
        return all(self.flags[p >> 3] & 1 << (p & 7) for p in _probes(key, self.bits, self.probes))

    def get(self, doc_id: int | str | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier, in the file's order."""
        key = key_of(doc_id)
        if not self.firsts or not self.may_hold(key):
            return []
        i = max(0, bisect.bisect_left(self.firsts, key) - 1)
        out = []
        while i < len(self.firsts) and self.firsts[i] <= key:
            out += [ids for k, _, ids in self._block(i) if k == key]
            i += 1
        return out


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tables(docs: DataFrame, to: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 0, shards: int | None = None) -> list[dict]:
    """Encodes every whole text, appends end_id, and writes shards in ascending order of id_col below
    the URI `to`, with a manifest that names them in order with their first document's start.

    Identifiers are whole numbers or texts. Null texts are empty; null identifiers come first; rows with equal identifiers are all kept, side
    by side. Shard files carry a random part in their names and count only once the manifest names
    them, so a task that is run again leaves the result as it is. The driver gets one row a shard."""
    spark, path = docs.sparkSession, tokenizer_path(vocabulary)
    shards = shards or size_parallelism(docs)
    text_ids = isinstance(docs.schema[id_col].dataType, StringType)
    rows = (
        docs.select(F.col(id_col).cast("string" if text_ids else "long").alias("k"), F.col(text_col).cast("string").alias("t"))
        .withColumn("tie", F.xxhash64("t"))
        .withColumn("row", F.monotonically_increasing_id())
        .repartitionByRange(shards, F.col("k").asc_nulls_first(), "tie", "row")
        .sortWithinPartitions(F.col("k").asc_nulls_first(), "tie", "row")
        .select(F.spark_partition_id().alias("p"), "k", "t")
    )
    _, base = _store(to)
    _store(to)[0].create_dir(base, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        id_bytes = 2 if enc.tok.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        store, root = _store(to)
        writer, name, done = None, "", []
        number = part = 0

        def close() -> None:
            writer.close()
            done.append({"partition": part, "number": number, "file": name, "entries": writer.entries, "ids": writer.ids})

        for b in batches:
            texts = pc.fill_null(b.column("t"), "")
            sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
            keys = b.column("k").to_pylist()
            if len(keys):
                part = b.column("p")[0].as_py()
            for lo, hi in byte_batches(sizes, BATCH_BYTES):
                for k, ids in zip(keys[lo:hi], enc.ids(texts.slice(lo, hi - lo))):
                    if writer is not None and writer.at >= SHARD_BYTES:
                        close()
                        writer, number = None, number + 1
                    if writer is None:
                        name = f"part-{part:05d}-{number:03d}-{uuid.uuid4().hex[:12]}.sst"
                        writer = TableWriter(store.open_output_stream(f"{root}/{name}"), id_bytes)
                    writer.add(key_of(k), np.append(ids, np.uint32(end_id)))
        if writer is not None:
            close()
        give_back()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("partition", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("entries", pa.int64()), ("ids", pa.int64())]))

    made = rows.mapInArrow(write, "partition int, number int, file string, entries long, ids long").collect()
    start, manifest = 0, []
    for r in sorted(made, key=lambda r: (r.partition, r.number)):
        manifest.append({"file": r.file, "start": start, "entries": r.entries, "ids": r.ids, "keys": "string" if text_ids else "long"})
        start += r.ids
    store, root = _store(to)
    with store.open_output_stream(f"{root}/manifest.json") as f:
        f.write(json.dumps(manifest).encode())
    return manifest


def read_tables(spark: SparkSession, at: str) -> DataFrame:
    """Every entry of the shards below the URI `at`: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers), and the shard's file."""
    store, root = _store(at)
    with store.open_input_file(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    kind = manifest[0]["keys"] if manifest else "long"
    names = spark.createDataFrame([(m["file"], m["start"]) for m in manifest], "file string, base long")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _store(at)
        for frame in frames:
            for name, base in zip(frame["file"], frame["base"]):
                out = []
                with store.open_input_file(f"{root}/{name}") as f:
                    for doc_id, start, ids in TableReader(f):
                        out.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), name))
                        if len(out) >= 20_000:
                            yield _frame(out, kind)
                            out = []
                yield _frame(out, kind)

    return names.repartition(max(1, min(len(manifest), scan_parallelism(spark)))).mapInPandas(read, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long, shard string")


def _frame(rows: list[tuple], kind: str) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
    return out.astype({"doc_id": "Int64" if kind == "long" else object, "start": "int64", "n_tokens": "int64", "ids_crc32": "int64", "shard": object})
