"""Sorted-string-table shards of token ids, keyed by document.

A shard is one file: data blocks, then an index block, a Bloom filter and a footer.

* A data block is zstandard-compressed; inside, entries stand in ascending key order, each as
  varint(shared), varint(unshared), varint(length of value), the last ``unshared`` bytes of the key
  and the value.  ``shared`` counts the bytes that the key has in common with the one before it.
* The index has an entry per data block: its last key, offset and length.
* A key is a byte 0 for a null doc_id, or 1 and the id as a big-endian number with its sign bit turned,
  so that byte order is numeric order.  A value is the document's ids, unsigned little-endian 32-bit.
* The footer has a fixed length: where index and filter are, counts of entries and ids, the format's magic.

Shards are written by Spark's text writer, a row per block, with the bytes as they are; the line feed
that it puts behind each row lies between the blocks, where no offset points, and ends the magic.  So a
shard goes through the writer's commit protocol, to any store Spark writes, and a lost task leaves none.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterable, Iterator

import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm import tokens
from logweir.llm.storage import fresh_path, lean_batches, materialize, shuffle_partitions

MAGIC = b"LWSST01\n"
FOOTER = struct.Struct("<QQQQQQ8s")  # index at, length; filter at, length; entries; ids; magic
BLOCK_BYTES = 1 << 18
BITS_PER_KEY, PROBES = 10, 7


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def probes(key: bytes, bits: int) -> Iterator[int]:
    a, b = zlib.crc32(key), zlib.crc32(key, 0x5BD1E995) | 1
    return ((a + i * b) % bits for i in range(PROBES))


class ShardWriter:
    """Makes the rows of a shard from entries in key order; holds one block, the index and the keys' hashes."""

    def __init__(self, block_bytes: int = BLOCK_BYTES, level: int = 1):
        self.block_bytes, self.zip = block_bytes, zstandard.ZstdCompressor(level=level)
        self.block, self.last, self.at = bytearray(), b"", 0
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.n_ids = 0

    def _row(self, data: bytes) -> bytes:
        self.at += len(data) + 1
        return data

    def _flush(self) -> bytes:
        data = self.zip.compress(bytes(self.block))
        self.index.append((self.last, self.at, len(data)))
        self.block, self.previous = bytearray(), b""
        return self._row(data)

    def add(self, key: bytes, value: bytes) -> Iterator[bytes]:
        if key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.block, n)
        self.block += key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.n_ids += len(value) // 4
        if len(self.block) >= self.block_bytes:
            yield self._flush()

    def finish(self) -> Iterator[bytes]:
        if self.block:
            yield self._flush()
        out = bytearray()
        for key, at, length in self.index:
            put_varint(out, len(key))
            out += key
            put_varint(out, at)
            put_varint(out, length)
        index_at = self.at
        yield self._row(bytes(out))
        bits = max(64, BITS_PER_KEY * len(self.keys))
        bloom = bytearray((bits + 7) // 8)
        for key in self.keys:
            for p in probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_at = self.at
        yield self._row(bits.to_bytes(8, "little") + bytes(bloom))
        footer = FOOTER.pack(index_at, len(out), bloom_at, len(bloom) + 8, len(self.keys), self.n_ids, MAGIC)
        yield footer[:-1]  # the writer's line feed is the magic's last byte


class ShardReader:
    """Reads a shard from its bytes or anything with ``__getitem__`` for slices, such as an mmap."""

    def __init__(self, data):
        self.data, self.zip = data, zstandard.ZstdDecompressor()
        index_at, index_len, bloom_at, bloom_len, self.n_entries, self.n_ids, magic = FOOTER.unpack(data[len(data) - FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard")
        self.last_keys, self.blocks, at = [], [], 0
        index = data[index_at : index_at + index_len]
        while at < len(index):
            n, at = get_varint(index, at)
            self.last_keys.append(bytes(index[at : at + n]))
            offset, at = get_varint(index, at + n)
            length, at = get_varint(index, at)
            self.blocks.append((offset, length))
        self.bits = int.from_bytes(data[bloom_at : bloom_at + 8], "little")
        self.bloom = data[bloom_at + 8 : bloom_at + bloom_len]

    def block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        at, length = self.blocks[i]
        buf, key, at = self.zip.decompress(self.data[at : at + length]), b"", 0
        while at < len(buf):
            shared, at = get_varint(buf, at)
            rest, at = get_varint(buf, at)
            length, at = get_varint(buf, at)
            key = key[:shared] + buf[at : at + rest]
            at += rest
            yield key, buf[at : at + length]
            at += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.blocks)):
            yield from self.block(i)

    def get(self, doc_id: int | None) -> list[bytes]:
        """Values of an id (several if its rows repeat): the filter first, then a binary search for the block."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key, self.bits)):
            return []
        found, i = [], bisect.bisect_left(self.last_keys, key)
        while i < len(self.blocks):
            here = [(k, v) for k, v in self.block(i) if k >= key]
            found += [v for k, v in here if k == key]
            if any(k > key for k, _ in here):
                break
            i += 1
        return found


def write_shards(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = 2, shard_bytes: int = 32 << 20, split_words: bool = True) -> None:
    """Write the ids of ``docs`` (doc_id, text) to shards below ``path``, in ascending doc_id order across them.

    Rows are dealt out by ranges of doc_id, so that the shards' ranges don't overlap; a range is sized
    to about ``shard_bytes`` of text.  A null text counts as empty and gets the end id alone; a null
    doc_id stands first; rows that repeat a doc_id stay, in order of their texts.  A text of any length
    is one value.  An empty table gives a folder without entries.  Other columns are not read.
    """
    import pyarrow as pa

    spark = docs.sparkSession
    lean_batches(spark)
    tokenizer = tokenizer or tokens.default_path()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)))).first()[0] or 0
    n = max(1, min(shuffle_partitions(spark), 1 + size // (1 << 20)), size // shard_bytes)
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, shard, some = tokens.word_ids(tokenizer, split_words), ShardWriter(), False
        for batch in batches:
            out: list[bytes] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                some = True
                out.extend(shard.add(key_of(doc_id), ids.ids(text.as_py()) + end))
                if len(out) >= 8:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])
                    out = []
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["row"])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(list(shard.finish()), pa.binary())], ["row"])

    dealt = docs.repartitionByRange(int(n), F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    rows = dealt.mapInArrow(encode, "row binary").select(F.col("row").cast("string").alias("value"))
    rows.write.option("lineSep", "\n").option("compression", "none").text(path)


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, shard of every entry, in any order.

    ``start`` counts the ids of all documents before it in key order: those before it in its shard, and
    the totals of the shards before, of which there is one row each.
    """
    import pyarrow as pa

    files = spark.read.format("binaryFile").load(path).filter("length > 0").select(F.element_at(F.split("path", "/"), -1).alias("shard"), "content")

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "local_start", "n_tokens", "ids_crc32", "shard"]
        for batch in batches:
            for shard, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                reader = ShardReader(memoryview(content.as_buffer()).cast("B"))
                rows, at = [], 0
                for key, value in reader:
                    rows.append((id_of(bytes(key)), at, len(value) // 4, zlib.crc32(value), shard))
                    at += len(value) // 4
                if at != reader.n_ids or len(rows) != reader.n_entries:
                    raise ValueError(f"{shard} is damaged")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names)

    entries = materialize(files.mapInArrow(parse, "doc_id long, local_start long, n_tokens long, ids_crc32 long, shard string"), "sst-entries")
    shards = entries.groupBy("shard").agg(F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id")).alias("_first"), F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("_first").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    joined = entries.join(shards, entries["shard"] == shards["_shard"])
    return joined.select("doc_id", (F.col("_before") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard")


def token_shards(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write ``docs`` to shards and return what the written files hold."""
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")
    write_shards(docs, path, **options)
    return read_shards(spark, path)
