"""Token ids in sorted-string-table shards.

A shard file holds documents in ascending key order: data blocks of prefix-compressed entries, a sparse index with each
block's first key and place, a Bloom filter over all keys and a footer. A key is a null flag and the document id in big
endian with its sign turned, so bytes sort as ids do. Lookup tests the filter, finds the block by binary search in the
index and reads that block alone. Layout of a file, little endian throughout:

    block*   entry*: u8 bytes shared with the key before, u8 other key bytes, u32 value bytes, key bytes, value (ids)
    index    for each block: 9 key bytes, u64 place, u32 bytes, u64 ids before it in this shard
    filter   bits, 10 for each key, 7 probes
    footer   u64 place of index, of filter, of footer; u64 documents; u64 ids; u32 bytes for an id; 8 bytes magic

Documents with null or empty text hold the end id alone; equal ids lie side by side, in the order of a hash of their texts, over as many
shards and tasks as they need, and so do repeated rows; null ids come first. A very long text is one entry of a block of its own size. An empty table makes no shard. Columns other than doc_id
and text are never read. The manifest has each shard's first and last id, so a lookup opens those shards alone that may hold one.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoder import encoder, path_of
from .shared import record_batches, scratch, texts, written

MAGIC = b"TLSST001"
BLOCK, SHARD, BITS, PROBES = 64_000, 64_000_000, 10, 7
_ENTRY, _INDEX, _FOOTER = struct.Struct("<BBI"), struct.Struct("<9sQIQ"), struct.Struct("<QQQQQI8s")
MANIFEST = "part long, shard long, path string, n_docs long, n_ids long, first_id long, last_id long"
_MANIFEST = pa.schema([("part", pa.int64()), ("shard", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64())])


def key_of(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key[1:])[0] - (1 << 63) if key[0] else None


def probes(key: bytes, bits: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % (1 << 64) % bits for i in range(PROBES)]


class ShardWriter:
    """Writes one shard; keys must come in ascending order. The file appears under its name only once it is whole."""

    def __init__(self, path: str, width: int):
        self.fs, self.path = fs.FileSystem.from_uri(path)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}"
        self.out, self.width = self.fs.open_output_stream(self.part), width
        self.block, self.index, self.keys, self.last, self.place, self.n_ids, self.before, self.first = bytearray(), [], [], b"", 0, 0, 0, b""

    def add(self, doc_id: int | None, ids: bytes) -> None:
        key = key_of(doc_id)
        if not self.block:
            self.first, self.last, self.before = key, b"", self.n_ids
        shared = next((i for i, (x, y) in enumerate(zip(self.last, key)) if x != y), min(len(self.last), 9))
        self.block += _ENTRY.pack(shared, 9 - shared, len(ids)) + key[shared:] + ids
        self.keys.append(key)
        self.last, self.n_ids = key, self.n_ids + len(ids) // self.width
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.out.write(bytes(self.block))
            self.index.append(_INDEX.pack(self.first, self.place, len(self.block), self.before))
            self.place += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        bits = max(64, BITS * len(self.keys))
        bloom = np.zeros(bits, bool)
        for key in self.keys:
            bloom[probes(key, bits)] = True
        packed, index = np.packbits(bloom, bitorder="little").tobytes(), b"".join(self.index)
        self.out.write(index + packed)
        foot = self.place + len(index) + len(packed)
        self.out.write(_FOOTER.pack(self.place, self.place + len(index), foot, len(self.keys), self.n_ids, self.width, MAGIC))
        self.out.close()
        self.fs.move(self.part, self.path)


class Shard:
    """Reads a shard file: get() for one document, items() for all in order."""

    def __init__(self, path: str):
        where, name = fs.FileSystem.from_uri(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        at_index, at_bloom, foot, self.n_docs, self.n_ids, self.width, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token shard")
        tail = self._read(at_index, foot - at_index)
        self.blocks = list(_INDEX.iter_unpack(tail[: at_bloom - at_index]))
        self.bits = max(64, BITS * self.n_docs)
        self.bloom = np.frombuffer(tail[at_bloom - at_index :], np.uint8)

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def _entries(self, raw: bytes) -> Iterator[tuple[bytes, bytes]]:
        at, key = 0, b""
        while at < len(raw):
            shared, other, n = _ENTRY.unpack_from(raw, at)
            at += _ENTRY.size
            key = key[:shared] + raw[at : at + other]
            yield key, raw[at + other : at + other + n]
            at += other + n

    def may_hold(self, doc_id: int | None) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in probes(key_of(doc_id), self.bits))

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """Ids of each document of that id; none if there is none."""
        if not self.may_hold(doc_id):
            return []
        key, out = key_of(doc_id), []
        i = max(0, bisect_left(self.blocks, key, key=lambda x: x[0]) - 1)
        while i < len(self.blocks) and self.blocks[i][0] <= key:
            out += [np.frombuffer(v, f"<u{self.width}") for k, v in self._entries(self._read(self.blocks[i][1], self.blocks[i][2])) if k == key]
            i += 1
        return out

    def items(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Document id, ids before it in this shard, and its ids' bytes; one block is held at a time."""
        for _, place, n, before in self.blocks:
            for key, ids in self._entries(self._read(place, n)):
                yield id_of(key), before, ids
                before += len(ids) // self.width


def write_store(docs: DataFrame, folder: str, tokenizer: str = "word_bpe_49k.json", end_id: int = 2) -> DataFrame:
    """Writes all documents as shards below folder, in ascending id order over all shards; returns the manifest, written too.

    The manifest has a row for each shard with start, the ids of all shards before it.
    """
    spark = docs.sparkSession
    n = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, enc = TaskContext.get().partitionId(), encoder(path_of(tokenizer))
        width = 2 if enc.tokenizer.get_vocab_size() <= 1 << 16 else 4
        end = np.array([end_id], f"<u{width}").tobytes()

        def shards() -> Iterator[tuple]:
            k, out = 0, None
            for b in batches:
                for a in range(0, b.num_rows, 500):
                    some = b.slice(a, 500)
                    for doc, ids in zip(some.column("doc_id").to_pylist(), enc.many(some.column("text").to_pylist()), strict=True):
                        if out is not None and out.place >= SHARD:
                            out.close()
                            yield part, k, path, len(out.keys), out.n_ids, id_of(out.keys[0]), id_of(out.keys[-1])
                            k, out = k + 1, None
                        if out is None:
                            out = ShardWriter(path := f"{folder}/shard-{part:06d}-{k:04d}.sst", width)
                        out.add(doc, np.frombuffer(ids, "<u4").astype(f"<u{width}").tobytes() + end)
            if out is not None:
                out.close()
                yield part, k, path, len(out.keys), out.n_ids, id_of(out.keys[0]), id_of(out.keys[-1])

        return record_batches(shards(), _MANIFEST)

    # Rows of one id, and even equal rows, may lie in several ranges.
    keys = ["doc_id", "hash", "row"]
    keyed = texts(docs, F.xxhash64(F.col("text").cast("string")).alias("hash"), F.xxhash64(F.monotonically_increasing_id()).alias("row"))
    ordered = keyed.repartitionByRange(n, *keys).sortWithinPartitions(*keys).select("doc_id", "text")
    manifest = written(ordered.mapInArrow(run, MANIFEST), f"{folder}/manifest")
    # A row for each shard of 64 MB: few for any input.
    return manifest.withColumn("start", F.sum("n_ids").over(Window.orderBy("part", "shard")) - F.col("n_ids"))


def read_store(manifest: DataFrame, digest: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document in the shards' files.

    With digest, ids_crc32 of the ids as unsigned 32-bit integers stands for ids.
    """
    value = ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary())
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), value])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist(), strict=True):
                    shard = Shard(path)
                    for doc, before, ids in shard.items():
                        own = np.frombuffer(ids, f"<u{shard.width}").astype("<u4").tobytes()
                        yield doc, start + before, len(own) // 4, zlib.crc32(own) if digest else own

        return record_batches(rows(), schema)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("path", "start").repartition(n).mapInArrow(run, f"doc_id long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids binary'}")


def shards_with(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """path and wanted: the shards whose range of ids has any of the given ones, and which. Null ids are before all others."""
    spark = manifest.sparkSession
    ids = spark.createDataFrame([(i,) for i in sorted({x for x in doc_ids if x is not None})] + [(None,)] * (None in doc_ids), "id long")
    # The ranges are few, a row for each shard, and in order: each id is held against those that begin before it and end after it.
    own = manifest.select("path", "first_id", "last_id")
    here = (ids.id >= F.coalesce(own.first_id, F.lit(-(1 << 63)))) & (ids.id <= own.last_id) | ids.id.isNull() & own.first_id.isNull()
    return ids.join(F.broadcast(own), here).groupBy("path").agg(F.collect_list(F.struct("id")).alias("wanted"))


def lookup(manifest: DataFrame, doc_ids: list[int | None]) -> DataFrame:
    """doc_id and ids of given documents, by range, filter, index and one block each."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                for path, wanted in zip(b.column("path").to_pylist(), b.column("wanted").to_pylist(), strict=True):
                    shard = Shard(path)
                    for doc in wanted:
                        for ids in shard.get(doc["id"]):
                            yield doc["id"], ids.astype("<u4").tobytes()

        return record_batches(rows(), schema)

    return shards_with(manifest, doc_ids).mapInArrow(run, "doc_id long, ids binary")


def store_folder(docs: DataFrame) -> str:
    return scratch(docs.sparkSession, "token-store")
