"""Concatenate and cut: documents' ids laid end to end and cut into windows of a fixed size.

Pass one encodes every text and writes its ids with its place inside its partition; pass two turns the partitions' token
totals into global offsets by a prefix sum (one row for each partition) and cuts every document at the window borders.
No document moves between executors. Only the last sequence is shorter than the window, so there is next to no padding.
Null and empty texts are the end id alone; repeated rows and rows with equal or null ids are packed as often as they occur, in the
order in which they are read; a very long text spans as many sequences as it needs; an empty table gives no pieces; columns other
than doc_id and text are never read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .encoder import encoder, path_of
from .shared import record_batches, scratch, texts, written

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
DIGESTS = PIECES.replace("ids binary", "ids_crc32 long")


def tokenized(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """part, place (ids before the document in its partition), doc_id and ids of every text, written in the scratch folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place, enc = TaskContext.get().partitionId(), 0, encoder(path_of(tokenizer))
        wide = "<u2" if enc.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        end = np.array([end_id], wide).tobytes()
        for b in batches:
            for a in range(0, b.num_rows, 500):
                some = b.slice(a, 500)
                ids = [np.frombuffer(x, "<u4").astype(wide).tobytes() + end for x in enc.many(some.column("text").to_pylist())]
                counts = np.array([len(x) for x in ids], np.int64) // np.dtype(wide).itemsize
                places = place + np.cumsum(counts) - counts
                place += int(counts.sum())
                yield pa.record_batch([pa.array(np.full(len(ids), part, np.int64)), pa.array(places), some.column("doc_id"), pa.array(ids, pa.binary()), pa.array(counts)], ["part", "place", "doc_id", "ids", "n"])

    return written(texts(docs).mapInArrow(run, "part long, place long, doc_id long, ids binary, n long"), scratch(docs.sparkSession, "packing"))


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 1, size: int = 2048, digest: bool = False) -> DataFrame:
    """Pieces of all documents: columns PIECES, or DIGESTS where only the ids' checksum is wanted."""
    rows = tokenized(docs, tokenizer, end_id)
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    # One row for each partition of the input, whatever its size.
    base = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))
    placed = rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("place")).alias("at"), "n", "ids")
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()) if digest else ("ids", pa.binary()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pieces() -> Iterator[tuple]:
            for b in batches:
                for doc, at, n, raw in zip(*(b.column(c).to_pylist() for c in ("doc_id", "at", "n", "ids")), strict=True):
                    ids = np.frombuffer(raw, f"<u{len(raw) // n}").astype("<u4")
                    start = 0
                    while start < n:
                        length = min(size - (at + start) % size, n - start)
                        own = ids[start : start + length].tobytes()
                        yield doc, start, length, zlib.crc32(own) if digest else own, n, (at + start) // size, (at + start) % size
                        start += length

        return record_batches(pieces(), schema)

    return placed.mapInArrow(cut, DIGESTS if digest else PIECES)
