"""What the operators share: scratch folders on storage that every executor sees, and rows packed by bucket.

A packed row holds many entries of one bucket as numpy bytes. Shuffling packed rows moves the same entries as one
row each would, without the cost of a row for each, and a reducer handles a bucket with array operations.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import NULL_ID, mix

#: Entries that a task holds before it sends out what it has packed; bytes of whole rows; bytes of input that a bucket should have.
FLUSH, FLUSH_BYTES, BUCKET_BYTES = 2_000_000, 16_000_000, 32_000_000


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder below spark.checkpoint.dir; where that is unset (tests, one machine), below a temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = f"file://{tempfile.mkdtemp(prefix='traceloom-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/traceloom/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, path: str) -> DataFrame:
    """df as a written table: lineage ends there, so a lost executor costs no recomputation of what came before."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, *paths: str) -> None:
    """Removes scratch folders that no later step reads, through Spark's own file system."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)


def input_bytes(df: DataFrame) -> int:
    """Bytes of the tables that df reads, as far as Spark knows them."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return sum(x for x in sizes if x < 1 << 60)


def buckets(df: DataFrame) -> int:
    """Buckets that packed rows of df are dealt to: as many as there are shuffle partitions, or more if the input asks for more,
    so that no task's share grows with it."""
    return max(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-input_bytes(df) // BUCKET_BYTES))


def free_names(columns: list[str], *wanted: str) -> list[str]:
    """wanted, each with as many underscores behind it as it needs to be no other column's name."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        out.append(name)
        taken.add(name.lower())
    return out


#: What an Arrow batch between Spark and Python holds at most, in rows and bytes; Spark's own bounds ask for a GB where texts are long.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 8_000_000}


def bound_batches(spark: SparkSession) -> None:
    """Lowers the session's bounds on Arrow batches to BATCHES; lower ones of its own stay."""
    for key, most in BATCHES.items():
        given = spark.conf.get(key, None)
        if given is None or not given.isdigit() or not 0 < int(given) <= most:
            spark.conf.set(key, str(most))


def texts(docs: DataFrame, *more: str | Column) -> DataFrame:
    """doc_id and text alone; extra columns of the table, whatever their names, are never read."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), *more)


def bucket_of(h: np.ndarray, n: int) -> np.ndarray:
    """Bucket 0..n-1 of 64-bit hashes, increasing with the hash: what is sorted by hash is sorted by bucket."""
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def packed_rows(bucket: np.ndarray, *columns: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """One (bucket, bytes of each column) for each bucket; bucket is sorted."""
    if len(bucket):
        cuts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        for a, b in zip(cuts, np.r_[cuts[1:], len(bucket)], strict=True):
            yield int(bucket[a]), [c[a:b].tobytes() for c in columns]


def record_batches(rows: Iterable[tuple], schema: pa.Schema, most_bytes: int = 16_000_000) -> Iterator[pa.RecordBatch]:
    """Rows as Arrow batches of bounded size."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 64 + sum(len(x) for x in row if isinstance(x, bytes))
        if size >= most_bytes or len(held) >= 20_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


#: Packed rows of any operator: kind says what a to d hold.
PACKED = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary()), ("d", pa.binary())])
PACKED_SQL = "bucket int, kind int, a binary, b binary, c binary, d binary"
TEXTS = 9


def doc_buckets(ids: np.ndarray, n: int) -> np.ndarray:
    return bucket_of(mix(ids.astype(np.uint64) + np.uint64(1)), n)


def packed_documents(docs: DataFrame, n: int) -> DataFrame:
    """Whole rows of docs as compressed Arrow messages of kind TEXTS, packed by the bucket of their doc_id.

    Rows without id go to all buckets in turn. A task holds FLUSH_BYTES of rows, so that messages hold many rows however many
    buckets there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            held, size, turn = [], 0, TaskContext.get().partitionId()
            for b in batches:
                held.append(b)
                size += b.nbytes
                if size >= FLUSH_BYTES:
                    yield from messages(held, turn)
                    held, size = [], 0
            yield from messages(held, turn)

        def messages(held: list[pa.RecordBatch], turn: int) -> Iterator[tuple]:
            if not held:
                return
            b = pa.Table.from_batches(held).combine_chunks()
            ids = b.column("doc_id")
            bucket = doc_buckets(ids.fill_null(NULL_ID).to_numpy(), n)
            null = np.flatnonzero(ids.is_null().to_numpy())
            bucket[null] = (turn + np.arange(len(null))) % n
            order = np.argsort(bucket, kind="stable")
            cuts = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else []
            for i, j in zip(cuts, [*cuts[1:], len(order)], strict=True):
                sink, some = pa.BufferOutputStream(), order[i:j]
                with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(b.take(pa.array(some)))
                yield int(bucket[some[0]]), TEXTS, sink.getvalue().to_pybytes(), b"", b"", b""

        return record_batches(rows(), PACKED)

    return docs.mapInArrow(run, PACKED_SQL)


def unpacked(raw: bytes) -> pa.RecordBatch:
    with pa.ipc.open_stream(raw) as r:
        return r.read_all().combine_chunks().to_batches()[0]


def by_bucket(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """(bucket, its rows) of packed rows sorted by bucket; one bucket is held at a time."""
    now, held = None, []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in PACKED.names), strict=True):
            if row[0] != now:
                if held:
                    yield now, held
                now, held = row[0], []
            held.append(row)
    if held:
        yield now, held


def joined(rows: list[tuple], column: int, kind: type | str) -> np.ndarray:
    """One array of what the rows hold in a column."""
    return np.frombuffer(b"".join(r[column] for r in rows), kind)


def dealt(packed: DataFrame, n: int = 32) -> DataFrame:
    """Packed rows of n buckets with each bucket in a task of its own, sorted by kind."""
    n = max(32, int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions")), n)
    return packed.repartitionById(n, "bucket").sortWithinPartitions("bucket", "kind")


def crc_of_id(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary"))
