"""Near-duplicate embeddings by NN-descent.

Equal vectors of a label are one class, and of a class one vector goes on. Neighbour lists start from random-hyperplane
tables, as many as a pair at the threshold needs to meet in one of them with probability 1 - MISS. All vectors of a key are
compared with each other, over all executors in pairs of blocks if they are many; a label for which that would be no fewer
pairs than there are at all is compared whole, once, which is exact. Then each round joins
neighbours of neighbours: every vector gathers the vectors of its list, compares them with each other, and the lists keep
the best, until few entries change. The lists only steer the search: a pair at the threshold that any comparison meets joins
its vectors, whether or not it fits into their lists; where a vector has more such pairs in a block than a list holds, stars of
the block's threshold graph stand for all of them. Components of these are compared in blocks, so that links are counted in
full. The recall of links is audited on all ids divisible by ASKED against all vectors; below AUDIT the search is repeated
with more tables, and after TRIES of them every label is compared whole.

Only vectors with equal, non-null labels (and equal lengths) are compared, by cosine in double precision; a cosine that equals the
threshold is a link. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and neither do rows
without id. Vectors travel in the precision that the table has. Repeated ids are rows of their own; of equal vectors one goes on, with
their number. An empty table gives no rows, and columns other than vec_id, label and embedding are never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .graph import components
from .shared import FLUSH, PACKED, PACKED_SQL, bucket_of, buckets, by_bucket, dealt, dropped, joined, packed_rows, record_batches, scratch, written
from .words import mix

THRESHOLD, LIST, FLOOR, MISS, BLOCK = 0.93, 12, 0.6, 0.003, 400
#: Vectors of a table key that are compared at once; of more, all pairs of blocks are compared by all executors.
SQUARE = 1000
#: The audit asks ids divisible by ASKED; the recall it asks for, tries, rounds of each, and the share of changed entries that ends them.
ASKED, AUDIT, TRIES, ROUNDS, CHANGED = 50, 0.98, 3, 4, 0.01
EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("s", pa.float64())])
#: Kinds of packed rows: entries of a key, or of a label that is compared whole; and those of either with components of four bytes.
ENTRY, WHOLE, SINGLE = 1, 2, 4


def packed_vector(v: np.ndarray) -> bytes:
    """A vector as bytes: one that tells the bytes of a component, then the components."""
    return bytes([v.itemsize]) + v.tobytes()


def matrix(raw: list[bytes]) -> np.ndarray:
    """Packed vectors of one length and precision."""
    return np.frombuffer(b"".join([r[1:] for r in raw]), f"f{raw[0][0]}").reshape(len(raw), -1)


def normal(v: np.ndarray) -> np.ndarray:
    """Vectors of any precision as unit vectors in double precision."""
    v = v.astype(np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def unit(raw: list[bytes]) -> np.ndarray:
    return normal(matrix(raw))


def valid_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, label and raw (packed; null if the vector can't link) of every row."""
    column = vectors.schema["embedding"].dataType.elementType
    kind = np.dtype("f4") if isinstance(column, T.FloatType) else np.dtype("f8")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw = []
            for e, label in zip(b.column("embedding").to_pylist(), b.column("label").to_pylist(), strict=True):
                v = np.array(e, np.float64) if e and label is not None and None not in e else np.zeros(0)
                norm = np.linalg.norm(v) if len(v) else 0.0
                raw.append(packed_vector((v + 0.0).astype(kind)) if np.isfinite(norm) and norm > 0 else None)
            yield pa.record_batch([b.column("vec_id"), b.column("label"), pa.array(raw, pa.binary())], ["vec_id", "label", "raw"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.when(F.col("vec_id").isNotNull(), F.col("embedding").cast("array<double>")).alias("embedding")).mapInArrow(run, "vec_id long, label string, raw binary")


def stars(left: np.ndarray, right: np.ndarray, hit: np.ndarray) -> np.ndarray:
    """Rows (u, v, inf) that join the ids of left and right just as all pairs of hit do: fewer than there are ids."""
    across = np.ascontiguousarray(hit.T)
    rows, columns, parts = hit.any(1), np.ones(len(right), bool), []
    while rows.any():
        first = int(rows.argmax())
        front, rows[first] = np.array([first]), False
        while len(front):
            c = np.flatnonzero(hit[front].any(0) & columns)
            columns[c] = False
            front = np.flatnonzero(across[c].any(0) & rows)
            rows[front] = False
            for ids in (right[c], left[front]):
                parts.append(np.stack([ids.view(np.float64), np.full(len(ids), left[first]).view(np.float64), np.full(len(ids), np.inf)], 1))
    return np.concatenate(parts) if parts else np.zeros((0, 3))


def best_in(ids: np.ndarray, v: np.ndarray, others: np.ndarray | None = None, w: np.ndarray | None = None, lists: bool = True) -> np.ndarray:
    """Rows (u, v, s): of each vector the LIST most similar others, at FLOOR or above; if one has more links, stars of all.

    Others are those of the block, or of a second one; without lists there are stars alone.
    """
    one = others is None
    others, w = (ids, v) if one else (others, w)
    s = v @ w.T
    if one:
        np.fill_diagonal(s, -2)
    k = min(LIST, len(others) - one)
    if k <= 0:
        return np.zeros((0, 3))
    hit = s >= THRESHOLD
    if not lists:
        return stars(ids, others, hit)
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    value = np.take_along_axis(s, top, 1)
    a, j = np.nonzero(value >= FLOOR)
    best = np.stack([ids[a].view(np.float64), others[top[a, j]].view(np.float64), value[a, j]], 1)
    return np.concatenate([best, stars(ids, others, hit)]) if (hit.sum(1) > k).any() else best


def same_size(b: pa.RecordBatch) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(bytes of a vector, whether whole, ids, vectors, groups, blocks) of a batch's vectors of one length that are compared alike."""
    raw, ids, group, blocks = b.column("raw").to_pylist(), b.column("id").to_numpy(), b.column("group").to_numpy(), b.column("blocks").to_numpy()
    kind = np.array([2 * len(r) for r in raw], np.int64) + (blocks > 0)
    for k in np.unique(kind):
        at = np.flatnonzero(kind == k)
        yield int(k) // 2, bool(k % 2), ids[at], matrix([raw[i] for i in at]), group[at].view(np.uint64), blocks[at]


def table_keys(v: np.ndarray, group: np.ndarray, size: int, t: int, bits: int, seed: int) -> np.ndarray:
    """Keys of table t: the sides of bits random hyperplanes; without bits, one key for each group."""
    key = mix(group + np.uint64(t * 1_000_003 + size))
    if bits:
        rng = np.random.default_rng([seed, t, 8 * size])
        key = mix(((v @ rng.standard_normal((v.shape[1], bits)) > 0).astype(np.uint64) << np.arange(bits, dtype=np.uint64)).sum(1) + key)
    return key


def key_counts(reps: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """group, key and n, the vectors of each key of all tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, _, _, v, group, _ in same_size(b):
                for t in range(tables):
                    key, first, n = np.unique(table_keys(normal(v), group, size, t, bits, seed), return_index=True, return_counts=True)
                    yield pa.record_batch([pa.array(group[first].view(np.int64)), pa.array(key.view(np.int64)), pa.array(n)], ["group", "key", "n"])

    return reps.mapInArrow(run, "group long, key long, n long").groupBy("group", "key").agg(F.sum("n").alias("n"))


def whole_groups(counts: DataFrame, tables: int) -> DataFrame:
    """group and blocks of the groups whose pairs are no more than those that the tables would compare: they are compared whole."""
    sums = counts.groupBy("group").agg((F.sum("n") / tables).alias("m"), F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    return sums.where("pairs >= m * m").select("group", F.ceil(F.col("m") / SQUARE).cast("long").alias("blocks"))


def hot_tables(planned: DataFrame, over: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """planned with hot: of each vector the tables, and the blocks there, in which its key is one of over (key, blocks).

    Spark joins keys by their size: over goes to all executors only if it is small. A vector has at most one entry for each table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for size, whole, own, v, group, _ in same_size(b):
                for t in range(0 if whole else tables):
                    key = table_keys(normal(v), group, size, t, bits, seed)
                    yield pa.record_batch([pa.array(own), pa.array(np.full(len(own), t)), pa.array(key.view(np.int64))], ["id", "t", "key"])

    keys = planned.mapInArrow(run, "id long, t long, key long")
    hot = keys.join(over, "key").groupBy("id").agg(F.collect_list(F.struct("t", "blocks")).alias("hot"))
    return planned.join(hot, "id", "left")


def table_rows(batches: Iterator[pa.RecordBatch], n: int, tables: int, bits: int, seed: int) -> Iterator[tuple]:
    """Vectors packed by table key, or by group where that is compared whole.

    A key of more than SQUARE vectors is cut into blocks, and each pair of them is a bucket of its own, so all pairs meet.
    """
    for b in batches:
        hot = {i: h for i, h in zip(b.column("id").to_pylist(), b.column("hot").to_pylist(), strict=True) if h}
        for size, whole, own, v, group, blocks in same_size(b):
            u = normal(v)
            if hot and not whole:
                cut = np.ones((len(own), tables), np.int64)
                for i, k in enumerate(own.tolist()):
                    for entry in hot.get(k, ()):
                        cut[i, entry["t"]] = entry["blocks"]
            for t in range(1 if whole else tables):
                key = table_keys(u, group, size, t, 0 if whole else bits, seed)
                if not whole:
                    blocks = cut[:, t] if hot else np.ones(len(key), np.int64)
                mine = (mix(own.view(np.uint64) + np.uint64(seed)) % blocks.astype(np.uint64)).astype(np.int64)
                kind = (WHOLE if whole else ENTRY) + (SINGLE if v.itemsize == 4 else 0)
                for j in range(int(blocks.max())):
                    at = np.flatnonzero(blocks > j)
                    x, y = np.minimum(mine[at], j), np.maximum(mine[at], j)
                    pair = np.where(blocks[at] > 1, mix(key[at] + mix((x << 32 | y).astype(np.uint64))), key[at])
                    bucket = bucket_of(pair, n) + np.where(blocks[at] > 1, n + (pair >> np.uint64(35)).astype(np.int64), 0)
                    order = np.lexsort((pair, bucket))
                    side = (2 * (x != y) + (mine[at] != x)).astype(np.int8)
                    for k, (p, i, w, z) in packed_rows(bucket[order], pair[order], own[at][order], v[at][order], side[order]):
                        yield k, kind, p, i, w, z


def lists_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges among the vectors of each table key, or of each pair of its blocks."""
    parts, size = [], 0
    for _, rows in by_bucket(batches):
        for kind in sorted({r[1] for r in rows}):
            own, lists = [r for r in rows if r[1] == kind], kind % SINGLE == ENTRY
            if own:
                key, ids, side = joined(own, 2, np.uint64), joined(own, 3, np.int64), joined(own, 5, np.int8)
                v = [x for r in own for x in np.frombuffer(r[4], np.float32 if kind >= SINGLE else np.float64).reshape(len(r[2]) // 8, -1)]
                order = np.lexsort((side, key))
                k = key[order]
                fresh = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                for i, j in zip(fresh, np.r_[fresh[1:], len(k)], strict=True):
                    if j - i > 1:
                        at = order[i:j]
                        if side[at[0]] < 2:
                            new = [best_in(ids[at], normal(np.array([v[x] for x in at])), lists=lists)]
                        else:
                            a, b = at[side[at] == 2], at[side[at] == 3]
                            p, q = (normal(np.array([v[x] for x in z])) if len(z) else None for z in (a, b))
                            new = [] if p is None or q is None else [best_in(ids[a], p, ids[b], q, lists)] + ([best_in(ids[b], q, ids[a], p)] if lists else [])
                        parts += new
                        size += sum(map(len, new))
                if size > FLUSH // 8:
                    yield _edges(parts)
                    parts, size = [], 0
    if size:
        yield _edges(parts)


def shortened(edges: DataFrame, size: int = LIST) -> DataFrame:
    """Of each vector the size best neighbours; entries of either direction count, stars don't."""
    edges = edges.where("s <= 2")
    both = edges.select("u", "v", "s").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "s")).groupBy("u", "v").agg(F.max("s").alias("s"))
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return both.withColumn("r", rank).where(F.col("r") <= size).drop("r")


def joined_neighbours(lists: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges found by comparing the neighbours of each vector with each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups() -> Iterator[tuple[list, list]]:
            now, ids, raw = None, [], []
            for b in batches:
                for u, v, r in zip(*(b.column(c).to_pylist() for c in ("u", "v", "raw")), strict=True):
                    if u != now:
                        if len(ids) > 1:
                            yield ids, raw
                        now, ids, raw = u, [], []
                    ids.append(v)
                    raw.append(r)
            if len(ids) > 1:
                yield ids, raw

        parts, size = [], 0
        for ids, raw in groups():
            parts.append(best_in(np.array(ids), unit(raw)))
            size += len(parts[-1])
            if size > FLUSH // 8:
                yield _edges(parts)
                parts, size = [], 0
        if parts:
            yield _edges(parts)

    n = max(32, int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = lists.join(reps.select(F.col("id").alias("v"), "raw"), "v").select("u", "v", "raw")
    return rows.repartition(n, "u").sortWithinPartitions("u").mapInArrow(run, "u long, v long, s double")


def _edges(parts: list[np.ndarray]) -> pa.RecordBatch:
    e = np.unique(np.concatenate(parts), axis=0)
    return pa.record_batch([pa.array(e[:, 0].copy().view(np.int64)), pa.array(e[:, 1].copy().view(np.int64)), pa.array(e[:, 2])], schema=EDGES)


def found_links(reps: DataFrame, tables: int, bits: int, seed: int) -> DataFrame:
    """u and v that join what is linked: every pair at the threshold that a comparison met is in them, or joined by stars."""
    spark = reps.sparkSession
    n = buckets(reps)

    def kept(found: DataFrame) -> tuple[DataFrame, str]:
        found = written(found, path := scratch(spark, "found"))
        links.append(written(found.where(F.col("s") >= THRESHOLD).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), scratch(spark, "links")))
        return found, path

    links: list[DataFrame] = []
    grouped = reps.select("id", "raw", F.xxhash64("label", F.length("raw")).alias("group"))
    if bits:
        counts = written(key_counts(grouped.withColumn("blocks", F.lit(0).cast("long")), tables, bits, seed), counts_path := scratch(spark, "keys"))
        whole = written(whole_groups(counts, tables), whole_path := scratch(spark, "keys"))
        over = counts.where(F.col("n") > SQUARE).join(whole, "group", "left_anti").select("key", F.ceil(F.col("n") / SQUARE).cast("long").alias("blocks"))
        over = written(over.groupBy("key").agg(F.max("blocks").alias("blocks")), over_path := scratch(spark, "keys"))
        dropped(spark, counts_path)
    else:
        whole, over, over_path = written(grouped.groupBy("group").agg(F.ceil(F.count("*") / SQUARE).cast("long").alias("blocks")), whole_path := scratch(spark, "keys")), None, None
    planned = grouped.join(whole, "group", "left").select("id", "raw", "group", F.coalesce("blocks", F.lit(0).cast("long")).alias("blocks"))
    if over is None or over.isEmpty():
        planned = planned.withColumn("hot", F.lit(None).cast("array<struct<t:bigint,blocks:bigint>>"))
    else:
        planned = hot_tables(planned, over, tables, bits, seed)
    packed = planned.mapInArrow(lambda it: record_batches(table_rows(it, n, tables, bits, seed), PACKED), PACKED_SQL)
    found, path = kept(dealt(packed, n).mapInArrow(lists_of, "u long, v long, s double"))
    lists = written(shortened(found), lists_path := scratch(spark, "neighbours"))
    dropped(spark, path, whole_path, *filter(None, [over_path]))
    for _ in range(ROUNDS):
        size = lists.count()
        if not size:
            break
        found, path = kept(joined_neighbours(lists, reps))
        fresh = written(shortened(lists.unionByName(found)), fresh_path := scratch(spark, "neighbours"))
        changed = fresh.join(lists, ["u", "v"], "left_anti").count()
        dropped(spark, path, lists_path)
        lists, lists_path = fresh, fresh_path
        if changed <= CHANGED * size:
            break
    dropped(spark, lists_path)
    return reduce(DataFrame.unionByName, links)


def by_pair(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, list[tuple]]]:
    """(component, x, y) of each pair of blocks and its rows."""
    now, rows = None, []
    for b in batches:
        for c, x, y, *row in zip(*(b.column(k).to_pylist() for k in ("component", "x", "y", *columns)), strict=True):
            if (c, x, y) != now:
                if rows:
                    yield now, rows
                now, rows = (c, x, y), []
            rows.append(tuple(row))
    if rows:
        yield now, rows


def in_pairs(pairs: DataFrame) -> DataFrame:
    n = max(32, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartition(n, "component", "x", "y").sortWithinPartitions("component", "x", "y")


def counted(reps: DataFrame, comp: DataFrame) -> DataFrame:
    """id and n, links with vectors of other classes, by comparing each component's vectors in blocks."""
    blocks = comp.groupBy("component").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    own = comp.join(blocks, "component").join(reps, "id").withColumn("i", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = own.withColumn("j", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("component", F.least("i", "j").alias("x"), F.greatest("i", "j").alias("y"), "i", "id", "copies", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(key: tuple, rows: list[tuple]) -> Iterator[tuple]:
            _, x, y = key
            left = [r for r in rows if r[0] == x]
            right = [r for r in rows if r[0] == y]
            a, b = unit([r[3] for r in left]) if left else None, unit([r[3] for r in right]) if right else None
            if a is None or b is None:
                return
            hit = a @ b.T >= THRESHOLD
            if x == y:
                np.fill_diagonal(hit, False)
            yield from zip([r[1] for r in left], (hit @ np.array([r[2] for r in right])).tolist(), strict=True)
            if x != y:
                yield from zip([r[1] for r in right], (hit.T @ np.array([r[2] for r in left])).tolist(), strict=True)

        counts = (row for key, rows in by_pair(batches, "i", "id", "copies", "raw") for row in count(key, rows))
        return record_batches(counts, pa.schema([("id", pa.int64()), ("n", pa.int64())]))

    return in_pairs(pairs).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def audit(reps: DataFrame, links: DataFrame) -> float:
    """Share of a vector's links, held against all others in blocks, that links (id, n) has: the mean over all asked vectors
    with links, or that with each group of linked vectors weighing about as much as any other, whichever is less."""
    own = reps.select(F.xxhash64("label", F.length("raw")).alias("component"), "id", "copies", "raw", "asked")
    sizes = own.groupBy("component").agg(F.ceil(F.count("*") / SQUARE).cast("int").alias("blocks"), F.ceil(F.sum(F.col("asked").cast("int")) / SQUARE).cast("int").alias("query_blocks")).where("query_blocks > 0")
    own = own.join(sizes, "component").withColumn("h", F.xxhash64("id"))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = own.withColumn("x", F.pmod("h", "blocks").cast("int")).withColumn("y", each("query_blocks")).withColumn("query", F.lit(False))
    queries = own.where("asked").withColumn("x", each("blocks")).withColumn("y", F.pmod("h", "query_blocks").cast("int")).withColumn("query", F.lit(True))
    columns = ["component", "x", "y", "query", "id", "copies", "raw"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def count(rows: list[tuple]) -> Iterator[tuple]:
            asked, others = ([r for r in rows if r[0] == k] for k in (True, False))
            if asked and others:
                hit = unit([r[3] for r in asked]) @ unit([r[3] for r in others]).T >= THRESHOLD
                hit &= np.array([r[1] for r in asked])[:, None] != np.array([r[1] for r in others])
                yield from zip([r[1] for r in asked], (hit @ np.array([r[2] for r in others])).tolist(), strict=True)

        counts = (row for _, rows in by_pair(batches, *columns[3:]) for row in count(rows))
        return record_batches(counts, pa.schema([("id", pa.int64()), ("n", pa.int64())]))

    true = in_pairs(held.select(columns).unionByName(queries.select(columns))).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("real")).where("real > 0")
    got = true.join(links, "id", "left").select((F.least(F.coalesce("n", F.lit(0)), F.col("real")) / F.col("real")).alias("recall"), (1 / (1 + F.col("real"))).alias("w"))
    mean, even = got.agg(F.avg("recall"), F.sum(F.col("recall") * F.col("w")) / F.sum("w")).first()
    return 1.0 if mean is None else min(mean, even)


def near_duplicates(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    spark = vectors.sparkSession
    own = written(valid_vectors(vectors), scratch(spark, "vectors"))
    some = own.where("raw is not null")
    classes = some.groupBy("label", "raw").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.bool_or(F.col("vec_id") % ASKED == 0).alias("asked"))
    # Numbers of classes, which hold once they are written: one id may be the least of several classes.
    classes = written(classes.withColumn("id", F.monotonically_increasing_id()), scratch(spark, "vectors"))
    most = classes.groupBy("label").count().agg(F.max("count")).first()[0] or 0
    bits = max(4, min(24, round(math.log2(max(1, most) / 8))))
    meet = 1 - math.acos(THRESHOLD) / math.pi
    tables = math.ceil(math.log(MISS) / math.log(1 - meet**bits))
    edges, comp, links = None, None, None
    for k in range(TRIES + 1):
        new = found_links(classes, tables, bits, k) if k < TRIES else found_links(classes, 1, 0, k)
        edges = new if edges is None else edges.unionByName(new)
        if edges.isEmpty():
            comp, links = None, spark.createDataFrame([], "id long, n long")
        else:
            comp = components(edges, "u", "v")
            links = written(counted(classes, comp), scratch(spark, "links"))
        if k == TRIES or audit(classes, links) >= AUDIT:
            break
    found = classes.select("label", "raw", "id", "least", "copies").join(links, "id", "left")
    if comp is not None:
        whole = comp.join(classes.select("id", "least"), "id").groupBy("component").agg(F.min("least").alias("first"))
        found = found.join(comp.join(whole, "component").select("id", "first"), "id", "left").withColumn("least", F.coalesce("first", "least"))
    joined_ = own.join(found, ["label", "raw"], "left")
    out = joined_.select("vec_id", F.when(F.col("id").isNull(), F.lit(0)).otherwise(F.coalesce("n", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


ORACLE_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.93),
t AS (SELECT vec_id AS x, vec_id AS y FROM embeddings UNION SELECT t.x, l.y FROM t JOIN l ON t.y = l.x),
m AS (SELECT x AS vec_id, min(y) AS component_id FROM t GROUP BY x),
n AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x)
SELECT m.vec_id, coalesce(n, 0)::BIGINT AS n_links, component_id, m.vec_id = component_id AS kept FROM m LEFT JOIN n USING (vec_id)
"""
