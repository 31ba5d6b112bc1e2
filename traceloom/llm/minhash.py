"""Near duplicates by min-max hashing.

A document's set holds the hashes of its distinct 5-word shingles, lower-cased in A-Z. Under each permutation (a
multiplication by a random odd number modulo 2**64) both the least and the largest value are kept: each agrees for two sets
with the probability of their similarity, so one multiplication serves two signature values. BANDS bands of ROWS values
find a pair at the threshold with probability 1 - (1 - 0.75**4)**40, all but 3e-7. Documents with equal sets are one class
first, and of a class only one row with the least id goes on.

A band alone also brings documents of similarity 0.3 or 0.4 together, and chains of those would make clusters of whole corpora.
So a sketch goes with each band entry, two bits of SKETCH signature values, and documents of a band key become candidates only
if MEET of them agree (of a pair at the threshold 104 on average with a deviation of 4.4, so all but 3e-7; at 0.4, one in fifty
does). Inside a key, documents that a chain of agreements joins are linked by a star. A key with more than LOCAL documents in one
task is linked by a star around the least, first inside each task, so no key has more than LOCAL entries of a task.

Candidate clusters are then resolved on full sets: breadth-first inside one task for those of bounded size; larger ones over all
executors, with a bounded number of documents at a time held against all of their cluster, until what is left apart has been held
against everything.

Null, empty and blank texts have empty sets, which link with nothing and stay. A row without id is in no component and is kept.
Rows with equal ids and different texts are documents of their own until links are found; component_id is then the least id that
links or equal ids reach. Repeated rows are copies. Ties are settled by the least id. A very long text is one set like any other.
An empty table gives no rows; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import FLUSH, PACKED, PACKED_SQL, bucket_of, buckets, by_bucket, dealt, dropped, free_names, joined, packed_rows, record_batches, scratch, texts, written
from .words import Words, chunks, grams, inside, mix

SHINGLE, SHARE, BANDS, ROWS, SEED = 5, 75, 40, 4, 11
#: Signature values in a sketch, and how many must agree; documents of a band key in one task up to which sketches are held together.
SKETCH, MEET, LOCAL = 128, 82, 64
#: Clusters up to this many documents and shingles are resolved in one task; leaders' shingles held against a cluster at once.
TASK_DOCS, TASK_SHINGLES, LEADERS, LEADER_SHINGLES = 1500, 2_000_000, 1000, 2_000_000
ENTRY, EDGE = 1, 2


def shingles(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes, ascending inside each document, and their borders by document."""
    h, n = w.hashes(), w.counts
    at = np.flatnonzero(inside(w.first, SHINGLE))
    value, doc = grams(h, SHINGLE)[at], np.searchsorted(w.first, at, "right") - 1
    few = np.flatnonzero((n > 0) & (n < SHINGLE))
    if len(few):
        one = [int(mix(np.array([sum(int(x) * pow(31, j + 1) for j, x in enumerate(h[w.first[i] : w.first[i + 1]])) % (1 << 64)], np.uint64))[0]) for i in few]
        value, doc = np.r_[value, np.array(one, np.uint64)], np.r_[doc, few]
    order = np.lexsort((value, doc))
    value, doc = value[order], doc[order]
    fresh = np.ones(len(value), bool)
    fresh[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    value, doc = value[fresh], doc[fresh]
    return value, np.searchsorted(doc, np.arange(len(n) + 1))


def signatures(value: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, BANDS) keys and (documents, SKETCH / 4) bytes; only for documents with shingles, whose borders first gives."""
    factors = np.random.default_rng(SEED).integers(1 << 62, 1 << 63, BANDS * ROWS // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    out, sketch = np.zeros((len(first) - 1, BANDS), np.uint64), np.zeros((len(first) - 1, SKETCH // 4), np.uint8)
    for i, f in enumerate(factors):
        y = value * f
        for j, x in enumerate((np.minimum.reduceat(y, first[:-1]), np.maximum.reduceat(y, first[:-1]))):
            at = 2 * i + j
            k = at // ROWS
            out[:, k] = mix(out[:, k] * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(k + 1))
            if at < SKETCH:
                sketch[:, at // 4] |= ((mix(x) & np.uint64(3)) << np.uint64(2 * (at % 4))).astype(np.uint8)
    return out, sketch


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many signature values of sketches (rows of 64-bit numbers) agree."""
    z = a ^ b
    return SKETCH - np.bitwise_count((z | z >> np.uint64(1)) & np.uint64(0x5555555555555555)).sum(-1, dtype=np.int64)


def signed(docs: DataFrame) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_a and set_b (a fingerprint of the set), bands and sketch of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, x, y, bands, sketches = [], [], [], [], []
            for w in chunks(b, lower=True):
                value, first = shingles(w)
                size = np.diff(first)
                full = np.flatnonzero(size)
                keys: list[bytes] = [b""] * len(size)
                own: list[bytes] = [b""] * len(size)
                a, c = np.zeros(len(size), np.uint64), np.zeros(len(size), np.uint64)
                if len(full):
                    starts = first[:-1][full]
                    a[full], c[full] = np.add.reduceat(mix(value), starts), np.add.reduceat(mix(value ^ np.uint64(0xA5A5A5A55A5A5A5A)), starts)
                    for i, row, sketch in zip(full, *signatures(value, np.r_[starts, len(value)]), strict=True):
                        keys[i], own[i] = row.tobytes(), sketch.tobytes()
                n.append(size)
                x.append(a)
                y.append(c)
                bands += keys
                sketches += own
            if n:
                numbers = [pa.array(np.concatenate(z).view(np.int64)) for z in (x, y)]
                yield pa.record_batch([b.column("doc_id"), b.column("text_hash"), pa.array(np.concatenate(n).astype(np.int64)), *numbers, pa.array(bands, pa.binary()), pa.array(sketches, pa.binary())], ["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands", "sketch"])

    own = texts(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    return own.mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands binary, sketch binary")


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and sizes of runs of equal values."""
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return at, np.diff(np.r_[at, len(key)])


def entries(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Packed entries (key, node, sketch); of a key with more than LOCAL nodes in this task one that is marked hot, and its star."""

    def flush(keys: list[np.ndarray], nodes: list[np.ndarray], sketches: list[bytes]) -> Iterator[tuple]:
        key, node = np.concatenate(keys).ravel(), np.repeat(np.concatenate(nodes), BANDS)
        sketch = np.frombuffer(b"".join(sketches), np.uint64).reshape(-1, SKETCH // 32)
        order = np.lexsort((node, key))
        key, node = key[order], node[order]
        at, size = runs(key)
        hot = size > LOCAL
        of = np.repeat(np.arange(len(at)), size)
        alone = np.r_[True, (key[1:] != key[:-1]) | (node[1:] != node[:-1])] if len(key) else np.zeros(0, bool)
        keep = np.where(hot[of], np.arange(len(key)) == at[of], alone)
        k, d, s, h = key[keep], node[keep], sketch[order[keep] // BANDS], hot[of][keep]
        for bucket, (a, b, c, e) in packed_rows(bucket_of(k, n), k, d, s, h):
            yield bucket, ENTRY, a, b, c, e
        least = node[at[of]]
        link = np.unique(np.stack([least, node], 1)[hot[of] & (least != node)], axis=0)
        if len(link):
            yield int(link[0, 0] % n), EDGE, link.tobytes(), b"", b"", b""

    keys, nodes, sketches, size = [], [], [], 0
    for b in batches:
        own = np.frombuffer(b"".join(b.column("bands").to_pylist()), np.uint64).reshape(-1, BANDS)
        for i in range(0, len(own), 5000):
            keys.append(own[i : i + 5000])
            nodes.append(b.column("node").to_numpy(zero_copy_only=False)[i : i + 5000])
            sketches += b.column("sketch").to_pylist()[i : i + 5000]
            size += keys[-1].size
            if size >= FLUSH // 4:
                yield from flush(keys, nodes, sketches)
                keys, nodes, sketches, size = [], [], [], 0
    if size:
        yield from flush(keys, nodes, sketches)


def met(key: np.ndarray, node: np.ndarray, sketch: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Distinct links (least, other) of nodes with equal keys: of hot keys all, of others those whose sketches a chain joins."""
    order = np.lexsort((node, key))
    key, node, sketch, hot = key[order], node[order], sketch[order], hot[order]
    at, size = runs(key)
    if not len(at):
        return np.zeros((0, 2), np.int64)
    warm = np.maximum.reduceat(hot, at)
    of = np.repeat(np.arange(len(at)), size)
    least = node[at[of]]
    links = [np.stack([least, node], 1)[warm[of]]]
    two = at[~warm & (size == 2)]
    two = two[agreement(sketch[two], sketch[two + 1]) >= MEET]
    links.append(np.stack([node[two], node[two + 1]], 1))
    for i, k in zip(at[~warm & (size > 2)].tolist(), size[~warm & (size > 2)].tolist(), strict=True):
        own, left = sketch[i : i + k], np.arange(k)
        while len(left) > 1:
            root, queue, left = left[0], [left[0]], left[1:]
            while queue and len(left):
                near = agreement(own[queue.pop()], own[left]) >= MEET
                if near.any():
                    queue += left[near].tolist()
                    links.append(np.stack([np.full(near.sum(), node[i + root]), node[i + left[near]]], 1))
                    left = left[~near]
    link = np.concatenate(links)
    return np.unique(link[link[:, 0] != link[:, 1]], axis=0)


def candidate_links(reps: DataFrame, n: int) -> DataFrame:
    """Distinct (a, b), a < b: stars that join nodes (rows node, bands, sketch) with a band in common and alike sketches."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            links = [joined([r for r in rows if r[1] == EDGE], 2, np.int64).reshape(-1, 2)]
            own = [r for r in rows if r[1] == ENTRY]
            if own:
                links.append(met(joined(own, 2, np.uint64), joined(own, 3, np.int64), joined(own, 4, np.uint64).reshape(-1, SKETCH // 32), joined(own, 5, bool)))
            link = np.unique(np.concatenate(links), axis=0)
            if len(link):
                yield pa.record_batch([pa.array(link[:, 0].copy()), pa.array(link[:, 1].copy())], ["a", "b"])

    packed = reps.select("node", "bands", "sketch").mapInArrow(lambda it: record_batches(entries(it, n), PACKED), PACKED_SQL)
    return dealt(packed, n).mapInArrow(meet, "a long, b long").distinct()


class Sets:
    """Full shingle sets of some documents, with the similarity of one of them to others."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets])
        values, self.code = np.unique(np.concatenate(sets), return_inverse=True)
        self.first = np.r_[0, np.cumsum(self.size)]
        self.mark = np.zeros(len(values), bool)

    def linked(self, i: int, others: np.ndarray) -> np.ndarray:
        """Which of others are linked with document i."""
        own = self.code[self.first[i] : self.first[i + 1]]
        self.mark[own] = True
        size = self.size[others]
        starts = np.r_[0, np.cumsum(size)[:-1]]
        at = np.repeat(self.first[others] - starts, size) + np.arange(size.sum())
        common = np.add.reduceat(self.mark[self.code[at]].astype(np.int64), starts)
        self.mark[own] = False
        return others[100 * common >= SHARE * (size + len(own) - common)]


def resolve(docs: list[int], sets: list[np.ndarray]) -> list[int]:
    """The least linked document of each, by breadth-first search: every document found is held against all not found yet."""
    held, left = Sets(sets), np.arange(len(docs))
    out = [0] * len(docs)
    while len(left):
        queue, found, left = [left[0]], [left[0]], left[1:]
        while queue and len(left):
            near = held.linked(queue.pop(), left)
            queue += near.tolist()
            found += near.tolist()
            left = np.setdiff1d(left, near, assume_unique=True)
        least = min(docs[i] for i in found)
        for i in found:
            out[i] = least
    return out


def set_of(text: str) -> np.ndarray:
    b = pa.record_batch([pa.array([0], pa.int64()), pa.array([text], pa.string())], ["doc_id", "text"])
    return next(shingles(w)[0] for w in chunks(b, lower=True))


def small_clusters(members: DataFrame) -> DataFrame:
    """doc_id and component of clusters of bounded size, from rows (cluster, doc_id, text)."""
    schema = pa.schema([("doc_id", pa.int64()), ("component", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            now, docs, sets = None, [], []
            for b in batches:
                for cluster, doc, text in zip(*(b.column(c).to_pylist() for c in ("cluster", "doc_id", "text")), strict=True):
                    if cluster != now:
                        if docs:
                            yield from zip(docs, resolve(docs, sets), strict=True)
                        now, docs, sets = cluster, [], []
                    docs.append(doc)
                    sets.append(set_of(text))
            if docs:
                yield from zip(docs, resolve(docs, sets), strict=True)

        return record_batches(rows(), schema)

    n = max(32, int(members.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return members.repartition(n, "cluster").sortWithinPartitions("cluster").mapInArrow(run, "doc_id long, component long")


def leader_links(lead: list[tuple[int, np.ndarray]], docs: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Links (a, b) that connect what leaders connect: of each document the one to its first leader, and of leaders that
    share a document one between them, by which all their links are connected too."""
    held = Sets([s for _, s in lead] + sets)
    first, pairs, k = np.full(len(docs), -1), set(), len(lead)
    for i in range(k):
        near = held.linked(i, np.arange(k, k + len(docs))) - k
        before = first[near]
        pairs.update((int(x), i) for x in np.unique(before[before >= 0]))
        first[near[before < 0]] = i
    ids = np.array([d for d, _ in lead])
    own = np.flatnonzero(first >= 0)
    links = [np.stack([ids[first[own]], docs[own]], 1)]
    if pairs:
        p = np.array(sorted(pairs))
        links.append(np.stack([ids[p[:, 0]], ids[p[:, 1]]], 1))
    links = np.concatenate(links)
    return links[links[:, 0] != links[:, 1]]


def large_clusters(members: DataFrame) -> DataFrame:
    """doc_id and component of clusters of any size, from rows (cluster, doc_id, text).

    Rounds: some documents of each cluster, bounded in all, lead: they are held against every document of their cluster.
    First those that no leader is linked with, until every document has led or has a leader; then, while a cluster has more
    than one component, the documents outside its largest, until each of them has led. Then no link can be missing.
    """
    spark = members.sparkSession

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [set_of(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("cluster"), b.column("doc_id"), pa.array([len(s) for s in own], pa.int64()), pa.array([s.tobytes() for s in own], pa.binary())], ["cluster", "doc_id", "n", "shingles"])

    n = max(32, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = written(members.repartition(n).mapInArrow(to_sets, "cluster long, doc_id long, n long, shingles binary"), scratch(spark, "large"))
    state = rows.select("cluster", "doc_id", "n", F.lit(False).alias("led"), F.lit(False).alias("linked"))
    links: DataFrame | None = None
    comp: DataFrame | None = None
    while True:
        waiting, apart = state.where("not led and not linked"), False
        chosen = _some(waiting)
        if not chosen:
            apart = True
            comp = components(links) if links is not None and not links.isEmpty() else spark.createDataFrame([], "id long, component long")
            placed = state.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
            most = placed.groupBy("cluster", "component").count().groupBy("cluster").agg(F.max_by("component", F.struct("count", "component")).alias("main"))
            chosen = _some(placed.where("not led").join(most, "cluster").where("component <> main"))
        if not chosen:
            break
        leaders: dict[int, list[tuple[int, np.ndarray]]] = {}
        own = F.broadcast(spark.createDataFrame([(i,) for i in chosen], "doc_id long").withColumn("chosen", F.lit(True)))
        for r in rows.join(own, "doc_id", "left_semi").select("cluster", "doc_id", "shingles").collect():
            leaders.setdefault(r.cluster, []).append((r.doc_id, np.frombuffer(r.shingles, np.uint64)))
        # At most LEADERS documents and LEADER_SHINGLES shingles, or one document.
        shipped = spark.sparkContext.broadcast(leaders)

        def against(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            for b in batches:
                cluster, doc = (b.column(c).to_numpy(zero_copy_only=False) for c in ("cluster", "doc_id"))
                sets = [np.frombuffer(s, np.uint64) for s in b.column("shingles").to_pylist()]
                parts = [np.zeros((0, 2), np.int64)]
                for c in np.unique(cluster):
                    own, lead = np.flatnonzero(cluster == c), shipped.value.get(int(c), [])
                    for i in range(0, len(own) if lead else 0, 1000):
                        some = own[i : i + 1000]
                        parts.append(leader_links(lead, doc[some], [sets[j] for j in some]))
                link = np.unique(np.concatenate(parts), axis=0)
                if len(link):
                    yield pa.record_batch([pa.array(link[:, 0].copy()), pa.array(link[:, 1].copy())], ["a", "b"])

        new = written(rows.mapInArrow(against, "a long, b long"), scratch(spark, "large"))
        links = new if links is None else links.unionByName(new)
        led = F.col("led") | F.coalesce("chosen", F.lit(False))
        state = state.join(own, "doc_id", "left")
        if apart:
            state = state.select("cluster", "doc_id", "n", led.alias("led"), "linked")
        else:
            hit = new.select(F.col("b").alias("doc_id")).distinct().withColumn("hit", F.lit(True))
            state = state.join(hit, "doc_id", "left").select("cluster", "doc_id", "n", led.alias("led"), (F.col("linked") | F.coalesce("hit", F.lit(False))).alias("linked"))
        state = written(state, scratch(spark, "large"))
        shipped.unpersist()
    return state.join(comp.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("doc_id", F.coalesce("component", "doc_id").alias("component"))


def _some(waiting: DataFrame) -> list[int]:
    """Ids of a bounded number of documents, with a bounded number of shingles unless one alone has more."""
    out, held = [], 0
    for r in waiting.orderBy(F.xxhash64("doc_id")).limit(LEADERS).select("doc_id", "n").collect():
        if out and held + r.n > LEADER_SHINGLES:
            break
        out.append(r.doc_id)
        held += r.n
    return out


KEY = ["n_shingles", "set_a", "set_b"]
#: A class of equal sets with one in HOT_SHARE of all rows or more is hot: there are at most as many of them.
HOT_SHARE = 10_000


def of_classes(own: DataFrame) -> DataFrame:
    """doc_id, text_hash and KEY of every row, with rep and rep_hash: the least (doc_id, text_hash) of the rows with its set.

    Empty sets and rows without id stand for themselves. Hot classes are joined as a small table, so no task gets all copies of one.
    """
    full = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
    first = F.min(F.struct("doc_id", "text_hash")).alias("first")
    several = written(own.where(full).groupBy(*KEY).agg(first, F.count("*").alias("copies")).where("copies > 1"), scratch(own.sparkSession, "classes"))
    hot = F.col("copies") * HOT_SHARE >= own.count()
    # At most HOT_SHARE rows.
    marked = own.where(full).join(F.broadcast(several.where(hot).drop("copies")), KEY, "left")
    rest = marked.where("first is null").drop("first").join(several.where(~hot).drop("copies"), KEY, "left")
    rows = marked.where("first is not null").unionByName(rest).unionByName(own.where(~full).withColumn("first", F.lit(None)))
    return rows.select("doc_id", "text_hash", *KEY, F.coalesce("first.doc_id", "doc_id").alias("rep"), F.coalesce("first.text_hash", "text_hash").alias("rep_hash"))


def linked_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """doc_id, text_hash, n_shingles, least and least_hash of every row: the least (doc_id, text_hash) of the rows that links join
    with it; and the ids that several rows with words have: doc_id, and differ if their sets do."""
    spark, n = docs.sparkSession, buckets(docs)
    own = written(signed(docs), own_path := scratch(spark, "minhash"))
    of = written(of_classes(own.drop("bands", "sketch")), scratch(spark, "minhash"))
    full = "doc_id is not null and n_shingles > 0"
    again = of.where(full).groupBy("doc_id").agg(F.count("*").alias("n"), (F.min(F.struct(*KEY)) != F.max(F.struct(*KEY))).alias("differ"))
    again = written(again.where("n > 1").drop("n"), scratch(spark, "minhash"))
    differ = again.where("differ").select(F.col("doc_id").alias("of_id"), "differ")
    unique = differ.isEmpty()

    def with_node(df: DataFrame, rep: str) -> DataFrame:
        """A class is known by its least id; if an id may be that of several classes, by a hash of it and the set."""
        if unique:
            return df.withColumn("node", F.col(rep))
        return df.join(differ, F.col(rep) == F.col("of_id"), "left").withColumn("node", F.when(F.col("differ"), F.xxhash64(rep, *KEY)).otherwise(F.col(rep))).drop("of_id", "differ")

    others = of.where(full).where("doc_id <> rep or text_hash <> rep_hash").select("doc_id", "text_hash").distinct()
    heads = with_node(own.where(full).join(others, ["doc_id", "text_hash"], "left_anti"), "doc_id")
    links = written(candidate_links(heads, n), links_path := scratch(spark, "minhash"))
    rows = with_node(of, "rep")
    if links.isEmpty():
        rows = rows.withColumn("first", F.lit(None).cast("struct<doc_id:bigint,text_hash:bigint>"))
    else:
        named = heads.select("node", "doc_id", "text_hash", "n_shingles").dropDuplicates(["node"])
        found = written(resolved(docs, links, named).join(named, "node"), scratch(spark, "minhash"))
        first = found.groupBy("component").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"))
        rows = rows.join(found.select("node", "component").join(first, "component").select("node", "first"), "node", "left")
    dropped(spark, links_path)
    return rows.select("doc_id", "text_hash", "n_shingles", F.coalesce("first.doc_id", "rep").alias("least"), F.coalesce("first.text_hash", "rep_hash").alias("least_hash")), again


def resolved(docs: DataFrame, links: DataFrame, named: DataFrame) -> DataFrame:
    """node and component (its least node) of all nodes with links, by their full sets."""
    spark = docs.sparkSession
    cand = components(links).join(named.withColumnRenamed("node", "id"), "id")
    size = cand.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n_shingles").alias("total"))
    large = size.where((F.col("docs") > TASK_DOCS) | (F.col("total") > TASK_SHINGLES)).select("component", F.lit(True).alias("large"))
    members = cand.join(large, "component", "left").select(F.col("component").alias("cluster"), F.col("id").alias("node"), "doc_id", "text_hash", F.coalesce("large", F.lit(False)).alias("large"))
    given = texts(docs, F.xxhash64(F.col("text").cast("string")).alias("text_hash"))
    whole = given.join(members, ["doc_id", "text_hash"]).select("cluster", F.col("node").alias("doc_id"), "text", "large").dropDuplicates(["doc_id"])
    whole = written(whole, whole_path := scratch(spark, "minhash"))
    found = small_clusters(whole.where("not large"))
    if not whole.where("large").isEmpty():
        found = found.unionByName(large_clusters(whole.where("large").drop("large")))
    found = written(found.select(F.col("doc_id").alias("node"), "component"), scratch(spark, "minhash"))
    dropped(spark, whole_path)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    rows, again = linked_rows(docs)
    out = rows.withColumnRenamed("least", "component_id")
    if not again.where("differ").isEmpty():
        # Rows of one id join what links with any of them.
        whole = components(rows.where("doc_id <> least").select("doc_id", "least"), "doc_id", "least")
        out = out.join(whole, F.col("component_id") == F.col("id"), "left").withColumn("component_id", F.coalesce("component", "component_id"))
    return out.select("doc_id", "n_shingles", "component_id").withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def without_duplicates(docs: DataFrame) -> DataFrame:
    """Rows of docs, unchanged, less those that are near another one that stays: of each group of linked rows that with the least id
    stays, and of several with that id the one whose text has the least hash. Rows are judged one by one, whatever others have
    their id."""
    rows, again = linked_rows(docs)
    rows = rows.where("doc_id is not null and n_shingles > 0")
    key, lost_id, lost_hash = free_names(docs.columns, "text_hash_", "lost_id_", "lost_hash_")
    gone = rows.where("doc_id <> least or text_hash <> least_hash").select(F.col("doc_id").alias(lost_id), F.col("text_hash").alias(lost_hash)).distinct()
    keyed = docs.withColumn(key, F.xxhash64(F.col("text").cast("string")))
    same = lambda other: (F.col("doc_id").cast("long") == other[lost_id]) & (F.col(key) == other[lost_hash])
    out = keyed.join(gone, same(gone), "left_anti")
    if not again.isEmpty():
        # Rows that are equal in id and text: one of them.
        twice = rows.join(again, "doc_id", "left_semi").groupBy(F.col("doc_id").alias(lost_id), F.col("text_hash").alias(lost_hash)).count().where("count > 1").drop("count")
        out = out.join(twice, same(twice), "left_anti").unionByName(out.join(twice, same(twice), "left_semi").dropDuplicates(["doc_id", key]))
    return out.select(docs.columns)


ORACLE_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, greatest(2, len(ws) - 3))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 75 * (a.n + b.n - c)),
t AS (SELECT doc_id AS x, doc_id AS y FROM w UNION SELECT t.x, l.y FROM t JOIN l ON t.y = l.x),
m AS (SELECT x AS doc_id, min(y) AS component_id FROM t GROUP BY x)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w LEFT JOIN n USING (doc_id) JOIN m USING (doc_id)
"""
