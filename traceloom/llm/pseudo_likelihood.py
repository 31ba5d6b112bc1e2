"""Masked pseudo-likelihood of documents.

A small network predicts each word from the words on both sides, SIDE on each: embeddings by place are summed, squashed and
mapped to a softmax over the vocabulary, which has the most frequent words of the whole corpus and hash classes for all
others. Word counts are summed over all documents and stay a distributed table: a word of a hash class has the probability of
its class, by the network, times its share of the class's occurrences, of which unknown words have a part. Training runs on every partition at once: each takes minibatch steps
from the common weights over its own documents (a round has one in ROUNDS places of every document as targets, so that after
all of them each place has been one), and the weights are averaged by the number of targets, in two levels, so the driver gets
a bounded number of them. A document's score is the sum of the conditional log-probabilities of all its words, and their mean.

The network depends on how documents are dealt over partitions and in which order these hold them: a document keeps its score on
the same files and settings, and on others it differs a little. Null, empty and blank texts score 0. Repeated rows and rows with
equal or null ids are scored each for itself; of words that occur equally often that with the lesser hash is the more frequent one.
A very long text is scored whole. An empty table gives no rows; columns other than doc_id and text are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import FLUSH, PACKED, PACKED_SQL, bucket_of, buckets, by_bucket, dealt, joined, packed_rows, record_batches, scratch, texts, written
from .words import Words, chunks, mix

FREQUENT, CLASSES, SIDE, WIDTH, ROUNDS, BATCH, RATE, GROUPS, SEED = 127, 128, 2, 12, 2, 2048, 0.15, 32, 5
PAD = FREQUENT + CLASSES
COUNT, WORD, PART, DOCUMENT = 1, 2, 3, 4
SIZE = PAD + 1


def count_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    held, size = [], 0

    def flush() -> Iterator[tuple]:
        value, count = np.unique(np.concatenate(held), return_counts=True)
        for k, (x, y) in packed_rows(bucket_of(value, n), value, count):
            yield k, 1, x, y, b"", b""

    for b in batches:
        for w in chunks(b, lower=True):
            held.append(w.hashes())
            size += len(held[-1])
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def word_counts(docs: DataFrame) -> DataFrame:
    """Packed rows of kind COUNT: hashes of all words, ascending, and how often they occur in all documents."""
    n = buckets(docs)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for bucket, own in by_bucket(batches):
                value, at = np.unique(joined(own, 2, np.uint64), return_inverse=True)
                count = np.bincount(at, joined(own, 3, np.int64)).astype(np.int64)
                yield bucket, COUNT, value.tobytes(), count.tobytes(), b"", b""

        return record_batches(rows(), PACKED)

    packed = texts(docs).mapInArrow(lambda it: record_batches(count_rows(it, n), PACKED), PACKED_SQL)
    return written(dealt(packed, n).mapInArrow(total, PACKED_SQL), scratch(docs.sparkSession, "words"))


def frequent_words(counts: DataFrame) -> np.ndarray:
    """Hashes of the FREQUENT most frequent words, ascending."""

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            value, count = joined(rows, 2, np.uint64), joined(rows, 3, np.int64)
            top = np.lexsort((value, -count))[:FREQUENT]
            yield pa.record_batch([pa.array(value[top].view(np.int64)), pa.array(count[top])], ["h", "n"])

    rows = counts.mapInArrow(most, "h long, n long").orderBy(F.desc("n"), "h").limit(FREQUENT).collect()
    return np.sort(np.array([r.h for r in rows], np.int64).view(np.uint64))


def class_of(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(40)) % np.uint64(CLASSES)).astype(np.int64)


def class_masses(counts: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each hash class, the occurrences of its words and the mass of unknown words: as many as occur once, 1 at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_bucket(batches):
            value, count = joined(rows, 2, np.uint64), joined(rows, 3, np.int64)
            rare = ~np.isin(value, vocabulary)
            c, n = class_of(value[rare]), count[rare]
            all_, once = (np.bincount(c, w, CLASSES).astype(np.int64) for w in (n, n == 1))
            yield pa.record_batch([pa.array(np.arange(CLASSES)), pa.array(all_), pa.array(once)], ["c", "n", "once"])

    total, unknown = np.zeros(CLASSES), np.ones(CLASSES)
    for r in counts.mapInArrow(run, "c long, n long, once long").groupBy("c").agg(F.sum("n").alias("n"), F.sum("once").alias("once")).collect():
        total[r.c], unknown[r.c] = r.n, max(1, r.once)
    return total, unknown


def ids_of(w: Words, vocabulary: np.ndarray) -> np.ndarray:
    h = w.hashes()
    out = (FREQUENT + class_of(h)).astype(np.int32)
    if len(vocabulary) and len(h):
        at = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
        known = vocabulary[at] == h
        out[known] = at[known]
    return out


def contexts(t: np.ndarray, first: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(2 * SIDE, places) ids around each place, PAD beyond the document's ends."""
    doc = np.searchsorted(first, at, "right") - 1
    low, high = first[doc], first[doc + 1]
    rows = []
    for o in [*range(-SIDE, 0), *range(1, SIDE + 1)]:
        p = at + o
        rows.append(np.where((p >= low) & (p < high), t[np.clip(p, 0, len(t) - 1)], PAD))
    return np.array(rows)


class Network:
    def __init__(self, raw: bytes | None = None):
        shapes = [(2 * SIDE, SIZE, WIDTH), (WIDTH, SIZE), (SIZE,)]
        if raw is None:
            rng = np.random.default_rng(SEED)
            self.parts = [(rng.standard_normal(s) * 0.1).astype(np.float32) for s in shapes]
        else:
            flat, self.parts = np.frombuffer(raw, np.float32).copy(), []
            for s in shapes:
                n = int(np.prod(s))
                self.parts.append(flat[:n].reshape(s))
                flat = flat[n:]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts])

    def hidden(self, context: np.ndarray) -> np.ndarray:
        e = self.parts[0]
        h = e[0][context[0]]
        for k in range(1, len(context)):
            h += e[k][context[k]]
        return np.tanh(h, out=h)

    def log_probability(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        _, w, bias = self.parts
        z = self.hidden(context) @ w
        z += bias
        own = z[np.arange(len(target)), target].astype(np.float64)
        np.exp(z, out=z)
        return own - np.log(z.sum(1, dtype=np.float64))

    def step(self, context: np.ndarray, target: np.ndarray, grad2: list[np.ndarray]) -> None:
        e, w, bias = self.parts
        h = self.hidden(context)
        z = h @ w + bias
        np.exp(z, out=z)
        z /= z.sum(1, keepdims=True)
        z[np.arange(len(target)), target] -= 1
        z /= len(target)
        gw, gb = h.T @ z, z.sum(0)
        gh = (z @ w.T) * (1 - h * h)
        ge = np.zeros_like(e)
        for k in range(len(context)):
            order = np.argsort(context[k], kind="stable")
            c = context[k][order]
            at = np.flatnonzero(np.r_[True, c[1:] != c[:-1]])
            ge[k][c[at]] = np.add.reduceat(gh[order], at, axis=0)
        for p, g, s in zip((e, w, bias), (ge, gw, gb), grad2, strict=True):
            s += g * g
            p -= np.float32(RATE) * g / np.sqrt(s)
        np.clip(w, -8, 8, out=w)
        np.clip(bias, -12, 12, out=bias)


def places(turn: int, n: int) -> np.ndarray:
    """Targets among n places in a round; the rounds share all places out."""
    return np.arange(turn, n, ROUNDS)


def train(docs: DataFrame, vocabulary: np.ndarray) -> bytes:
    own, weights = texts(docs), Network().flat().tobytes()
    for turn in range(ROUNDS):

        def local(batches: Iterator[pa.RecordBatch], weights=weights, turn=turn) -> Iterator[pa.RecordBatch]:
            def rows() -> Iterator[tuple]:
                net, n = Network(weights), 0
                grad2 = [np.full(p.shape, 1e-6, np.float32) for p in net.parts]
                for b in batches:
                    for w in chunks(b, lower=True):
                        t = ids_of(w, vocabulary)
                        at = places(turn, len(t))
                        at = np.random.default_rng([SEED, turn, len(t)]).permutation(at)
                        for i in range(0, len(at), BATCH):
                            some = at[i : i + BATCH]
                            net.step(contexts(t, w.first, some), t[some], grad2)
                        n += len(at)
                if n:
                    part = TaskContext.get().partitionId()
                    yield part % GROUPS, part, (net.flat().astype(np.float64) * n).tobytes(), np.int64(n).tobytes(), b"", b""

            return record_batches(rows(), PACKED)

        def mean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, rows in by_bucket(batches):
                total = np.zeros(len(rows[0][2]) // 8)
                for r in rows:
                    total += np.frombuffer(r[2], np.float64)
                yield pa.record_batch([pa.array([rows[0][0]], pa.int64()), pa.array([total.tobytes()], pa.binary()), pa.array([int(joined(rows, 3, np.int64).sum())], pa.int64())], ["g", "w", "n"])

        got = sorted(dealt(own.mapInArrow(local, PACKED_SQL)).mapInArrow(mean, "g long, w binary, n long").collect())
        if got:
            weights = (sum(np.frombuffer(r.w, np.float64) for r in got) / sum(r.n for r in got)).astype(np.float32).tobytes()
    return weights


def within_classes(batches: Iterator[pa.RecordBatch], n: int, total: np.ndarray, unknown: np.ndarray) -> Iterator[tuple]:
    """Log-probabilities of words within their hash classes, summed for each document; rows of documents pass through."""
    value, count, now, held, size = np.zeros(0, np.uint64), np.zeros(0, np.int64), None, [], 0

    def flush() -> Iterator[tuple]:
        key, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
        part = np.bincount(at, np.concatenate([p for _, p in held]))
        for k, (x, y) in packed_rows(bucket_of(key, n), key, part):
            yield k, PART, x, y, b"", b""

    for b in batches:
        for bucket, kind, x, y, z, w in zip(*(b.column(c).to_pylist() for c in PACKED.names), strict=True):
            if kind == DOCUMENT:
                yield bucket, kind, x, y, z, w
                continue
            if bucket != now:
                now, value, count = bucket, np.zeros(0, np.uint64), np.zeros(0, np.int64)
            h = np.frombuffer(x, np.uint64)
            if kind == COUNT:
                value, count = h, np.frombuffer(y, np.int64)
                continue
            c, mass = class_of(h), unknown[class_of(h)]
            if len(value):
                at = np.minimum(np.searchsorted(value, h), len(value) - 1)
                mass = np.where(value[at] == h, count[at], mass)
            doc, at = np.unique(np.frombuffer(y, np.int32), return_inverse=True)
            held.append((np.frombuffer(z, np.uint64)[doc], np.bincount(at, np.log(mass / (total + unknown)[c]))))
            size += len(doc)
            if size >= FLUSH:
                yield from flush()
                held, size = [], 0
    if size:
        yield from flush()


def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of documents with what lies within classes added; rows that share a key are equal and share the sum."""
    for _, rows in by_bucket(batches):
        parts, own = ([r for r in rows if r[1] == kind] for kind in (PART, DOCUMENT))
        if own:
            key, at, times = np.unique(joined(own, 2, np.uint64), return_inverse=True, return_counts=True)
            more, k = np.zeros(len(key)), joined(parts, 2, np.uint64)
            np.add.at(more, np.searchsorted(key, k), joined(parts, 3, np.float64))
            n, s = joined(own, 4, np.int64), joined(own, 5, np.float64) + (more / times)[at]
            words = n >> 1
            ids = pa.array(joined(own, 3, np.int64), pa.int64(), mask=n % 2 == 1)
            yield pa.record_batch([ids, pa.array(words), pa.array(s), pa.array(s / np.maximum(1, words))], ["doc_id", "n_words", "log_likelihood", "mean_log_probability"])


@dataclass
class Model:
    """What is learned from all documents: word counts (a table), frequent words, masses of hash classes, weights of the network."""

    counts: DataFrame
    vocabulary: np.ndarray
    total: np.ndarray
    unknown: np.ndarray
    weights: bytes


def fitted(docs: DataFrame) -> Model:
    counts = word_counts(docs)
    vocabulary = frequent_words(counts)
    return Model(counts, vocabulary, *class_masses(counts, vocabulary), train(docs, vocabulary))


def score(docs: DataFrame, model: Model | None = None, block: int = 16_384) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum) and mean_log_probability of every document, by a model trained on all of them."""
    n, model = buckets(docs), model or fitted(docs)
    counts, vocabulary, total, unknown, weights = model.counts, model.vocabulary, model.total, model.unknown, model.weights

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        net = Network(weights)
        for b in batches:
            null, done = b.column("doc_id").is_null().to_numpy(zero_copy_only=False).astype(np.int64), 0
            for w in chunks(b, lower=True):
                h, t, m = w.hashes(), ids_of(w, vocabulary), len(w.ids)
                parts = [net.log_probability(contexts(t, w.first, at := np.arange(i, min(len(t), i + block))), t[at]) for i in range(0, len(t), block)]
                sums = np.r_[0, np.cumsum(np.concatenate(parts))] if parts else np.zeros(1)
                doc = w.doc
                place = (np.arange(len(h)) - w.first[doc]).astype(np.uint64)
                content = np.r_[np.uint64(0), np.cumsum(mix(h + mix(place + np.uint64(1))))]
                key = mix(w.ids.astype(np.int64).view(np.uint64) + mix(content[w.first[1:]] - content[w.first[:-1]] + null[done : done + m].astype(np.uint64)))
                order = np.argsort(key, kind="stable")
                columns = key, w.ids.astype(np.int64), w.counts.astype(np.int64) << 1 | null[done : done + m], sums[w.first[1:]] - sums[w.first[:-1]]
                for k, (x, y, z, v) in packed_rows(bucket_of(key[order], n), *(c[order] for c in columns)):
                    yield k, DOCUMENT, x, y, z, v
                rare = np.flatnonzero(t >= FREQUENT)
                rare = rare[np.argsort(h[rare])]
                for k, (x, y) in packed_rows(bucket_of(h[rare], n), h[rare], doc[rare].astype(np.int32)):
                    used, at = np.unique(np.frombuffer(y, np.int32), return_inverse=True)
                    yield k, WORD, x, at.astype(np.int32).tobytes(), key[used].tobytes(), b""
                done += m

    packed = texts(docs).mapInArrow(lambda it: record_batches(rows(it), PACKED), PACKED_SQL)
    parts = dealt(counts.unionByName(packed), n).mapInArrow(lambda it: record_batches(within_classes(it, n, total, unknown), PACKED), PACKED_SQL)
    return dealt(parts, n).mapInArrow(summed, "doc_id long, n_words long, log_likelihood double, mean_log_probability double")
