"""Toxic spans by a linear-chain conditional random field over words.

Tokens are labelled from labelled documents: a word whose document frequency among toxic documents is far above that
among clean ones is a toxic token where it stands in a toxic document. The field (two tags, features of a word and its
neighbours, tag transitions) is fitted by gradient steps on windows of those tokens. Forward-backward marginals give each
token's probability; a document's score is a logistic function of their sum and maximum, fitted on the same documents,
and tokens at SPAN or above are offending spans with byte offsets. A word is known by a 64-bit hash; words that the windows
don't have weigh nothing.

Only the text counts: rows with equal or null ids, repeated rows and extra columns of any name are scored each for itself, and a
labelled id counts once, with one of its texts. Null and empty texts get the score of a text without toxic tokens. Very long texts
are scored whole. A score that equals CUT_SCORE is a toxic one. Without labels of both kinds every score is the mean label, or 0.
An empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import crc_of_id, dropped, scratch, texts, written
from .textstats import MARKS
from .words import Words, chunks

#: Labelled documents of each kind that the fit takes at most, and their words in all; windows of each document that the field is
#: fitted on, and their words; fit; thresholds.
MAX_LABELLED, MAX_WORDS, WINDOWS, WINDOW, STEPS, RIDGE, SPAN, FLOOR, CUT_SCORE = 3000, 4_000_000, 5, 16, 80, 1e-4, 0.5, 0.2, 0.3


def token_hashes(w: Words) -> np.ndarray:
    """A hash of each word: letters A-Z lower-cased, up to four ASCII marks at both ends dropped."""
    starts, ends, data = w.starts.copy(), w.ends.copy(), w.data
    for _ in range(4):
        ends -= (ends - starts > 1) & MARKS[data[ends - 1]]
        starts += (ends - starts > 1) & MARKS[data[starts]]
    low = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return w.hashes(low, starts, ends)


class Field:
    """Weights of the field for known words: word, word before, word after (for the toxic tag against the clean one); transitions.

    The last weight of each is that of unknown words, 0.
    """

    def __init__(self, words: np.ndarray | None = None) -> None:
        self.words = np.zeros(0, np.uint64) if words is None else words
        self.word, self.before, self.after = (np.zeros(len(self.words) + 1) for _ in range(3))
        self.bias, self.trans = 0.0, np.zeros((2, 2))

    def numbers(self, h: np.ndarray) -> np.ndarray:
        """The number of each word among the known ones; that of unknown words is how many there are."""
        if not len(self.words):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, len(self.words))

    def emissions(self, t: np.ndarray, first: np.ndarray) -> np.ndarray:
        e = self.word[t] + self.bias
        e[1:] += self.before[t[:-1]]
        e[:-1] += self.after[t[1:]]
        heads = first[:-1][np.diff(first) > 0]
        inner = heads[heads > 0]
        e[inner] -= self.before[t[inner - 1]]
        e[inner - 1] -= self.after[t[inner]]
        return np.clip(e, -25, 25)

    def probabilities(self, w: Words) -> np.ndarray:
        """The probability of the toxic tag for each word."""
        return marginals(self.emissions(self.numbers(token_hashes(w)), w.first), self.trans, w.first)


def chain(emit: np.ndarray, trans: np.ndarray, heads: np.ndarray, block: int = 256) -> np.ndarray:
    """Normalised forward messages (n, 2) of a two-tag chain; heads marks tokens that start a document.

    Messages pass through a token by a 2 x 2 matrix. Products of the matrices of each block are formed for all blocks at
    once, a short loop carries the message from block to block, and a second sweep fills the blocks in.
    """
    n = len(emit)
    cols = -(-n // block)
    e = np.ones(cols * block)
    e[:n] = np.exp(emit)
    start = np.zeros(cols * block, bool)
    start[:n] = heads
    e, start, t = e.reshape(cols, block).T, start.reshape(cols, block).T, np.exp(trans)
    m00, m01, m10, m11 = np.ones(cols), np.zeros(cols), np.zeros(cols), np.ones(cols)
    for i in range(block):
        s, f = start[i], e[i]
        a0, a1 = np.where(s, m00 + m01, m00 * t[0, 0] + m01 * t[1, 0]), np.where(s, m00 + m01, m00 * t[0, 1] + m01 * t[1, 1]) * f
        b0, b1 = np.where(s, m10 + m11, m10 * t[0, 0] + m11 * t[1, 0]), np.where(s, m10 + m11, m10 * t[0, 1] + m11 * t[1, 1]) * f
        z = a0 + a1 + b0 + b1
        m00, m01, m10, m11 = a0 / z, a1 / z, b0 / z, b1 / z
    x = np.empty((2, cols))
    p, q = 0.5, 0.5
    for c in range(cols):
        x[:, c] = p, q
        p, q = p * m00[c] + q * m10[c], p * m01[c] + q * m11[c]
        z = p + q
        p, q = p / z, q / z
    p, q = x
    out = np.empty((block, cols, 2))
    for i in range(block):
        s, f = start[i], e[i]
        a, b = np.where(s, 1.0, p * t[0, 0] + q * t[1, 0]), np.where(s, 1.0, p * t[0, 1] + q * t[1, 1]) * f
        z = a + b
        p, q = a / z, b / z
        out[i, :, 0], out[i, :, 1] = p, q
    return out.transpose(1, 0, 2).reshape(-1, 2)[:n]


def marginals(emit: np.ndarray, trans: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Probability of the toxic tag for each token of documents laid end to end."""
    n = len(emit)
    if not n:
        return np.zeros(0)
    heads = np.zeros(n, bool)
    heads[first[:-1][np.diff(first) > 0]] = True
    tails = np.zeros(n, bool)
    tails[first[1:][np.diff(first) > 0] - 1] = True
    ahead = chain(emit, trans, heads)
    back = chain(emit[::-1], trans.T, tails[::-1])[::-1]  # holds the token's own emission too
    clean, toxic = ahead[:, 0] * back[:, 0], ahead[:, 1] * back[:, 1] / np.exp(emit)
    return toxic / (clean + toxic)


def label_tokens(docs: list[np.ndarray], y: np.ndarray, n_words: int) -> np.ndarray:
    """Which words mark toxic documents: smoothed log-odds of document frequency over 2 with three toxic documents at least."""
    seen = np.zeros((2, n_words))
    for t, k in zip(docs, y, strict=True):
        seen[int(k), np.unique(t)] += 1
    n = np.bincount(y.astype(int), minlength=2)
    odds = np.log((seen[1] + 0.5) / (n[1] - seen[1] + 0.5)) - np.log((seen[0] + 0.5) / (n[0] - seen[0] + 0.5))
    spread = np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5))
    return (seen[1] >= 3) & (odds > 2) & (odds / spread > 2.5)


def fit_field(given: list[np.ndarray], y: np.ndarray, seed: int = 3) -> Field:
    """The field of documents given as word hashes."""
    words = np.unique(np.concatenate(given))
    docs = [np.searchsorted(words, t).astype(np.int32) for t in given]
    field, rng, pad = Field(words), np.random.default_rng(seed), len(words)
    toxic, rows, tags = label_tokens(docs, y, pad), [], []
    for t, k in zip(docs, y, strict=True):
        if not len(t):
            continue
        own = toxic[t] & bool(k)
        at = rng.permutation(np.flatnonzero(own))[:WINDOWS] if own.any() else rng.integers(0, len(t), WINDOWS)
        for c in np.unique(np.maximum(0, at - rng.integers(0, WINDOW, len(at)))):
            some = t[c : c + WINDOW]
            before, after = (t[c - 1] if c else pad), (t[c + WINDOW] if c + WINDOW < len(t) else pad)
            rows.append(np.r_[before, some, np.full(WINDOW - len(some), pad), after if len(some) == WINDOW else pad])
            tags.append(np.r_[own[c : c + WINDOW], np.zeros(WINDOW - len(some), bool)])
    if not rows:
        return Field()
    t, tag = np.array(rows), np.array(tags).astype(float)
    real = t[:, 1:-1] < pad
    w = [np.zeros(pad + 1) for _ in range(3)]
    g2 = [np.full(pad + 1, 1e-3) for _ in range(3)]
    g2b, g2t = 1e-3, np.full((2, 2), 1e-3)
    views = (t[:, 1:-1], t[:, :-2], t[:, 2:])
    n, last = real.sum(), np.maximum(real.sum(1) - 1, 0)
    for _ in range(STEPS):
        e = np.clip(sum(x[v] for x, v in zip(w, views, strict=True)) + field.bias, -25, 25) * real
        tr = np.exp(field.trans)
        f, b = np.empty((*e.shape, 2)), np.empty((*e.shape, 2))
        emit = np.stack([np.ones_like(e), np.exp(e)], -1)
        a = emit[:, 0] / emit[:, 0].sum(1, keepdims=True)
        f[:, 0] = a
        for i in range(1, WINDOW):
            a = a @ tr * emit[:, i]
            a /= a.sum(1, keepdims=True)
            f[:, i] = a
        a = np.full((len(e), 2), 0.5)
        for i in range(WINDOW - 1, -1, -1):
            stop = (i >= last)[:, None]
            a = np.where(stop, 0.5, a)
            b[:, i] = a
            a = (a * emit[:, i]) @ tr.T
            a /= a.sum(1, keepdims=True)
        p = f * b
        p = p[..., 1] / p.sum(-1)
        pair = f[:, :-1, :, None] * tr * (emit[:, 1:] * b[:, 1:])[:, :, None, :]
        pair /= pair.sum((-1, -2), keepdims=True)
        both = (real[:, 1:] & real[:, :-1])[..., None, None]
        truth = np.stack([1 - tag, tag], -1)
        gt = ((pair - truth[:, :-1, :, None] * truth[:, 1:, None, :]) * both).sum((0, 1)) / n + RIDGE * field.trans
        d = (p - tag) * real
        for x, v, s, hold in zip(w, views, g2, (1, 30, 30), strict=True):
            g = np.bincount(v.ravel(), d.ravel(), pad + 1) / len(e) + hold * RIDGE * x
            g[pad] = 0
            s += g * g
            x -= 0.5 * g / np.sqrt(s)
        gb = d.sum() / n
        g2b += gb * gb
        g2t += gt * gt
        field.bias -= 0.2 * gb / np.sqrt(g2b)
        field.trans -= 0.2 * gt / np.sqrt(g2t)
    used = np.unique(t[t < pad])
    field.words, (field.word, field.before, field.after) = words[used], (np.r_[x[used], 0.0] for x in w)
    return field


def summary(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document: the largest marginal, and the log of 1 + the sum of what marginals exceed FLOOR by."""
    total = np.r_[0, np.cumsum(np.maximum(p - FLOOR, 0))]
    counts = np.diff(first)
    top = np.zeros(len(counts))
    full = counts > 0
    if full.any():
        top[full] = np.maximum.reduceat(p, first[:-1][full])
    return np.stack([top, np.log1p(total[first[1:]] - total[first[:-1]])], 1)


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weights and bias by Newton steps with a small ridge; a feature whose weight would be negative is left out."""
    z = np.c_[x, np.ones(len(x))]
    w = np.zeros(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (weight * p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(len(w))
        w += np.linalg.solve(h, z.T @ (weight * (y - p)) - 1e-2 * w)
    if (w[:-1] < 0).any() and (w[:-1] > 0).any():
        kept = np.flatnonzero(w[:-1] > 0)
        some, w = fit_logistic(x[:, kept], y, weight), np.zeros(x.shape[1] + 1)
        w[kept], w[-1] = some[:-1], some[-1]
    return w


def fit(docs: DataFrame, known: DataFrame) -> tuple[Field, np.ndarray]:
    """Field and document weights from rows (doc_id, y) of known."""
    counts = {r.y: r["count"] for r in known.groupBy("y").count().collect()}
    some = [known.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_LABELLED) for k in (0, 1)]
    # At most 2 * MAX_LABELLED rows.
    chosen = docs.join(F.broadcast(some[0].unionByName(some[1])), "doc_id").select("doc_id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [token_hashes(w)[w.first[i] : w.first[i + 1]].tobytes() for w in chunks(b) for i in range(len(w.ids))]
            if parts:
                yield pa.record_batch([b.column("doc_id"), b.column("y").cast(pa.int32()), pa.array(parts, pa.binary())], ["doc_id", "y", "t"])

    once = chosen.mapInArrow(run, "doc_id long, y int, t binary").groupBy("doc_id", "y").agg(F.min("t").alias("t"))
    own = written(once, path := scratch(docs.sparkSession, "labelled"))
    taken, words = [], 0
    for r in own.select("doc_id", "y", (F.octet_length("t") / 8).cast("long").alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id", "y").collect():
        if words + r.n <= MAX_WORDS:
            taken.append((r.doc_id, r.y))
            words += r.n
    # At most MAX_WORDS words of at most 2 * MAX_LABELLED documents.
    rows = sorted(own.join(F.broadcast(docs.sparkSession.createDataFrame(taken, "doc_id long, y int")), ["doc_id", "y"]).collect()) if taken else []
    dropped(docs.sparkSession, path)
    y = np.array([r.y for r in rows], float)
    if not len(rows) or y.min() == y.max():
        mean = float(y.mean()) if len(rows) else 0.0
        return Field(), np.array([0.0, 0.0, np.log((mean + 1e-9) / (1 - mean + 1e-9))])
    tokens = [np.frombuffer(r.t, np.uint64) for r in rows]
    field = fit_field(tokens, y)
    x = np.concatenate([summarized(field, tokens[i : i + 200]) for i in range(0, len(tokens), 200)])
    n = np.bincount(y.astype(int), minlength=2)
    weight = np.where(y == 1, counts.get(1, 0) / n[1], counts.get(0, 0) / n[0])  # kinds as frequent as among all labels
    return field, fit_logistic(x, y, weight)


def summarized(field: Field, tokens: list[np.ndarray]) -> np.ndarray:
    """summary of some documents, given as word hashes."""
    first = np.r_[0, np.cumsum([len(t) for t in tokens])]
    return summary(marginals(field.emissions(field.numbers(np.concatenate(tokens)), first), field.trans, first), first)


def learned(docs: DataFrame, labels: DataFrame, held_out: Column, label: str) -> tuple[Field, np.ndarray]:
    """fit on the labels that aren't held out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).where(~held_out & F.col("y").isin(0, 1)).distinct()
    return fit(texts(docs), known)


def scorer(docs: DataFrame, labels: DataFrame, held_out: Column, label: str):
    """A function for executors: of the words of some documents their scores, and the probability of each word."""
    field, weights = learned(docs, labels, held_out, label)
    # The words of at most WINDOWS windows of at most 2 * MAX_LABELLED documents.
    shipped = docs.sparkSession.sparkContext.broadcast(pickle.dumps((field, weights)))

    def load():
        f, of = pickle.loads(shipped.value)

        def run(w: Words) -> tuple[np.ndarray, np.ndarray]:
            p = f.probabilities(w)
            return 1 / (1 + np.exp(-np.clip(np.c_[summary(p, w.first), np.ones(len(w.ids))] @ of, -30, 30))), p

        return run

    return load


def score(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic", spans: bool = True) -> DataFrame:
    """doc_id, held_out, score, n_toxic (tokens at SPAN or above) and, with spans, their byte offsets for every document."""
    load = scorer(docs, labels, held_out, label)
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = load()
        for b in batches:
            scores, n_toxic, found = [], [], []
            for w in chunks(b):
                own, p = judge(w)
                scores.append(own)
                hit = np.flatnonzero(p >= SPAN)
                bounds = np.searchsorted(hit, w.first)
                n_toxic.append(np.diff(bounds))
                if spans:
                    for i in range(len(w.ids)):
                        own_hits = hit[bounds[i] : bounds[i + 1]]
                        found.append([{"begin": int(w.starts[j] - w.offsets[i]), "end": int(w.ends[j] - w.offsets[i])} for j in own_hits])
            if scores:
                columns = [b.column("doc_id"), pa.array(np.concatenate(scores)), pa.array(np.concatenate(n_toxic).astype(np.int64))]
                yield pa.record_batch(columns + [pa.array(found, kind)] * spans, ["doc_id", "score", "n_toxic"] + ["spans"] * spans)

    out = texts(docs).mapInArrow(run, "doc_id long, score double, n_toxic long" + ", spans array<struct<begin:long,end:long>>" * spans)
    return out.withColumn("held_out", F.coalesce(held_out, F.lit(False)))


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, label: str = "toxic") -> DataFrame:
    """Rows of docs, unchanged, whose text scores below CUT_SCORE."""
    load = scorer(docs, labels, held_out, label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = load()
        for b in batches:
            own = pa.record_batch([pa.array(np.zeros(b.num_rows, np.int64)), b.column("text").cast(pa.string())], ["doc_id", "text"])
            parts = [judge(w)[0] for w in chunks(own)]
            if parts:
                yield b.filter(pa.array(np.concatenate(parts) < CUT_SCORE))

    return docs.mapInArrow(run, docs.schema)


def op2(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score(docs, labels, crc_of_id(F.col("doc_id")) % 4 == 2)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= CUT_SCORE).cast("int").alias("predicted"), "n_toxic", "spans")
