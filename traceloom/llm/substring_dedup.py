"""Repeated passages: words covered by a 13-word window that also starts in a document with a smaller id are removed.

1. Candidates. Of the six 8-word grams of every window the one with the least hash is its anchor, so equal windows have
   equal anchors, and a text has about two anchors for seven words. Anchors are packed by hash; those of two documents
   or more make their places candidates.
2. Confirmation. The windows of candidate anchors are packed by a 96-bit hash with the least document of each bucket of
   documents; a window is confirmed for a bucket if an earlier document has it. A window has one entry for each bucket at
   most, however many documents share it.
3. Automata. For each bucket of documents the confirmed passages are cut into windows that cover them, compiled into an
   Aho-Corasick automaton over words with the first owner as value, and all documents of the bucket stream through it;
   what it finds with an owner before the document is removed.

Windows are told apart by 96 bits all through: two different ones of the same bucket are taken for equal with a probability of
2**-96 for each pair of them; a phrase then matches by the hashes of its 13 words, 64 bits each.

Documents whose text is null, empty or shorter than a window lose nothing; rows with a null id own nothing and lose nothing, and
are spread over all buckets; of rows with equal ids none is before the other, and all lose alike what a smaller id has. Windows
are judged on the input, not on what is left. A very long text is one row of its bucket; a bucket's texts are kept compressed
and handled one message at a time. An empty table gives no rows. Columns other than doc_id and text pass through untouched,
whatever their names; counts are added only under names that the caller chooses.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import FLUSH, PACKED, PACKED_SQL, TEXTS, bucket_of, buckets, by_bucket, dealt, doc_buckets, dropped, joined, packed_documents, packed_rows, record_batches, scratch, texts, unpacked, written
from .words import NULL_ID, P3, Words, chunks, grams, inside, mix

WINDOW, GRAM = 13, 8
#: Letters that spell a word.
DIGITS = 3
ENTRY, FOUND = 1, 2
ANY = NULL_ID


def anchors(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Window starts, the place of each window's anchor, and all gram hashes."""
    g = grams(h, GRAM)
    s = np.flatnonzero(inside(first, WINDOW))
    if not len(s):
        return s, s, g
    least, place = g[s], np.zeros(len(s), np.int64)
    for j in range(1, WINDOW - GRAM + 1):
        other = g[s + j]
        less = other < least
        least = np.where(less, other, least)
        place[less] = j
    return s, s + place, g


def groups(key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of runs of equal keys in an order, and the run of each position."""
    k = key[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = k[1:] != k[:-1]
    return np.flatnonzero(fresh), np.cumsum(fresh) - 1


def candidate_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Packed anchors; of what recurs in this task itself the places go out as found, and one entry for the rest to meet."""

    def flush(h: np.ndarray, doc: np.ndarray) -> Iterator[tuple]:
        if not len(h):
            return
        order = np.lexsort((doc, h))
        at, run = groups(h, order)
        h, doc = h[order], doc[order]
        last = np.r_[at[1:], len(h)] - 1
        many = doc[at] != doc[last]
        for bucket, (a, b, c) in packed_rows(bucket_of(h[at], n), h[at], doc[at], many):
            yield bucket, ENTRY, a, b, c, b""
        yield from found(h[many[run]], doc[many[run]], n)

    held, size = [], 0
    for b in batches:
        for w in chunks(b):
            _, place, g = anchors(w.hashes(), w.first)
            place = place[np.r_[True, place[1:] != place[:-1]]] if len(place) else place
            doc = w.ids[np.searchsorted(w.first, place, "right") - 1]
            own = doc != NULL_ID
            held.append((g[place[own]], doc[own]))
            size += len(place)
            if size >= FLUSH:
                yield from flush(*map(np.concatenate, zip(*held, strict=True)))
                held, size = [], 0
    if size:
        yield from flush(*map(np.concatenate, zip(*held, strict=True)))


def found(h: np.ndarray, doc: np.ndarray, n: int) -> Iterator[tuple]:
    """Candidate anchors, packed by the bucket of their document."""
    bucket = doc_buckets(doc, n)
    order = np.argsort(bucket, kind="stable")
    for k, (a, b) in packed_rows(bucket[order], h[order], doc[order]):
        yield k, FOUND, a, b, b"", b""


def recurring(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Entries of anchors with two documents or more, turned to found ones; found ones pass."""
    for _, rows in by_bucket(batches):
        yield from (r for r in rows if r[1] == FOUND)
        rows = [r for r in rows if r[1] == ENTRY]
        if rows:
            h, doc, many = joined(rows, 2, np.uint64), joined(rows, 3, np.int64), joined(rows, 4, bool)
            order = np.lexsort((doc, h))
            at, run = groups(h, order)
            h, doc, many = h[order], doc[order], many[order]
            last = np.r_[at[1:], len(h)] - 1
            again = (doc[at] != doc[last]) | np.maximum.reduceat(many, at)
            own = again[run] & ~many
            yield from found(h[own], doc[own], n)


def pair_key(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return mix(h ^ mix(doc.astype(np.uint64)))


def window_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Distinct windows of each bucket's candidate anchors, with their least document there."""
    for bucket, rows in by_bucket(batches):
        cand = [r for r in rows if r[1] == FOUND]
        if not cand:
            continue
        known = np.unique(pair_key(joined(cand, 2, np.uint64), joined(cand, 3, np.int64)))
        parts = []
        for r in rows:
            if r[1] == TEXTS:
                for w in chunks(unpacked(r[2])):
                    h = w.hashes()
                    s, place, g = anchors(h, w.first)
                    doc = w.ids[np.searchsorted(w.first, s, "right") - 1]
                    key = pair_key(g[place], doc)
                    at = np.minimum(np.searchsorted(known, key), len(known) - 1)
                    hit = (known[at] == key) & (doc != NULL_ID)
                    s = s[hit]
                    parts.append((grams(h, WINDOW)[s], (grams(h, WINDOW, P3)[s] >> np.uint64(32)).astype(np.uint32), doc[hit]))
        a, b, doc = map(np.concatenate, zip(*parts, strict=True)) if parts else ([], [], [])
        if len(a):
            order = np.lexsort((doc, b, a))
            a, b, doc = a[order], b[order], doc[order]
            fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
            at = np.flatnonzero(fresh)
            many = doc[at] != doc[np.r_[at[1:], len(a)] - 1]
            for k, (x, y, z, m) in packed_rows(bucket_of(a[at], n), a[at], b[at], doc[at], many):
                yield k, bucket, x, y, z, m


def confirmed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """For each bucket of documents the windows that an earlier document has, elsewhere (owner ANY) or in the bucket itself."""
    for _, rows in by_bucket(batches):
        a, b, doc, many = joined(rows, 2, np.uint64), joined(rows, 3, np.uint32), joined(rows, 4, np.int64), joined(rows, 5, bool)
        source = np.repeat([r[1] for r in rows], [len(r[2]) // 8 for r in rows])
        order = np.lexsort((doc, b, a))
        a, b, doc, many, source = a[order], b[order], doc[order], many[order], source[order]
        fresh = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]
        least = doc[np.flatnonzero(fresh)][np.cumsum(fresh) - 1]
        owner = np.where(least < doc, ANY, doc)
        own = np.flatnonzero((least < doc) | many)
        own = own[np.argsort(source[own], kind="stable")]
        for k, (x, y, z) in packed_rows(source[own], a[own], owner[own], b[own]):
            yield k, FOUND, x, y, z, b""


def window_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key of both hashes of windows: equal keys have equal hashes but for a chance that both spread alike."""
    return mix(a + mix(b.astype(np.uint64) + np.uint64(1)))


class Phrases:
    """An automaton for phrases of WINDOW words, given as word hashes, with an owner each.

    A word is spelled with DIGITS letters, each place with letters of its own, so matches begin at words alone and no state
    of the automaton has more followers than the cube root of the number of words.
    """

    def __init__(self, phrases: np.ndarray, owners: np.ndarray):
        import ahocorasick

        self.words, codes = np.unique(phrases, return_inverse=True)
        self.base = math.ceil(len(self.words) ** (1 / DIGITS)) + 1
        self.auto = ahocorasick.Automaton()
        keys, n = self.spell(codes.ravel()), WINDOW * DIGITS
        for j, owner in enumerate(owners.tolist()):
            self.auto.add_word(keys[j * n : (j + 1) * n], owner)
        self.auto.make_automaton()

    def spell(self, codes: np.ndarray) -> str:
        """Letters of word numbers; those of -1 occur in no phrase."""
        out = np.zeros((len(codes), DIGITS), np.int64)
        for k in range(DIGITS):
            out[:, k] = np.where(codes < 0, 0, 1 + k * self.base + codes // self.base**k % self.base)
        return np.where(out >= 0xD800, out + 0x800, out).astype("<u4").tobytes().decode("utf-32-le")

    def cover(self, h: np.ndarray, doc: int, out: np.ndarray) -> None:
        """Marks the words of a document that some phrase with an owner before it covers."""
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        known = self.words[at] == h
        if known.any():
            ends = [end for end, owner in self.auto.iter(self.spell(np.where(known, at, -1))) if owner < doc]
            if ends:
                last = np.array(ends) // DIGITS
                edge = np.zeros(len(h) + 1, np.int32)
                edge[last - WINDOW + 1] += 1
                edge[last + 1] -= 1
                out |= np.cumsum(edge[:-1]) > 0


def removed_words(w: Words, h: np.ndarray, auto: Phrases | None) -> np.ndarray:
    out = np.zeros(len(h), bool)
    if auto is not None:
        for i in np.flatnonzero((w.counts >= WINDOW) & (w.ids != NULL_ID)):
            a, b = w.first[i], w.first[i + 1]
            auto.cover(h[a:b], int(w.ids[i]), out[a:b])
    return out


def phrases_of(w: Words, h: np.ndarray, hits: np.ndarray, second: np.ndarray, owners: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that cover the confirmed passages of some documents, as word hashes, and their owners.

    hits are the keys of the confirmed windows, ascending, and second their other hash, which must agree too.
    """
    s = np.flatnonzero(inside(w.first, WINDOW))
    if not len(s):
        return np.zeros((0, WINDOW), np.uint64), np.zeros(0, np.int64)
    other = (grams(h, WINDOW, P3)[s] >> np.uint64(32)).astype(np.uint32)
    g = window_key(grams(h, WINDOW)[s], other)
    at = np.minimum(np.searchsorted(hits, g), len(hits) - 1)
    doc = np.searchsorted(w.first, s, "right") - 1
    own = (hits[at] == g) & (second[at] == other) & (owners[at] < w.ids[doc]) & (w.ids[doc] != NULL_ID)
    s, owner, doc = s[own], owners[at[own]], doc[own]
    if not len(s):
        return np.zeros((0, WINDOW), np.uint64), np.zeros(0, np.int64)
    head = np.r_[True, (s[1:] != s[:-1] + 1) | (doc[1:] != doc[:-1])]
    run = np.flatnonzero(head)[np.cumsum(head) - 1]
    tile = (np.arange(len(s)) - run) % WINDOW == 0
    tile[:-1] |= head[1:]
    tile[-1] = True
    return h[s[tile][:, None] + np.arange(WINDOW)], owner[tile]


def cleaned(batches: Iterator[pa.RecordBatch], digest: bool, counts: list[str]) -> Iterator[pa.RecordBatch]:
    for _, rows in by_bucket(batches):
        hits, docs = [r for r in rows if r[1] == FOUND], [r[2] for r in rows if r[1] == TEXTS]
        auto = None
        if hits:
            second, owner = joined(hits, 4, np.uint32), joined(hits, 3, np.int64)
            key = window_key(joined(hits, 2, np.uint64), second)
            order = np.argsort(key, kind="stable")
            key, second, owner = key[order], second[order], owner[order]
            parts = [phrases_of(w, w.hashes(), key, second, owner) for raw in docs for w in chunks(unpacked(raw))]
            phrases, owners = (np.concatenate([p[k] for p in parts]) for k in (0, 1)) if parts else ([], [])
            if len(phrases):
                _, one = np.unique(grams(phrases.ravel(), WINDOW)[::WINDOW], return_index=True)
                auto = Phrases(phrases[one], owners[one])
        for b in map(unpacked, docs):
            n_words, n_removed, kept = [], [], []
            for w in chunks(b):
                gone = removed_words(w, w.hashes(), auto)
                for i in range(len(w.ids)):
                    mask = gone[w.first[i] : w.first[i + 1]]
                    n_words.append(len(mask))
                    n_removed.append(int(mask.sum()))
                    if digest:
                        kept.append(hashlib.sha256(kept_words(w, i, mask, n_removed[-1] > 0)).hexdigest())
                    else:
                        kept.append(without(w.data[w.offsets[i] : w.offsets[i + 1]].tobytes(), w, i, mask).decode() if n_removed[-1] else None)
            if digest:
                yield pa.record_batch([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])
            else:
                text = pa.array([k if r else t for k, r, t in zip(kept, n_removed, b.column("text").to_pylist(), strict=True)], pa.string())
                columns = [text if name == "text" else b.column(i) for i, name in enumerate(b.schema.names)]
                more = [pa.array(x, pa.int64()) for x in (n_words, n_removed)][: len(counts)]
                yield pa.record_batch([*columns, *more], [*b.schema.names, *counts])


def kept_words(w: Words, i: int, mask: np.ndarray, some: bool, most: int = 1_000_000) -> bytes:
    """A document's words but the masked ones, joined by one space."""
    raw = w.data[w.offsets[i] : w.offsets[i + 1]]
    if len(raw) <= most:
        parts = raw.tobytes().split()
        return b" ".join([x for x, m in zip(parts, mask.tolist(), strict=True) if not m] if some else parts)
    # Of a long one, the bytes of kept words, and the white space behind each but the last as a space.
    a, b, left = w.first[i], w.first[i + 1], ~mask
    starts, ends = (x[a:b][left] - w.offsets[i] for x in (w.starts, w.ends))
    edge = np.zeros(len(raw) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    keep, out = np.cumsum(edge[:-1], dtype=np.int8) > 0, raw.copy()
    keep[ends[:-1]] = True
    out[ends[:-1]] = 32
    return out[keep].tobytes()


def without(raw: bytes, w: Words, i: int, mask: np.ndarray) -> bytes:
    """A document's bytes without the masked words and the white space after each of them."""
    a, base = w.first[i], w.offsets[i]
    starts = w.starts[a : a + len(mask)] - base
    after = np.r_[starts[1:], len(raw)]
    keep = np.ones(len(raw), bool)
    edge = np.zeros(len(raw) + 1, np.int32)
    np.add.at(edge, starts[mask], 1)
    np.add.at(edge, after[mask], -1)
    keep &= np.cumsum(edge[:-1]) == 0
    return np.frombuffer(raw, np.uint8)[keep].tobytes()


def _through(df: DataFrame, step, *args) -> DataFrame:
    return df.mapInArrow(lambda batches: record_batches(step(batches, *args), PACKED), PACKED_SQL)


def remove_repeats(docs: DataFrame, digest: bool = False, counts: tuple[str, str] | None = None) -> DataFrame:
    """All rows of docs with text less its repeated words; counts names two more columns, of words and of removed words.

    With digest: doc_id, n_words, n_removed and kept_sha256, of the kept words joined by one space.
    """
    spark, n = docs.sparkSession, buckets(docs)
    own = texts(docs)
    cand = written(_through(dealt(_through(own, candidate_rows, n), n), recurring, n), path := scratch(spark, "passages"))
    rows = _through(dealt(packed_documents(own, n).unionByName(cand), n), window_rows, n)
    hits = written(_through(dealt(rows, n), confirmed), scratch(spark, "passages"))
    dropped(spark, path)
    whole = own if digest else docs.withColumns({"doc_id": F.col("doc_id").cast("long"), "text": F.col("text").cast("string")})
    names = list(counts or ())
    if taken := {c.lower() for c in docs.columns} & {c.lower() for c in names}:
        raise ValueError(f"the table has columns {sorted(taken)} already; choose other names for the counts")
    final = dealt(packed_documents(whole, n).unionByName(hits), n)
    schema = T.StructType([*whole.schema.fields, *[T.StructField(c, T.LongType()) for c in names]])
    return final.mapInArrow(lambda batches: cleaned(batches, digest, names), "doc_id long, n_words long, n_removed long, kept_sha256 string" if digest else schema)


ORACLE_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)),
f AS (SELECT k, min(doc_id) AS least FROM g GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + j AS p FROM g JOIN f USING (k), (SELECT unnest(range(13)) AS j) WHERE least < doc_id),
p AS (SELECT doc_id, unnest(ws) AS x, unnest(range(1, len(ws) + 1)) AS p FROM w),
k AS (SELECT p.doc_id, count(r.p) AS n, string_agg(x, ' ' ORDER BY p.p) FILTER (WHERE r.p IS NULL) AS t FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.p = r.p GROUP BY p.doc_id)
SELECT w.doc_id, len(ws)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN k USING (doc_id)
"""
