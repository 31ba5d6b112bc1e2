"""Counts about whole texts, for rules and classifiers, by array operations over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .shared import texts
from .words import Words, chunks, grams, inside, mix

COLUMNS = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_distinct", "n_upper", "n_letters", "n_digits", "n_shouts", "n_bars", "n_stops", "n_marks"]


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode())] = True
    return out


SYMBOLS, UPPER, DIGITS = _table("#*$%&|<>"), _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789")
LETTERS = UPPER | _table("abcdefghijklmnopqrstuvwxyz")
MARKS = _table("!\"'(),-./:;=?@[\\]^_`{}~+") | SYMBOLS


def repeats(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether each (doc, h) occurs twice or more."""
    key = mix(h ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key)
    key = key[order]
    same = np.zeros(len(key), bool)
    same[1:] = key[1:] == key[:-1]
    same[:-1] |= same[1:]
    out = np.zeros(len(key), bool)
    out[order] = same
    return out


def distinct(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """How many different h each document has."""
    key = np.sort(mix(h ^ (doc.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & np.uint64(0xFFFFFFFF00000000) | doc.astype(np.uint64))
    fresh = np.ones(len(key), bool)
    fresh[1:] = key[1:] != key[:-1]
    return np.bincount((key[fresh] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=n)


def stats(w: Words) -> dict[str, np.ndarray]:
    n, data = len(w.ids), w.data

    def count(flags: np.ndarray) -> np.ndarray:
        if n == 1:
            return np.array([np.count_nonzero(flags)])
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[w.offsets[1:]] - total[w.offsets[:-1]]

    out = {"n_words": w.counts}
    of_words = np.zeros(len(data) + 1, np.int8)
    np.add.at(of_words, w.starts, 1)
    np.add.at(of_words, w.ends, -1)
    out["word_chars"] = count((np.cumsum(of_words[:-1], dtype=np.int8) > 0) & ((data & 0xC0) != 0x80))
    out["n_symbols"] = count(SYMBOLS[data])
    # Lines: cut at \n and at document borders; a line counts if it has a word.
    cuts = np.unique(np.concatenate([w.offsets, np.flatnonzero(data == 10), np.flatnonzero(data == 10) + 1]))
    a, b = cuts[:-1], cuts[1:]
    worded = np.searchsorted(w.starts, b) > np.searchsorted(w.starts, a)
    a, b = a[worded], b[worded]
    line_doc = np.searchsorted(w.offsets, a, "right") - 1
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = out["n_lines"] - distinct_exact(line_doc, w.hashes(starts=a, ends=b, data=data), n)
    h = w.hashes()
    doc = w.doc
    out["n_distinct"] = distinct(doc, h, n)
    covered = np.zeros(len(h), bool)
    if len(h) >= 3:
        g = grams(h, 3)
        at = np.flatnonzero(inside(w.first, 3)[: len(g)])
        twice = at[repeats(doc[at], g[at])]
        for j in range(3):
            covered[twice + j] = True
    total = np.concatenate([[0], np.cumsum(covered)])
    out["n_repeat_words"] = total[w.first[1:]] - total[w.first[:-1]]
    for name, flags in (("n_upper", UPPER), ("n_letters", LETTERS), ("n_digits", DIGITS), ("n_marks", MARKS)):
        out[name] = count(flags[data])
    for name, c in (("n_shouts", b"!"), ("n_bars", b"|"), ("n_stops", b".")):
        out[name] = count(data == c[0])
    return out


def distinct_exact(doc: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """As distinct, with all 64 bits of the hash."""
    order = np.lexsort((h, doc))
    d, h = doc[order], h[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return np.bincount(d[fresh], minlength=n)


def with_stats(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, columns named in more, and COLUMNS as long for every document; a null text counts as empty."""
    df = texts(docs, *more)
    schema = T.StructType([f for f in df.schema if f.name != "text"] + [T.StructField(c, T.LongType()) for c in COLUMNS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [stats(w) for w in chunks(b)]
            if parts:
                arrays = [pa.array(np.concatenate([p[c] for p in parts]).astype(np.int64)) for c in COLUMNS]
                yield pa.record_batch([b.column("doc_id"), *[b.column(c) for c in more], *arrays], ["doc_id", *more, *COLUMNS])

    return df.mapInArrow(run, schema)
