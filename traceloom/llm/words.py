"""Words and their hashes for whole Arrow batches, by array operations on the UTF-8 bytes.

A word is a run of bytes other than space, tab, line feed, vertical tab, form feed and carriage return. These bytes
never occur inside a multi-byte character, so byte runs and character runs are the same.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Bytes of text that are handled at once; temporary arrays take about 40 times as much. Of a longer document the hashes are made
#: piece by piece; arrays with a number for each of its words remain, about 15 times its size.
CHUNK = 500_000

P1, P2, P3 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Stands for a null document id.
NULL_ID = -(1 << 63)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(p: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """p**i and p**-i modulo 2**64 for i < n."""
    got = _POWERS.get(p)
    if got is None or len(got[0]) < n:
        size = max(n, CHUNK + 65_536)
        inverse = pow(p, -1, 1 << 64)
        got = tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(size, x, np.uint64)]) for x in (p, inverse))
        if size <= 4 * CHUNK:
            _POWERS[p] = got
    return got


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit values over all others."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def long_hash(data: np.ndarray) -> np.uint64:
    """The hash of one span of any length."""
    up, _ = powers(P1, CHUNK + 1)
    total = np.zeros(1, np.uint64)
    for k in range(0, len(data), CHUNK):
        block = data[k : k + CHUNK].astype(np.uint64) + np.uint64(1)
        total += (block * up[: len(block)]).sum(dtype=np.uint64, keepdims=True) * np.uint64(pow(P1, k, 1 << 64))
    return mix(total + np.uint64(len(data)))[0]


@dataclass
class Words:
    """Words of some documents, in order. starts and ends are byte positions in data; first[i]:first[i + 1] are document i's."""

    data: np.ndarray
    ids: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Document index of each word."""
        return np.repeat(np.arange(len(self.ids)), self.counts)

    def hashes(self, data: np.ndarray | None = None, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of other spans that don't overlap; CHUNK bytes at a time."""
        data = self.data if data is None else data
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        out, i = np.empty(len(starts), np.uint64), 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + CHUNK, "right")))
            a, b = int(starts[i]), int(ends[j - 1])
            if b - a > CHUNK:
                out[i] = long_hash(data[a:b])
            else:
                up, down = powers(P1, b - a + 1)
                total = np.zeros(b - a + 1, np.uint64)
                np.cumsum((data[a:b].astype(np.uint64) + np.uint64(1)) * up[: b - a], out=total[1:])
                s, e = starts[i:j] - a, ends[i:j] - a
                out[i:j] = mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64))
            i = j
        return out

    def text(self, i: int, j: int) -> bytes:
        return self.data[self.starts[i] : self.ends[j - 1]].tobytes()


def grams(h: np.ndarray, k: int, p: int = P2) -> np.ndarray:
    """A hash of each k consecutive word hashes, document borders ignored; shorter by k - 1 than h."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = powers(p, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n])


def inside(first: np.ndarray, k: int) -> np.ndarray:
    """For each word whether k words from it on lie in its document; first as in Words."""
    counts = np.diff(first)
    left = np.repeat(first[1:], counts) - np.arange(first[-1])
    return left >= k


def chunks(batch: pa.RecordBatch, lower: bool = False) -> Iterator[Words]:
    """Words of the documents of a batch with doc_id and text, some MB at a time; a null text has none."""
    if (other := sys.modules.get(f"{__package__}.encoder")) is not None:
        other.encoder.cache_clear()  # a worker that turns from encoding to words keeps no pieces
    ids = batch.column("doc_id").fill_null(NULL_ID).to_numpy(zero_copy_only=False)
    col = batch.column("text")
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    if not len(col):
        return
    raw = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    buf = np.frombuffer(col.buffers()[2], np.uint8) if col.buffers()[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(ids):
        b = max(a + 1, int(np.searchsorted(raw, raw[a] + CHUNK, "right")) - 1)
        yield words_of(buf[raw[a] : raw[b]], ids[a:b], raw[a : b + 1] - raw[a], lower)
        a = b


def words_of(data: np.ndarray, ids: np.ndarray, offsets: np.ndarray, lower: bool = False) -> Words:
    if lower:
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    solid = ~SPACE[data]
    begin, end = solid.copy(), solid.copy()
    begin[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edge = offsets[(offsets > 0) & (offsets < len(data))]
    begin[edge] = solid[edge]
    end[edge - 1] = solid[edge - 1]
    starts = np.flatnonzero(begin)
    return Words(data, ids, offsets, starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets))
