"""Byte-pair encoding and decoding by dynamic programming over prefixes.

For each prefix of a piece the encoding that the merge rules give is unique, and so is its last token. An automaton over
all vocabulary strings yields the tokens that end at a position; a token is the prefix's last one exactly if the prefix
before it is encoded with a last token that stands beside it without a merge across their border. Back-pointers then give
the ids. Nulls and empty texts have no ids; texts of any length are encoded whole, a part at a time; repeated rows and rows with
equal or null ids are encoded each for itself; of equal ranks the left merge comes first; an empty table gives no rows; of the
table's columns only doc_id and text are read, so others may have any name.
"""

from __future__ import annotations

import functools
import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .encoder import byte_letters, path_of
from .shared import texts

REMEMBERED_PIECES, REMEMBERED_LETTERS, REMEMBERED_PAIRS = 1_200_000, 30_000_000, 1_500_000
#: Letters of a text that are cut into pieces at once, and ids that are turned to text at once.
SLICE, IDS_AT_ONCE = 3_000_000, 500_000
#: Stands for the end-of-word suffix inside automaton strings.
END = "\0"
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPACES = re.compile(r"[\x20\t-\r]+")
_ODD = re.compile(r"[\x1c-\x1f]")
NO_MERGE = 1 << 60


class PrefixBpe:
    """Encoder and decoder for a tokenizer file with a BPE model over byte letters."""

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.letters = byte_letters()
        self.bytes_of = {x: b for b, x in enumerate(self.letters)}
        vocab = model["vocab"]
        self.token = {i: t for t, i in vocab.items()} | {x["id"]: x["content"] for x in spec["added_tokens"]}
        self.tokens = [self.token.get(i, "") for i in range(max(self.token) + 1)]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.split_special = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.rank, self.parts, self.death = {}, {}, {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            x, y = vocab[a], vocab[b]
            made = vocab[(a.removesuffix(self.suffix) if self.suffix else a) + b]
            self.rank[x, y] = r
            self.parts.setdefault(made, (x, y, r))
        self.right_spine, self.left_spine = functools.cache(self._right), functools.cache(self._left)
        self.pairs: dict[int, bool] = {}
        self.auto = ahocorasick.Automaton()
        sound: dict[int, bool] = {}
        by_rank = sorted(vocab.values(), key=lambda i: self.parts[i][2] if i in self.parts else -1)
        for i in by_rank:  # a token counts only if its own string is encoded as that token
            own = self.parts.get(i)
            sound[i] = own is None or sound[own[0]] and sound[own[1]] and not self._merges(own[0], own[1], own[2])
            if sound[i]:
                text = self.tokens[i]
                key = text.removesuffix(self.suffix) + END if self.suffix and text.endswith(self.suffix) else text
                self.auto.add_word(key, (i, len(key)))
        self.auto.make_automaton()
        normal = spec.get("normalizer")
        self.folds = str(normal).count("Lowercase") > 0 and spec["pre_tokenizer"]["type"] == "Sequence"
        self.known: dict[str, bytes] = {}
        self.held = 0

    def _right(self, t: int) -> list[tuple[int, int]]:
        """Tokens at t's right end while it is built, each with the rank of the merge that consumes it."""
        out, gone = [(t, NO_MERGE)], NO_MERGE
        while t in self.parts:
            _, t, gone = self.parts[t]
            out.append((t, gone))
        return out

    def _left(self, t: int) -> list[tuple[int, int]]:
        out, gone = [(t, NO_MERGE)], NO_MERGE
        while t in self.parts:
            t, _, gone = self.parts[t]
            out.append((t, gone))
        return out

    def _merges(self, a: int, b: int, below: int = NO_MERGE) -> bool:
        """Whether some merge of rank under below happens across the border of a and b. Of equal ranks the left one comes first."""
        rank = self.rank
        for x, gone_x in self._right(a):
            for y, gone_y in self._left(b):
                r = rank.get((x, y))
                if r is not None and r < gone_x and r <= gone_y and r < below:
                    return True
        return False

    def compatible(self, a: int, b: int) -> bool:
        key = a << 20 | b
        got = self.pairs.get(key)
        if got is None:
            if len(self.pairs) > REMEMBERED_PAIRS:
                self.pairs.clear()
            rank, got = self.rank.get, True
            for x, gone_x in self.right_spine(a):
                for y, gone_y in self.left_spine(b):
                    r = rank((x, y))
                    if r is not None and r < gone_x and r <= gone_y:
                        got = False
            self.pairs[key] = got
        return got

    def piece(self, letters: str) -> list[int]:
        """Ids of one pre-token, given in byte letters."""
        key = letters + END if self.suffix else letters
        n = len(key)
        last, back, pairs, compatible = [-1] * (n + 1), [0] * (n + 1), self.pairs, self.compatible
        for end, (token, size) in self.auto.iter(key):
            at, start = end + 1, end + 1 - size
            if last[at] >= 0:
                continue
            if start:
                before = last[start]
                if before < 0:
                    continue
                ok = pairs.get(before << 20 | token)
                if not (compatible(before, token) if ok is None else ok):
                    continue
            last[at], back[at] = token, start
        if last[n] < 0:
            raise ValueError(f"no encoding of {letters!r}")
        out = []
        while n:
            out.append(last[n])
            n = back[n]
        return out[::-1]

    def chunk(self, text: str) -> list[int]:
        """Ids of a text without regard to what stands beside it."""
        out: list[int] = []
        if self.split_special and "<|" in text:
            at = 0
            for m in self.split_special.finditer(text):
                out += self.chunk_plain(text[at : m.start()])
                out.append(self.special[m[0]])
                at = m.end()
            return out + self.chunk_plain(text[at:])
        return self.chunk_plain(text)

    def chunk_plain(self, text: str) -> list[int]:
        if not text:
            return []
        if self.folds and _PLAIN.match(text):
            text, letters, out = text.lower(), self.letters, []
            for x in _LATIN.findall(text):
                out += self.piece(x if x.isascii() else "".join([letters[b] for b in x.encode()]))
            return out
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [i for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text) for i in self.piece(x)]

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        text = text or ""
        if not self.folds:  # what stands beside white space matters to this tokenizer
            return np.array(self.chunk(text), "<u4").tobytes()
        if len(text) <= SLICE:
            return self.known_pieces(text)
        parts, a = [], 0
        while len(text) - a > SLICE and (m := _SPACES.search(text, a + SLICE)):
            parts.append(self.known_pieces(text[a : m.start()]))
            a = m.start()
        return b"".join([*parts, self.known_pieces(text[a:])])

    def known_pieces(self, text: str) -> bytes:
        """Ids of a text cut at white space; pieces are remembered up to a number of them and of their letters."""
        pieces = [x for x in _SPACES.split(text) if x] if _ODD.search(text) else text.split()
        known = self.known
        try:
            return b"".join(map(known.__getitem__, pieces))
        except KeyError:
            if len(known) > REMEMBERED_PIECES or self.held > REMEMBERED_LETTERS:
                known.clear()
                self.held = 0
            for x in pieces:
                if x not in known:
                    known[x] = np.array(self.chunk(x), "<u4").tobytes()
                    self.held += len(x)
            return b"".join(map(known.__getitem__, pieces))

    def decode(self, ids: bytes) -> str:
        """Text of ids as the library's decode with skip_special_tokens=False gives it."""
        tokens, numbers, plain = self.tokens, np.frombuffer(ids, "<u4"), self.library.decoder is None
        back, parts = self.bytes_of, []
        for i in range(0, len(numbers), IDS_AT_ONCE):
            own = [tokens[k] for k in numbers[i : i + IDS_AT_ONCE].tolist()]
            parts.append(" ".join(own) if plain else b"".join(bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t in own))
        return " ".join(parts) if plain else b"".join(parts).decode("utf-8", "replace")


@functools.lru_cache(2)
def model(path: str) -> PrefixBpe:
    return PrefixBpe(path)


def encode_documents(docs: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, n_tokens and ids (binary, unsigned 32-bit little-endian) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path_of(tokenizer))
        for b in batches:
            ids = [bpe.encode(t) for t in b.column("text").to_pylist()]
            yield pa.record_batch([b.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id and text of rows with doc_id and ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path_of(tokenizer))
        for b in batches:
            yield pa.record_batch([b.column("doc_id"), pa.array([bpe.decode(x or b"") for x in b.column("ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Encodes and decodes every text in one pass and returns digests of ids and decoded text, which stay in the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path_of(tokenizer))
        for b in batches:
            n, of_ids, of_text = [], [], []
            for i in range(b.num_rows):
                ids = bpe.encode(b.column("text")[i].as_py())
                n.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(bpe.decode(ids).encode()).hexdigest())
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(of_ids), pa.array(of_text)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
