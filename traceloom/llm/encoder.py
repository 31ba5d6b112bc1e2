"""Texts to ids with the tokenizers library, each distinct piece of text encoded once for each worker.

White space bounds the library's pieces, so a text is cut where no rule of the tokenizer can look across, the pieces are
looked up, and only a piece not met before goes to the library.
Ids are exactly the library's; the table of pieces is emptied when it reaches a fixed number of pieces or letters, and a long text
is handled part by part, so memory is bounded but for the text and its ids.
"""

from __future__ import annotations

import functools
import os
import re
from array import array
from collections.abc import Callable


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable Latin-1 for itself, others from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, more = [""] * 256, 256
    for b in range(256):
        if b in own:
            out[b] = chr(b)
        else:
            out[b], more = chr(more), more + 1
    return out


#: Pieces and pre-tokens that a worker remembers (about 200 bytes each), and their letters in all; letters of a text that are cut into
#: pieces at once.
REMEMBERED, REMEMBERED_BASE, LETTERS_HELD, SLICE = 800_000, 250_000, 15_000_000, 3_000_000
_ASCII_SPACES = re.compile(r"[\x20\t-\r]+")
_ODD = re.compile(r"[\x1c-\x1f]")
_SINGLE = re.compile(r"(?<=\S) (?=\S)")
_LOOSE = re.compile(r"\s\s|\A\s|\s\Z")
#: White space but the space and the line feed.
_OTHER = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Pieces of these characters alone are cut into pre-tokens here; of both patterns, letters and digits are all that they can meet in them.
_PLAIN_WORD = re.compile(r"[!-~À-ÖØ-öø-ÿ]+\Z")
_PLAIN_LINES = re.compile(r"[ -~\nÀ-ÖØ-öø-ÿ]+\Z")
_FOLDED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")
_SPACED = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ÿ]+| ?[0-9]+| ?[^\sA-Za-z0-9À-ÖØ-öø-ÿ]+|\s+(?!\S)|\s+")
_LETTERS = byte_letters()
_BLANK, _LINE = _LETTERS[32], _LETTERS[10]


def loose(text: str) -> bool:
    """Whether a text has white space at an end or two of it side by side; most texts have none but single spaces and line feeds."""
    if "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0].isspace() or text[-1].isspace():
        return True
    return _OTHER.search(text) is not None and _LOOSE.search(text) is not None


class Remembered(dict):
    """Values kept from their second use on, since most distinct pieces occur once; emptied when it has too many keys or letters.

    What has been used before is told by a byte at its hash; two keys that share one are kept a use early.
    """

    SLOTS = 1 << 22

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.letters, self.used = make, most, 0, bytearray(self.SLOTS)

    def __missing__(self, key: str) -> bytes:
        slot = hash(key) & self.SLOTS - 1
        if not self.used[slot]:
            self.used[slot] = 1
            return self.make(key)
        if len(self) >= self.most or self.letters > LETTERS_HELD:
            self.clear()
            self.letters = 0
        self.letters += len(key)
        got = self[key] = self.make(key)
        return got


class Encoder:
    """one(text) gives little-endian unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tokenize = self.tokenizer.model.tokenize
        #: Ids of pieces, of pieces by what follows their space, and of pre-tokens.
        self.known, self.base = Remembered(self.piece, REMEMBERED), Remembered(self.pre_token, REMEMBERED_BASE)
        self.spaced = Remembered(self.spaced_piece, REMEMBERED)
        self.plain = self.split = None
        probe = [self.whole(x) for x in ("a b", "a", " b", "a\n b", "\n")]
        # White space is dropped: cut at white space. Or a single space belongs to what follows it: cut before single spaces.
        self.drops = probe[0] == probe[1] + probe[2] and not probe[4]
        self.keeps = not self.drops and probe[0] == probe[1] + probe[2] and probe[3] == probe[1] + probe[4] + probe[2]
        if self.drops or self.keeps:
            self.plain, self.split = (_PLAIN_WORD, _FOLDED) if self.drops else (_PLAIN_LINES, _SPACED)
            tests = ["It's", "DON'T", "l'Été,", "x0y12", "--'ve..", "ÀÿßÞ", "'tis", "a'S'", *([] if self.drops else [" a12,b", " ÷x".replace("÷", ","), "a.\nB", " 'll", " x\n\ny", " 12"])]
            if any(self.piece(x) != self.whole(x) for x in tests):
                self.plain = None
            self.base.clear()

    def whole(self, text: str) -> bytes:
        """Ids by the library itself."""
        return array("I", self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def pre_token(self, text: str) -> bytes:
        letters = text.replace(" ", _BLANK).replace("\n", _LINE) if text.isascii() else "".join(map(_LETTERS.__getitem__, text.encode()))
        return array("I", [t.id for t in self.tokenize(letters)]).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of what stands alone: of Latin pieces pre-token by pre-token with the library's BPE model, of others as a whole."""
        if self.plain is not None and text.isascii() and text[text[:1] == " " :].isalpha():  # most pieces are one pre-token
            return self.pre_token(text.lower() if self.drops else text)
        if self.plain is None or self.plain.match(text) is None or "<|" in text:
            return self.whole(text)
        return b"".join(map(self.base.__getitem__, self.split.findall(text.lower() if self.drops else text)))

    def spaced_piece(self, text: str) -> bytes:
        """Ids of a space and what follows it."""
        if self.plain is not None and text.isascii() and text.isalpha():
            return array("I", [t.id for t in self.tokenize(_BLANK + text)]).tobytes()
        return self.piece(" " + text)

    def one(self, text: str | None) -> bytes:
        """Ids of a text; a null text is empty. A long one is encoded in parts of about SLICE letters, cut between pieces."""
        text, parts, a = text or "", [], 0
        while len(text) - a > SLICE and (self.drops or self.keeps):
            m = (_ASCII_SPACES if self.drops else _SINGLE).search(text, a + SLICE)
            if m is None:
                break
            parts.append(self.part(text[a : m.start()]))
            a = m.start()
        return b"".join([*parts, self.part(text[a:])]) if parts else self.part(text)

    def part(self, text: str) -> bytes:
        if not text:
            return b""
        if self.drops:
            return b"".join(map(self.known.__getitem__, [x for x in _ASCII_SPACES.split(text) if x] if _ODD.search(text) else text.split()))
        if self.keeps:
            cut = iter(_SINGLE.split(text) if loose(text) else text.split(" "))
            return self.known[next(cut)] + b"".join(map(self.spaced.__getitem__, cut))
        return self.whole(text)

    def many(self, texts: list[str | None]) -> list[bytes]:
        return [self.one(t) for t in texts]


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def path_of(name: str) -> str:
    """Where a public vocabulary file lies on this machine; each executor has its own copy of the package."""
    import public_tokenizers

    return public_tokenizers.path(name) if os.sep not in name else name
