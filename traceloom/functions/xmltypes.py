"""XML string types as patterns, for the driver (Python) and for columns (Java); both read the same text.

An NCName is that of 1999, over the character classes of appendix B of XML 1.0. These are built by the rule that the appendix
itself states, from categories and decompositions of the oldest Unicode data that Python has (3.2) inside the blocks of Unicode 2;
so some letters that were added to those blocks between the two versions count too.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import add
from unicodedata import ucd_3_2_0 as old

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ParseBooleanError, ValidationError

# Name start characters and further name characters of XML 1.0 (fifth edition) in the basic plane.
NAME_START = r":A-Z_a-zÀ-ÖØ-öø-˿Ͱ-ͽͿ-῿‌-‍⁰-↏Ⰰ-⿯、-퟿豈-﷏ﷰ-�"
NAME_MORE = r"\-.0-9·̀-ͯ‿-⁀"
TOKEN = r"(?:[^ \t\n\r]+(?: [^ \t\n\r]+)*)?"
NAME = f"[{NAME_START}][{NAME_START}{NAME_MORE}]*"

# Fixed values of the appendix: blocks of its time (as first and last letter), what counts as a start of names although its category
# says otherwise, what is left out, and the extenders.
BLOCKS = [(0x41, 0x233), (0x250, 0x2E9), (0x300, 0x3FF), (0x401, 0x4F9), (0x531, 0x587), (0x591, 0x5F4), (0x60C, 0x6F9), (0x901, 0xDFF), (0xE01, 0xFBC), (0x10A0, 0x10FB), (0x1100, 0x11F9), (0x1E00, 0x1FFC), (0x20D0, 0x20E1), (0x2126, 0x2182), (0x3005, 0x312C), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3)]
ALSO_START = {*range(0x2BB, 0x2C2), 0x559, 0x6E5, 0x6E6}
LEFT_OUT = {*range(0x20DD, 0x20E1)}
EXTENDERS = [0xB7, 0x2D0, 0x2D1, 0x387, 0x640, 0xE46, 0xEC6, 0x3005, *range(0x3031, 0x3036), 0x309D, 0x309E, *range(0x30FC, 0x30FF)]
IDEOGRAPHS = [0x3007, *range(0x3021, 0x302A), *range(0x4E00, 0x9FA6)]


def _ranges(points: list[int]) -> str:
    """Inside of a bracket expression for some characters."""
    out: list[list[int]] = []
    for p in sorted(set(points)):
        if out and out[-1][1] == p - 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in out)


def _points() -> dict[str, list[int]]:
    """Code points of each class; no two classes have one in common."""
    of: dict[str, list[int]] = {"BaseChar": [], "CombiningChar": [], "Digit": []}
    special = {*EXTENDERS, *IDEOGRAPHS}
    for a, b in BLOCKS:
        for p in range(a, b + 1):
            kind = old.category(chr(p))
            if p in special or p in LEFT_OUT or old.decomposition(chr(p)).startswith("<"):
                continue
            if kind in ("Ll", "Lu", "Lo", "Lt", "Nl") or p in ALSO_START:
                of["BaseChar"].append(p)
            elif kind in ("Mc", "Me", "Mn"):
                of["CombiningChar"].append(p)
            elif kind == "Nd":
                of["Digit"].append(p)
    of["Digit"] += range(0x30, 0x3A)
    return of | {"Extender": EXTENDERS, "Ideographic": IDEOGRAPHS}


_POINTS = _points()
#: BaseChar, Ideographic, CombiningChar, Digit, Extender and Letter as insides of bracket expressions.
CLASSES = {k: _ranges(v) for k, v in _POINTS.items()}
CLASSES["Letter"] = CLASSES["BaseChar"] + CLASSES["Ideographic"]
# One character of each class, its mark; all characters of classes and the mark of each, as arguments of translate.
_MARKS = {k: chr(v[0]) for k, v in _POINTS.items()}
_MARKED = "".join(chr(p) for v in _POINTS.values() for p in v), "".join(_MARKS[k] * len(v) for k, v in _POINTS.items())
NCNAME = "[{Letter}_][{Letter}{Digit}{CombiningChar}{Extender}._\\-]*".format(**CLASSES)
URI = r"[A-Za-z][A-Za-z0-9+.\-]*:"
_PYTHON = {k: re.compile(v) for k, v in (("token", TOKEN), ("Name", NAME), ("NCName", NCNAME))}
_URI = re.compile(URI)
_CLASS = {k: re.compile(f"[{v}]") for k, v in CLASSES.items()}


def in_class(name: str, letter: str) -> bool:
    """Whether one character is in a class of CLASSES."""
    return _CLASS[name].fullmatch(letter) is not None


def marked(text: Column) -> Column:
    """text with the mark of its class for each character of a class; others stay, and none of them is a mark.

    This is one look into a table for each character, where bracket expressions try hundreds of ranges. Counts of several classes
    should share it as a column of its own.
    """
    return F.translate(text, *_MARKED)


def marks_in(name: str, text: Column) -> Column:
    """How many marks of a class of CLASSES a marked text has."""
    counts = [F.length(text) - F.length(F.replace(text, F.lit(_MARKS[k]), F.lit(""))) for k in (("BaseChar", "Ideographic") if name == "Letter" else (name,))]
    return reduce(add, counts)


def letters_in(name: str, text: Column) -> Column:
    """How many characters of a text are in a class of CLASSES."""
    return marks_in(name, marked(text))


def is_valid(kind: str, text: str) -> bool:
    """kind: token, Name, NCName or anyURI; the last asks for a scheme anywhere in the text."""
    return _URI.search(text) is not None if kind == "anyURI" else _PYTHON[kind].fullmatch(text) is not None


def checked(kind: str, text: str) -> str:
    if not is_valid(kind, text):
        raise ValidationError(f"{text!r} is no valid xs:{kind}")
    return text


def matches(kind: str, text: Column) -> Column:
    """is_valid of a column."""
    if kind == "anyURI":
        return text.rlike(URI)
    return text.rlike(r"\A(?:" + {"token": TOKEN, "Name": NAME, "NCName": NCNAME}[kind] + r")\z")


def parse_bool(text: str) -> bool:
    if text in ("true", "1"):
        return True
    if text in ("false", "0"):
        return False
    raise ParseBooleanError(text)


def boolean(text: Column) -> Column:
    """True, false, or null for text that is no boolean literal."""
    return F.when(text.isin("true", "1"), True).when(text.isin("false", "0"), False)
