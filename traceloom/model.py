"""What a log declares about itself, and the schema of typed attributes."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from datetime import datetime
from enum import Enum
from typing import Any

from pyspark.sql import types as T

#: Attribute types and the field of ATTR that holds their value.
FIELDS = {"string": "s", "date": "ts", "int": "i", "float": "f", "boolean": "b", "id": "s", "list": "list"}

ATTR = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("s", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("off", T.IntegerType()),
    T.StructField("i", T.LongType()), T.StructField("f", T.DoubleType()), T.StructField("b", T.BooleanType()), T.StructField("list", T.StringType()), T.StructField("children", T.StringType()),
])
ATTRIBUTES = T.MapType(T.StringType(), ATTR)
COMPONENTS = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("kind", T.StringType()), T.StructField("attributes", ATTRIBUTES),
    T.StructField("events", T.ArrayType(T.StructType([T.StructField("attributes", ATTRIBUTES)]))),
])


class Scope(Enum):
    EVENT = "event"
    TRACE = "trace"


@dataclass
class Attribute:
    """A key with a typed value and attributes of its own. Values of type list are lists of attributes."""

    key: str
    value: Any
    type: str = ""
    children: list[Attribute] = field(default_factory=list)

    def __post_init__(self) -> None:
        if not self.type:
            kinds = {bool: "boolean", int: "int", float: "float", str: "string", datetime: "date", list: "list"}
            self.type = kinds[type(self.value)]

    def to_json(self) -> dict:
        value = [a.to_json() for a in self.value] if self.type == "list" else self.value.isoformat() if self.type == "date" else self.value
        return {"key": self.key, "type": self.type, "value": value} | ({"children": [c.to_json() for c in self.children]} if self.children else {})

    @classmethod
    def from_json(cls, d: dict) -> Attribute:
        value = [cls.from_json(a) for a in d["value"]] if d["type"] == "list" else datetime.fromisoformat(d["value"]) if d["type"] == "date" else d["value"]
        return cls(d["key"], value, d["type"], [cls.from_json(c) for c in d.get("children", [])])

    def to_row(self) -> tuple:
        """As an ATTR struct."""
        row: dict[str, Any] = dict.fromkeys(ATTR.names)
        row["type"] = self.type
        if self.type == "list":
            row["list"] = json.dumps([a.to_json() for a in self.value])
        else:
            row[FIELDS[self.type]] = self.value
        if self.type == "date":
            offset = self.value.utcoffset()
            row["off"] = int(offset.total_seconds() // 60) if offset is not None else 0
        if self.children:
            row["children"] = json.dumps([c.to_json() for c in self.children])
        return tuple(row.values())


@dataclass(frozen=True)
class ExtensionDecl:
    name: str
    prefix: str
    uri: str


@dataclass
class Global:
    """Attributes that every component of a scope must have; the value gives the type alone."""

    scope: Scope
    attributes: list[Attribute]


@dataclass
class Classifier:
    name: str
    scope: Scope
    keys: str


@dataclass
class Meta:
    extensions: list[ExtensionDecl] = field(default_factory=list)
    globals: list[Global] = field(default_factory=list)
    classifiers: list[Classifier] = field(default_factory=list)
    attributes: dict[str, Attribute] = field(default_factory=dict)

    def globals_of(self, scope: Scope) -> list[Attribute]:
        return [a for g in self.globals if g.scope == scope for a in g.attributes]
