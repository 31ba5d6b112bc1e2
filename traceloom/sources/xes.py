"""XES (IEEE 1849-2016) documents: an incremental parser, a Spark data source 'xes' and a writer.

One file is read by one task, component by component, so memory follows the largest trace; a folder is read as its documents in
order of their names. Components of file k are numbered from k * 2**40 on. Values are unescaped when read and escaped when
written. A large log is written as a folder of documents, by all executors at once (write_folder).
"""

from __future__ import annotations

import io
import json
import re
import uuid
import warnings
from collections import deque
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime, timedelta, timezone
from typing import IO, Any
from xml.parsers import expat
from xml.sax.saxutils import quoteattr

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..errors import EventFlowError, KeyMissingError, ParseDateTimeError, ParseFloatError, ParseIntError, StateError, StreamError, XesError, mapped, tagged
from ..functions.xmltypes import checked, parse_bool
from ..model import COMPONENTS, FIELDS, Attribute, Classifier, ExtensionDecl, Global, Meta, Scope
from ..operators.eventlog import NestedLog

_DATE = re.compile(r"(\d{4}-\d\d-\d\d)[Tt](\d\d:\d\d:\d\d)(?:\.(\d+))?([Zz]|[+-]\d\d:\d\d)")
_INT = re.compile(r"[+-]?[0-9]+")
_FLOAT = re.compile(r"[+-]?(?:[Ii][Nn][Ff](?:[Ii][Nn][Ii][Tt][Yy])?|[Nn][Aa][Nn]|(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)")
ATTRIBUTE_TAGS = tuple(FIELDS)
FILE_STEP = 1 << 40


def parse_date(text: str) -> datetime:
    """A date with time and offset; digits past microseconds are cut."""
    m = _DATE.fullmatch(text)
    if m is None:
        raise ParseDateTimeError(text)
    try:
        return datetime.fromisoformat(f"{m[1]}T{m[2]}.{(m[3] or '0')[:6].ljust(6, '0')}{'+00:00' if m[4] in 'Zz' else m[4]}")
    except ValueError as e:
        raise ParseDateTimeError(text) from e


def parse_value(kind: str, text: str) -> Any:
    if kind == "date":
        return parse_date(text)
    if kind == "int":
        if not _INT.fullmatch(text) or not -(1 << 63) <= int(text) < 1 << 63:
            raise ParseIntError(text)
        return int(text)
    if kind == "float":
        if not _FLOAT.fullmatch(text):
            raise ParseFloatError(text)
        return float(text)
    return parse_bool(text) if kind == "boolean" else text


@dataclass
class _Event:
    attributes: dict[str, Attribute]


@dataclass
class _Trace:
    attributes: dict[str, Attribute]
    events: list[_Event]


@dataclass
class _Values:
    attributes: list[Attribute]


@dataclass
class _Root:
    pass


@dataclass
class _Element:
    tag: str
    given: dict[str, str]
    inside: list = field(default_factory=list)

    def need(self, name: str) -> str:
        if name not in self.given:
            raise KeyMissingError(f"{name} not found in {self.tag}")
        return self.given[name]

    def scope(self) -> Scope:
        text = self.given.get("scope", "event")
        if text not in ("event", "trace"):
            raise XesError(f"invalid scope {text!r}")
        return Scope(text)

    def of(self, kind: type) -> list:
        other = [x for x in self.inside if not isinstance(x, kind)]
        if other:
            warnings.warn(f"ignored in {self.tag}: {type(other[0]).__name__}", stacklevel=2)
        return [x for x in self.inside if isinstance(x, kind)]

    def build(self) -> Any:
        """What the element stands for once it is closed."""
        if self.tag in ATTRIBUTE_TAGS:
            return self._attribute()
        if self.tag == "values":
            return _Values(self.of(Attribute))
        if self.tag == "event":
            return _Event({a.key: a for a in self.of(Attribute)})
        if self.tag == "trace":
            inside = self.of((Attribute, _Event))
            return _Trace({a.key: a for a in inside if isinstance(a, Attribute)}, [e for e in inside if isinstance(e, _Event)])
        if self.tag == "extension":
            return ExtensionDecl(self.need("name"), self.need("prefix"), self.need("uri"))
        if self.tag == "global":
            return Global(self.scope(), self.of(Attribute))
        if self.tag == "classifier":
            return Classifier(self.need("name"), self.scope(), self.need("keys"))
        if self.tag == "log":
            return _Root()
        raise XesError(f"unexpected element {self.tag!r}")

    def _attribute(self) -> Attribute:
        key = self.need("key")
        allowed = (Attribute, _Values) if self.tag == "list" else (Attribute,)
        wrong = [x for x in self.inside if not isinstance(x, allowed)]
        if wrong:
            raise XesError(f"unexpected in {self.tag} {key!r}: {type(wrong[0]).__name__}")
        children = [x for x in self.inside if isinstance(x, Attribute)]
        if self.tag == "list":
            return Attribute(key, [a for x in self.inside if isinstance(x, _Values) for a in x.attributes], "list", children)
        return Attribute(key, parse_value(self.tag, self.need("value")), self.tag, children)


class XesParser:
    """Yields Meta once, then traces and events, from chunks of a document; what stands before a defect is yielded first."""

    def __init__(self) -> None:
        self.parser = expat.ParserCreate(namespace_separator=None)
        self.parser.StartElementHandler, self.parser.EndElementHandler = self._open, self._close
        self.parser.buffer_text = True
        self.stack: list[_Element] = []
        self.meta: Meta | None = Meta()
        self.out: deque = deque()
        self.closed = False

    def _open(self, tag: str, given: dict[str, str]) -> None:
        self.stack.append(_Element(tag, given))

    def _close(self, _tag: str) -> None:
        own = self.stack.pop().build()
        if len(self.stack) > 1:
            self.stack[-1].inside.append(own)
            return
        if isinstance(own, (_Trace, _Event, _Root)):
            if self.meta is not None:
                self.out.append(self.meta)
                self.meta = None
            if isinstance(own, _Root):
                self.closed = True
            else:
                self.out.append(own)
            return
        if self.meta is None or isinstance(own, _Values):
            raise StateError(f"unexpected: {type(own).__name__}")
        if isinstance(own, Attribute):
            self.meta.attributes[own.key] = own
        else:
            {ExtensionDecl: self.meta.extensions, Global: self.meta.globals, Classifier: self.meta.classifiers}[type(own)].append(own)

    def read(self, file: IO[bytes], size: int = 1 << 16) -> Iterator[Meta | _Trace | _Event]:
        error: Exception | None = None
        while error is None:
            data = file.read(size)
            try:
                self.parser.Parse(data, not data)
            except expat.ExpatError as e:
                at_end = not data and not self.closed
                error = XesError("no root component found" if at_end else f"at byte {self.parser.ErrorByteIndex}: {e}")
            except EventFlowError as e:
                error = e
            while self.out:
                yield self.out.popleft()
            if not data:
                break
        if error is None and not self.closed:
            error = XesError("no root component found")
        if error is not None:
            raise error


def parse(data: bytes | str) -> Iterator[Meta | _Trace | _Event]:
    return XesParser().read(io.BytesIO(data.encode() if isinstance(data, str) else data))


def as_row(seq: int, own: _Trace | _Event) -> tuple:
    attributes = {k: a.to_row() for k, a in own.attributes.items()}
    if isinstance(own, _Trace):
        return seq, "trace", attributes, [({k: a.to_row() for k, a in e.attributes.items()},) for e in own.events]
    return seq, "event", attributes, None


def _located(path: str) -> tuple[Any, str]:
    """File system and name of a local path or a URI."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def _opened(path: str) -> IO[bytes]:
    where, name = _located(path)
    return where.open_input_stream(name)


def documents(path: str) -> list[str]:
    """The documents that a path stands for: itself, or all files of a folder that end in .xes, by name."""
    from pyarrow import fs

    where, name = _located(path)
    if where.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    names = sorted(f.base_name for f in where.get_file_info(fs.FileSelector(name)) if f.base_name.endswith(".xes"))
    return [f"{path.rstrip('/')}/{n}" for n in names]


@dataclass
class _File(InputPartition):
    path: str
    index: int


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], mode: str):
        self.paths, self.mode = paths, mode

    def partitions(self) -> list[_File]:
        return [_File(p, i) for i, p in enumerate(self.paths)]

    def read(self, partition: _File) -> Iterator[tuple]:
        seq = partition.index * FILE_STEP
        try:
            with _opened(partition.path) as file:
                for own in XesParser().read(file):
                    if not isinstance(own, Meta):
                        yield as_row(seq, own)
                        seq += 1
        except OSError as e:
            raise StreamError(tagged(StreamError, str(e))) from e
        except EventFlowError as e:
            if self.mode != "PERMISSIVE":
                raise type(e)(tagged(type(e), str(e))) from e
            yield seq, "error", {"_error": Attribute("_error", tagged(type(e), str(e))).to_row()}, None


@dataclass
class _Written(WriterCommitMessage):
    part: str
    index: int


class _Writer(DataSourceWriter):
    """Each partition to a document, which appears under its name when all are whole: the path itself, or with folder one in it."""

    def __init__(self, path: str, meta: Meta, indent: int, folder: bool):
        self.path, self.meta, self.indent, self.folder = path, meta, indent, folder

    def write(self, rows: Iterator) -> _Written:
        from pyspark import TaskContext

        index = TaskContext.get().partitionId()
        where, name = _located(self.path)
        part = f"{name}/.{uuid.uuid4().hex}" if self.folder else f"{name}.{uuid.uuid4().hex}"
        if self.folder:
            where.create_dir(name, recursive=True)
        with where.open_output_stream(part) as out:
            for text in rendered(self.meta, rows, self.indent):
                out.write(text.encode())
        return _Written(part, index)

    def commit(self, messages: list) -> None:
        own = sorted((m for m in messages if m is not None), key=lambda m: m.index)
        if len(own) > 1 and not self.folder:
            raise StreamError("a document is written from one partition; call write_xes or write_folder")
        where, name = _located(self.path)
        for m in own:
            where.move(m.part, f"{name}/part-{m.index:06d}.xes" if self.folder else name)

    def abort(self, messages: list) -> None:
        import contextlib

        where, _ = _located(self.path)
        for m in messages:
            if m is not None:
                with contextlib.suppress(OSError):
                    where.delete_file(m.part)


class XesSource(DataSource):
    """spark.read.format('xes').load(path, or several separated by commas); option mode: FAILFAST or PERMISSIVE."""

    @classmethod
    def name(cls) -> str:
        return "xes"

    def schema(self):
        return COMPONENTS

    def reader(self, schema) -> _Reader:
        return _Reader([d for p in self.options["path"].split(",") if p for d in documents(p)], self.options.get("mode", "FAILFAST").upper())

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], meta_of_json(self.options.get("meta", "{}")), int(self.options.get("indent", "0")), self.options.get("folder", "false").lower() == "true")


def read_meta(path: str) -> Meta:
    """The meta data of a document; reading stops at its first trace or event."""
    try:
        with _opened(path) as file:
            for own in XesParser().read(file):
                if isinstance(own, Meta):
                    return own
    except OSError as e:
        raise StreamError(str(e)) from e
    return Meta()


def merged(metas: list[Meta]) -> Meta:
    """Meta data of several documents as one: whatever any of them declares, once; of attributes with equal keys the first."""
    out = Meta()
    for m in metas:
        for own, new in ((out.extensions, m.extensions), (out.globals, m.globals), (out.classifiers, m.classifiers)):
            own += [x for x in new if x not in own]
        out.attributes = m.attributes | out.attributes
    return out


def read_xes(spark: SparkSession, *paths: str, mode: str = "FAILFAST") -> NestedLog:
    """A log of one document or several; its meta data is that of all of them. With mode PERMISSIVE, defects are components of kind error."""
    spark.dataSource.register(XesSource)
    own = [d for p in paths for d in documents(p)]
    if mode == "FAILFAST":
        with ThreadPoolExecutor(16) as pool:
            meta = merged(list(pool.map(read_meta, own)))
    else:
        meta = Meta()
    return NestedLog(spark.read.format("xes").option("mode", mode).load(",".join(paths)), meta)


def from_text(spark: SparkSession, text: str | bytes) -> NestedLog:
    """A log from a document in memory."""
    meta, rows = Meta(), []
    for own in parse(text):
        if isinstance(own, Meta):
            meta = own
        else:
            rows.append(as_row(len(rows), own))
    return NestedLog(spark.createDataFrame(rows, COMPONENTS), meta)


def meta_to_json(meta: Meta) -> str:
    return json.dumps({
        "extensions": [[e.name, e.prefix, e.uri] for e in meta.extensions], "globals": [[g.scope.value, [a.to_json() for a in g.attributes]] for g in meta.globals],
        "classifiers": [[c.name, c.scope.value, c.keys] for c in meta.classifiers], "attributes": [a.to_json() for a in meta.attributes.values()],
    })


def meta_of_json(text: str) -> Meta:
    d = json.loads(text)
    return Meta(
        [ExtensionDecl(*e) for e in d.get("extensions", [])], [Global(Scope(s), [Attribute.from_json(a) for a in own]) for s, own in d.get("globals", [])],
        [Classifier(n, Scope(s), k) for n, s, k in d.get("classifiers", [])], {a.key: a for a in map(Attribute.from_json, d.get("attributes", []))},
    )


def date_text(t: datetime) -> str:
    """With as many groups of three digits of the second as it needs, and Z for UTC."""
    fraction = "" if not t.microsecond else f".{t.microsecond // 1000:03d}" if t.microsecond % 1000 == 0 else f".{t.microsecond:06d}"
    offset = t.utcoffset() or timedelta(0)
    minutes = int(offset.total_seconds() // 60)
    zone = "Z" if not minutes else f"{'-' if minutes < 0 else '+'}{abs(minutes) // 60:02d}:{abs(minutes) % 60:02d}"
    return f"{t:%Y-%m-%dT%H:%M:%S}{fraction}{zone}"


def value_text(kind: str, value: Any) -> str:
    if kind == "date":
        return date_text(value)
    if kind == "boolean":
        return "true" if value else "false"
    if kind == "float":
        if value != value or value in (float("inf"), float("-inf")):
            return {"nan": "NaN", "inf": "inf", "-inf": "-inf"}[str(value)]
        text = format(value, "f") if value == int(value) else format_plain(value)
        return text.rstrip("0").rstrip(".") if "." in text else text
    return str(value)


def format_plain(value: float) -> str:
    """The shortest text that reads back as the same number, without an exponent."""
    from decimal import Decimal

    return format(Decimal(repr(value)), "f")


def of_row(key: str, a) -> Attribute:
    children = [Attribute.from_json(c) for c in json.loads(a["children"])] if a["children"] else []
    if a["type"] == "list":
        return Attribute(key, [Attribute.from_json(x) for x in json.loads(a["list"] or "[]")], "list", children)
    value = a[FIELDS[a["type"]]]
    if a["type"] == "date":
        value = value.replace(tzinfo=timezone.utc) if value.tzinfo is None else value
        value = value.astimezone(timezone(timedelta(minutes=a["off"] or 0)))
    return Attribute(key, value, a["type"], children)


def rendered(meta: Meta, rows: Iterator, indent: int = 0) -> Iterator[str]:
    """A document in pieces: declaration, comments, meta data, components in order."""
    tab, line = ("\t", "\n") if indent > 0 else ("", "")

    def tag(depth: int, name: str, given: dict[str, str], inner: list[str]) -> str:
        head = f"{tab * depth}<{name}" + "".join(f" {k}={quoteattr(v, {chr(10): '&#10;', chr(9): '&#9;', chr(13): '&#13;'})}" for k, v in given.items())
        return f"{head}>{line}{''.join(inner)}{tab * depth}</{name}>{line}" if inner else f"{head}/>{line}"

    def attribute(depth: int, a: Attribute) -> str:
        given = {"key": checked("Name", a.key)} | ({} if a.type == "list" else {"value": value_text(a.type, a.value)})
        inner = [attribute(depth + 1, c) for c in a.children]
        if a.type == "list":
            inner.append(tag(depth + 1, "values", {}, [attribute(depth + 2, x) for x in a.value]))
        return tag(depth, a.type, given, inner)

    def attributes(depth: int, own: dict) -> list[str]:
        return [attribute(depth, own[k]) for k in sorted(own)]

    yield f'<?xml version="1.0" encoding="UTF-8"?>{line}<!-- An event log in the XML serialization of XES, IEEE Std 1849-2016; see http://www.xes-standard.org -->{line}'
    yield f'<log xes.version="1849.2016" xes.features="nested-attributes">{line}'
    for e in meta.extensions:
        yield tag(1, "extension", {"name": checked("NCName", e.name), "prefix": checked("NCName", e.prefix), "uri": checked("anyURI", e.uri)}, [])
    for g in meta.globals:
        yield tag(1, "global", {"scope": g.scope.value}, [attribute(2, a) for a in g.attributes])
    for c in meta.classifiers:
        yield tag(1, "classifier", {"name": checked("NCName", c.name), "scope": c.scope.value, "keys": checked("token", c.keys)}, [])
    yield from attributes(1, meta.attributes)
    for r in rows:
        own = {k: of_row(k, a) for k, a in (r["attributes"] or {}).items()}
        if r["kind"] == "event":
            yield tag(1, "event", {}, attributes(2, own))
        else:
            events = [tag(2, "event", {}, attributes(3, {k: of_row(k, a) for k, a in (e["attributes"] or {}).items()})) for e in r["events"] or []]
            yield tag(1, "trace", {}, attributes(2, own) + events)
    yield f"</log>{line}"


def write_xes(log: NestedLog, path: str, indent: int = 0) -> None:
    """Writes a log to one file (a local path or a URI), streaming its components in order to the driver.

    The order is total, so one writer is what the format asks for; the driver holds one partition at a time. write_folder
    writes from all executors.
    """
    where, name = _located(path)
    part = f"{name}.{uuid.uuid4().hex}"
    try:
        with mapped(), where.open_output_stream(part) as out:
            for text in rendered(log.meta, log.components.orderBy("seq").toLocalIterator(), indent):
                out.write(text.encode())
        where.move(part, name)
    except OSError as e:
        raise StreamError(str(e)) from e
    except EventFlowError:
        where.delete_file(part)
        raise


def write_source(log: NestedLog, path: str, indent: int = 0) -> None:
    """As write_xes, through the data source: one ordered task on an executor writes the file."""
    _save(log, log.components.repartition(1).sortWithinPartitions("seq"), path, indent, False)


def write_folder(log: NestedLog, path: str, indent: int = 0) -> None:
    """Writes a log as a folder of documents with the same meta data, one for each range of components; read_xes reads it as one log."""
    n = int(log.components.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    _save(log, log.components.repartitionByRange(n, "seq").sortWithinPartitions("seq"), path, indent, True)


def _save(log: NestedLog, ordered: DataFrame, path: str, indent: int, folder: bool) -> None:
    ordered.sparkSession.dataSource.register(XesSource)
    ordered.write.format("xes").option("meta", meta_to_json(log.meta)).option("indent", str(indent)).option("folder", str(folder)).mode("append").save(path)


def components_of(spark: SparkSession, folder_or_glob: list[str]) -> DataFrame:
    return read_xes(spark, *folder_or_glob).components
