"""The catalogue of named operators that flows are made of.

A plugin declares attributes (some with defaults), artifacts, streams and sinks; a call binds attributes by name and the
others by position. Streams are logs; a sink is something that consumes one.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..errors import StreamError
from ..model import Meta
from ..operators.eventlog import FlatLog, NestedLog
from ..sources.tables import conversations_log, events_log, orders_log
from ..sources.xes import read_xes, write_xes

Log = FlatLog | NestedLog | None


@dataclass
class Parameters:
    """What a plugin is built from; each thing can be taken once."""

    spark: SparkSession | None = None
    attributes: dict[str, Any] = field(default_factory=dict)
    artifacts: dict[str, Any] = field(default_factory=dict)
    streams: dict[str, Log] = field(default_factory=dict)
    sinks: dict[str, Any] = field(default_factory=dict)
    artifacts_anon: list = field(default_factory=list)
    streams_anon: list = field(default_factory=list)
    sinks_anon: list = field(default_factory=list)
    #: Whether the sink at the end reads every table of the log exactly once.
    consumed: bool = False

    def _take(self, what: str, name: str) -> Any:
        own = getattr(self, what)
        if name not in own:
            raise StreamError(f"no {what[:-1]} {name!r}")
        return own.pop(name)

    def attribute(self, name: str) -> Any:
        return self._take("attributes", name)

    def artifact(self, name: str) -> Any:
        return self._take("artifacts", name)

    def stream(self, name: str) -> Log:
        return self._take("streams", name)

    def sink(self, name: str) -> Any:
        return self._take("sinks", name)

    def warn_unused(self) -> None:
        for what in ("attributes", "artifacts", "streams", "sinks"):
            for name in getattr(self, what):
                warnings.warn(f"unused {what[:-1]} {name!r}", stacklevel=2)
            if getattr(self, f"{what}_anon", None):
                warnings.warn(f"unused {what}", stacklevel=2)


@dataclass
class Declaration:
    attributes: list[str] = field(default_factory=list)
    defaults: dict[str, Callable[[], Any]] = field(default_factory=dict)
    artifacts: list[str] = field(default_factory=list)
    streams: list[str] = field(default_factory=list)
    sinks: list[str] = field(default_factory=list)

    def bind(self, spark: SparkSession | None = None, attributes: dict | None = None, artifacts: list = (), streams: list = (), sinks: list = (), consumed: bool = False) -> Parameters:
        """Attributes: as given, else the default, else an error; more than declared are kept. Others by position; more than declared have no name."""
        given = dict(attributes or {})
        for name in self.attributes:
            if name not in given:
                if name not in self.defaults:
                    raise StreamError(f"no attribute {name!r}")
                given[name] = self.defaults[name]()
        out = Parameters(spark, given, consumed=consumed)
        for what, values in (("artifacts", artifacts), ("streams", streams), ("sinks", sinks)):
            names = getattr(self, what)
            if len(values) < len(names):
                raise StreamError(f"no {what[:-1]} {names[len(values)]!r}")
            setattr(out, what, dict(zip(names, values, strict=False)))
            setattr(out, f"{what}_anon", list(values[len(names):]))
        return out


@dataclass
class Built:
    """A stream plugin's result: the log, artifacts known once it has run, logs sent elsewhere, and the stage before it."""

    log: Log
    artifacts: Callable[[], list] = lambda: []
    sent: list = field(default_factory=list)
    name: str = ""
    inner: Built | None = None

    def lineage(self) -> list[Built]:
        """All stages up to this one, the source first."""
        return [*(self.inner.lineage() if self.inner is not None else []), self]

    def emit_artifacts(self) -> list[list]:
        """The artifacts of all stages, one list for each, the source first."""
        return [stage.artifacts() for stage in self.lineage()]


@dataclass
class Plugin:
    name: str
    declaration: Declaration
    build: Callable[[Parameters], Any]
    kind: str


REGISTRY: dict[str, Plugin] = {}


def plugin(name: str, kind: str = "stream", **declared) -> Callable:
    """Registers a factory; a later one of the same name takes its place."""

    def run(build: Callable[[Parameters], Any]) -> Callable:
        REGISTRY[name] = Plugin(name, Declaration(**declared), build, kind)
        return build

    return run


def build(name: str, kind: str, parameters: Callable[[Declaration], Parameters]) -> Any:
    own = REGISTRY.get(name)
    if own is None or own.kind != kind:
        raise StreamError(f"no such {kind} plugin: {name}")
    p = parameters(own.declaration)
    out = own.build(p)
    p.warn_unused()
    return out


def list_plugins(spark: SparkSession) -> DataFrame:
    """name, kind and what each plugin declares, sorted by name."""
    rows = [(p.name, p.kind, p.declaration.attributes, p.declaration.streams, p.declaration.sinks) for p in sorted(REGISTRY.values(), key=lambda p: p.name)]
    return spark.createDataFrame(rows, "name string, kind string, attributes array<string>, streams array<string>, sinks array<string>")


@plugin("VoidStream")
def _void_stream(p: Parameters) -> Built:
    return Built(None)


@plugin("VoidSink", kind="sink")
def _void_sink(p: Parameters) -> Callable[[Log], None]:
    def consume(log: Log) -> None:
        """All rows of all tables in one job; of their values only what stages look at is read."""
        rows = [df.select(F.lit(True).alias("row")) for df in tables_of(log)]
        if rows:
            reduce(DataFrame.unionAll, rows).write.format("noop").mode("overwrite").save()

    return consume


def tables_of(log: Log) -> list[DataFrame]:
    return [] if log is None else log.tables()


@plugin("Statistics", streams=["inner"])
def _statistics(p: Parameters) -> Built:
    """Counts are taken in passing where the sink reads all there is; otherwise they are an action of their own."""
    log = p.stream("inner")
    if p.consumed and log is not None:
        own = [Observation(), Observation()]
        if (seen := log.observed(own)) is not None:
            used = own[: len(seen.tables())]
            return Built(seen, lambda: [log.counts_of(own) if done(used) else log.artifact()])
    return Built(log, lambda: [log.artifact()])


def done(observations: list[Observation], seconds: float = 10.0) -> bool:
    """Whether observations have been made; the listener that makes them may lag behind the action, and an optimiser that finds a
    table empty drops them."""
    end = time.monotonic() + seconds
    while not all(o._jo.future().isCompleted() for o in observations):
        if time.monotonic() > end:
            return False
        time.sleep(0.01)
    return True


@plugin("Validator", streams=["inner"])
def _validator(p: Parameters) -> Built:
    return Built(p.stream("inner").validate())


@plugin("Repair", streams=["inner"])
def _repair(p: Parameters) -> Built:
    return Built(p.stream("inner").repair())


@plugin("Duplicator", streams=["inner"], sinks=["copy"])
def _duplicator(p: Parameters) -> Built:
    p.sink("copy")
    a, b = p.stream("inner").duplicate()
    return Built(a, sent=[b])


def _seed() -> int:
    return time.time_ns()


@plugin("Split", streams=["inner"], sinks=["sink"], attributes=["ratio", "seed"], defaults={"seed": _seed})
def _split(p: Parameters) -> Built:
    p.sink("sink")
    train, test = p.stream("inner").split(float(p.attribute("ratio")), int(p.attribute("seed")))
    return Built(train, sent=[test])


@plugin("Sample", streams=["inner"], attributes=["ratio", "seed"], defaults={"seed": _seed})
def _sample(p: Parameters) -> Built:
    return Built(p.stream("inner").sample(float(p.attribute("ratio")), int(p.attribute("seed"))))


@plugin("Receiver", streams=["acquire"])
def _receiver(p: Parameters) -> Built:
    return Built(p.stream("acquire"))


@plugin("Sender", kind="sink", sinks=["emit"])
def _sender(p: Parameters) -> Callable[[Log], None]:
    return p.sink("emit")


@plugin("XesReader", attributes=["path"])
def _xes_reader(p: Parameters) -> Built:
    return Built(read_xes(p.spark, str(p.attribute("path"))))


@plugin("TableReader", attributes=["folder", "log"])
def _table_reader(p: Parameters) -> Built:
    """One of the logs over the driver's tables."""
    own = {"events": events_log, "orders": orders_log, "conversations": conversations_log}
    return Built(own[str(p.attribute("log"))](p.spark, str(p.attribute("folder"))))


@plugin("XesWriter", kind="sink", attributes=["path", "indent"], defaults={"indent": lambda: 0})
def _xes_writer(p: Parameters) -> Callable[[Log], None]:
    path, indent = str(p.attribute("path")), int(p.attribute("indent"))
    return lambda log: write_xes(log.nested() if isinstance(log, FlatLog) else log or NestedLog(p.spark.createDataFrame([], "seq long, kind string, attributes map<string,string>, events array<string>"), Meta()), path, indent)
