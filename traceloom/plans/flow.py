"""Flow graphs: pipes of named segments, given by a builder, JSON or YAML, planned in dependency order and run by Spark.

A pipe is a chain of DataFrames; a stream sent by one pipe and received by another is the same table, persisted if it is more
than a scan. Each pipe is one consumption by its sink; a sink that reads everything gives the statistics of all stages in
passing. Mistakes are found before anything runs.
"""

from __future__ import annotations

import json
import logging
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from datetime import datetime
from graphlib import CycleError, TopologicalSorter
from typing import Any

from pyspark import StorageLevel
from pyspark.sql import SparkSession

from ..errors import ArtifactError, ChannelError, FlowError, StreamError, mapped
from ..model import Attribute
from ..operators.eventlog import worth_holding
from . import plugins
from .channels import ChannelNames

log = logging.getLogger(__name__)
#: Attribute types in configurations.
TAGS = {"string": "String", "date": "Date", "int": "Int", "float": "Float", "boolean": "Boolean", "id": "Id", "list": "List"}
KINDS = {v: k for k, v in TAGS.items()}


def attribute_to_dict(a: Attribute) -> dict:
    value = [{"key": x.key} | attribute_to_dict(x) for x in a.value] if a.type == "list" else a.value.isoformat() if a.type == "date" else a.value
    return {TAGS[a.type]: value} | ({"children": {c.key: attribute_to_dict(c) for c in a.children}} if a.children else {})


def attribute_of_dict(key: str, d: dict) -> Attribute:
    tags = [t for t in d if t in KINDS]
    if len(tags) != 1:
        raise FlowError(f"attribute {key!r} needs one type")
    kind, value = KINDS[tags[0]], d[tags[0]]
    if kind == "list":
        value = [attribute_of_dict(x["key"], x) for x in value]
    elif kind == "date" and isinstance(value, str):
        value = datetime.fromisoformat(value)
    elif kind == "float":
        value = float(value)
    return Attribute(key, value, kind, [attribute_of_dict(k, c) for k, c in (d.get("children") or {}).items()])


@dataclass
class Segment:
    name: str
    attributes: dict[str, Attribute] = field(default_factory=dict)
    stream_sender: list[str] = field(default_factory=list)
    stream_receiver: list[str] = field(default_factory=list)
    artifact_sender: list[str] = field(default_factory=list)
    artifact_receiver: list[str] = field(default_factory=list)

    def attribute(self, key: str, value: Any, kind: str = "") -> Segment:
        self.attributes[key] = Attribute(key, value, kind)
        return self

    def emit_stream(self, name: str) -> Segment:
        self.stream_sender.append(name)
        return self

    def acquire_stream(self, name: str) -> Segment:
        self.stream_receiver.append(name)
        return self

    def emit_artifact(self, name: str) -> Segment:
        self.artifact_sender.append(name)
        return self

    def acquire_artifact(self, name: str) -> Segment:
        self.artifact_receiver.append(name)
        return self

    def to_dict(self) -> dict:
        out: dict[str, Any] = {"name": self.name}
        if self.attributes:
            out["attributes"] = {k: attribute_to_dict(self.attributes[k]) for k in sorted(self.attributes)}
        return out | {k: list(v) for k in ("stream_sender", "stream_receiver", "artifact_sender", "artifact_receiver") if (v := getattr(self, k))}

    @classmethod
    def from_dict(cls, d: dict) -> Segment:
        lists = {k: list(d.get(k) or []) for k in ("stream_sender", "stream_receiver", "artifact_sender", "artifact_receiver")}
        return cls(d["name"], {k: attribute_of_dict(k, v) for k, v in (d.get("attributes") or {}).items()}, **lists)


@dataclass
class Pipe:
    name: str
    source: Segment
    streams: list[Segment] = field(default_factory=list)
    sink: Segment | None = None

    def segments(self) -> list[Segment]:
        return [self.source, *self.streams, self.sink or Segment("VoidSink")]

    def to_dict(self) -> dict:
        return {"name": self.name, "source": self.source.to_dict(), "streams": [s.to_dict() for s in self.streams], "sink": self.sink.to_dict() if self.sink else None}

    @classmethod
    def from_dict(cls, d: dict) -> Pipe:
        return cls(d["name"], Segment.from_dict(d["source"]), [Segment.from_dict(s) for s in d.get("streams") or []], Segment.from_dict(d["sink"]) if d.get("sink") else None)


def toposort(edges: set[tuple[int, int]], nodes: list[int]) -> list[int]:
    """Nodes with each sender before its receivers; edges are (receiver, sender)."""
    graph: dict[int, set[int]] = {n: set() for n in nodes}
    for receiver, sender in edges:
        graph[receiver].add(sender)
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise FlowError(f"pipes wait for each other: {e.args[1]}") from e


def timeit(f: Callable[[], Any]) -> tuple[Any, float]:
    began = time.perf_counter()
    return f(), time.perf_counter() - began


class SequentialExecutor:
    def run(self, jobs: list[tuple[int, set[int], Callable[[], None]]]) -> None:
        for _, _, job in jobs:
            job()


class ThreadExecutor:
    """Independent pipes at once, each in a thread of the driver; Spark's scheduler shares the executors among them."""

    def __init__(self, threads: int = 8):
        self.threads = threads

    def run(self, jobs: list[tuple[int, set[int], Callable[[], None]]]) -> None:
        done: dict[int, Any] = {}
        with ThreadPoolExecutor(max(self.threads, len(jobs))) as pool:
            for key, needs, job in jobs:  # senders come first
                before = [done[n] for n in needs]
                done[key] = pool.submit(lambda before=before, job=job: ([f.result() for f in before], job()))
            for f in done.values():
                f.result()


class FlowGraph:
    def __init__(self, pipes: list[Pipe] | None = None, generation: int = 0, artifacts: dict[str, Any] | None = None):
        self.pipes, self.generation, self.artifacts = pipes or [], generation, artifacts or {}
        self.staging: Pipe | None = None
        #: Of the last run: for each pipe its stages' names and artifacts, the source first, and seconds of its phases.
        self.stages: dict[str, list[tuple[str, list]]] = {}
        self.timings: dict[str, dict[str, float]] = {}

    def source(self, name: str, segment: Segment) -> FlowGraph:
        self.close()
        self.staging = Pipe(name, segment)
        return self

    def stream(self, segment: Segment) -> FlowGraph:
        if self.staging is None:
            raise FlowError("a stream needs a source first")
        self.staging.streams.append(segment)
        return self

    def sink(self, segment: Segment) -> FlowGraph:
        if self.staging is None:
            raise FlowError("a sink needs a source first")
        self.staging.sink = segment
        return self.close()

    def close(self) -> FlowGraph:
        if self.staging is not None:
            self.pipes.append(self.staging)
            self.staging = None
        return self

    def to_dict(self) -> dict:
        stored = {k: v if isinstance(v, (list, dict)) else v.to_json() for k, v in self.artifacts.items()}
        return {"generation": self.generation, "artifacts": stored, "staging": self.staging.to_dict() if self.staging else None, "pipes": [p.to_dict() for p in self.pipes]}

    def to_json(self) -> str:
        return json.dumps(self.to_dict(), indent=2)

    @classmethod
    def from_dict(cls, d: dict) -> FlowGraph:
        out = cls([Pipe.from_dict(p) for p in d.get("pipes") or []], int(d.get("generation", 0)), dict(d.get("artifacts") or {}))
        out.staging = Pipe.from_dict(d["staging"]) if d.get("staging") else None
        return out

    @classmethod
    def from_json(cls, text: str) -> FlowGraph:
        return cls.from_dict(json.loads(text))

    @classmethod
    def from_yaml(cls, text: str) -> FlowGraph:
        import yaml

        return cls.from_dict(yaml.safe_load(text))

    def plan(self) -> tuple[list[int], dict[int, set[int]]]:
        """Order of the pipes and what each needs; every mistake of wiring is an error here."""
        streams, artifacts = ChannelNames(), ChannelNames()
        for i, pipe in enumerate(self.pipes):
            streams.owner = artifacts.owner = i + 1
            for s in pipe.segments():
                if s.name not in plugins.REGISTRY:
                    raise FlowError(f"no such plugin: {s.name}")
                for n in s.stream_sender:
                    streams.acquire_sender(n)
                for n in s.stream_receiver:
                    streams.acquire_receiver(n)
                for n in s.artifact_sender:
                    artifacts.acquire_sender(n)
                for n in s.artifact_receiver:
                    artifacts.acquire_receiver(n)
        artifacts.owner = 0
        for n in sorted(artifacts.remaining_senders()):
            if n not in self.artifacts:
                raise FlowError(f"no pipe sends artifact {n!r} and none is stored")
            artifacts.acquire_sender(n)
        artifacts.owner = -1
        for n in sorted(artifacts.remaining_receivers()):
            artifacts.acquire_receiver(n)
        try:
            edges = streams.dependencies() | artifacts.dependencies()
        except ChannelError as e:
            raise FlowError(str(e)) from e
        needs = {i + 1: {s for r, s in edges if r == i + 1 and s > 0} for i in range(len(self.pipes))}
        return toposort({(r, s) for r, s in edges if r > 0 and s > 0}, list(needs)), needs

    def execute(self, spark: SparkSession, executor: SequentialExecutor | ThreadExecutor | None = None) -> dict[str, Any]:
        """Runs all pipes and returns the artifacts; the graph is empty afterwards and keeps its artifacts and configuration."""
        self.close()
        order, needs = self.plan()
        state = _Run(spark, dict(self.artifacts))
        jobs = [(i, needs[i], lambda pipe=self.pipes[i - 1]: state.pipe(pipe)) for i in order]
        try:
            with mapped():
                (executor or SequentialExecutor()).run(jobs)
        finally:
            for df in state.held:
                df.unpersist()
            self.stages, self.timings = state.stages, state.timings
        self.artifacts = state.artifacts | {f"__PIPES_GEN_{self.generation}__": [p.to_dict() for p in self.pipes]}
        self.generation, self.pipes = self.generation + 1, []
        return self.artifacts


class _Run:
    def __init__(self, spark: SparkSession, artifacts: dict[str, Any]):
        self.spark, self.artifacts, self.streams, self.held = spark, artifacts, {}, []
        self.stages: dict[str, list[tuple[str, list]]] = {}
        self.timings: dict[str, dict[str, float]] = {}

    def _inputs(self, s: Segment) -> list:
        return [self.artifacts[n] for n in s.artifact_receiver]

    def pipe(self, pipe: Pipe) -> None:
        sink = pipe.sink or Segment("VoidSink")
        (last, target), acquired = timeit(lambda: (self._stages(pipe, sink), self._build(sink, "sink", {k: a.value for k, a in sink.attributes.items()}, [], sink.stream_sender)))
        _, executed = timeit(lambda: target(last.log))
        made, emitted = timeit(last.emit_artifacts)
        self.timings[pipe.name] = {"acquisition": acquired, "execution": executed, "emission": emitted}
        log.debug("pipe %s: %s", pipe.name, self.timings[pipe.name])
        self.stages[pipe.name] = [(stage.name, own) for stage, own in zip(last.lineage(), made, strict=True)]
        for s, own in zip([pipe.source, *pipe.streams], made, strict=True):
            if len(own) < len(s.artifact_sender):
                raise ArtifactError(f"{s.name} leaves {len(own)} artifacts, not {len(s.artifact_sender)}")
            # Names bind in alphabetical order.
            self.artifacts |= dict(zip(sorted(s.artifact_sender), own, strict=False))

    def _stages(self, pipe: Pipe, sink: Segment) -> plugins.Built:
        """The chain of the pipe's stages; what it sends is known afterwards."""
        inner = None
        for s in [pipe.source, *pipe.streams]:
            given = ([] if inner is None else [inner.log]) + [self.streams[n] for n in s.stream_receiver]
            built = self._build(s, "stream", {k: a.value for k, a in s.attributes.items()}, given, s.stream_sender, sink.name == "VoidSink")
            if len(built.sent) < len(s.stream_sender):
                raise FlowError(f"{s.name} sends {len(built.sent)} streams, not {len(s.stream_sender)}")
            if s.stream_sender:
                self._hold(given)
            for n, own in zip(s.stream_sender, built.sent, strict=False):
                self.streams[n] = own
            built.name, built.inner, inner = s.name, inner, built
        return inner

    def _hold(self, logs: list) -> None:
        """What several consumers read is computed once, unless that is a mere scan; it is released at the end of the run."""
        for own in logs:
            for df in plugins.tables_of(own):
                if worth_holding(df):
                    self.held.append(df.persist(StorageLevel.MEMORY_AND_DISK))

    def _build(self, s: Segment, kind: str, attributes: dict, streams: list, senders: list[str], consumed: bool = False) -> Any:
        sinks = [lambda own, n=n: self.streams.__setitem__(n, own) for n in senders]
        if kind == "stream" and s.name in ("Split", "Duplicator") and not sinks:
            sinks = [lambda own: None]
        try:
            return plugins.build(s.name, kind, lambda d: d.bind(self.spark, attributes, self._inputs(s), streams, sinks, consumed))
        except StreamError as e:
            raise FlowError(str(e)) from e if "no such" in str(e) else StreamError(f"{s.name}: {e}")
