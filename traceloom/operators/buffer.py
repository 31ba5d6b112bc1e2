"""A small log in the driver's memory: filled component by component, replayed as a log; and typed lookup of artifacts."""

from __future__ import annotations

from collections import deque
from typing import Any

from pyspark.sql import SparkSession

from ..model import COMPONENTS, Attribute, Meta
from .eventlog import NestedLog


class Buffer:
    """First in, first out. Holds meta data, components and at most one error, which ends what can be replayed."""

    def __init__(self) -> None:
        self.meta = Meta()
        self.rows: deque = deque()
        self.error: Exception | None = None

    def push_meta(self, meta: Meta) -> None:
        self.meta = meta

    def push_event(self, attributes: list[Attribute]) -> None:
        self.rows.append(("event", {a.key: a.to_row() for a in attributes}, None))

    def push_trace(self, attributes: list[Attribute], events: list[list[Attribute]]) -> None:
        self.rows.append(("trace", {a.key: a.to_row() for a in attributes}, [({a.key: a.to_row() for a in e},) for e in events]))

    def push_error(self, error: Exception) -> None:
        self.error = error

    def __len__(self) -> int:
        return len(self.rows)

    @classmethod
    def of(cls, log: NestedLog) -> Buffer:
        """All components of a log, in order."""
        out = cls()
        out.meta = log.meta
        for r in log.components.orderBy("seq").toLocalIterator():
            out.rows.append((r.kind, r.attributes, r.events))
        return out

    def drain(self, spark: SparkSession) -> NestedLog:
        """What was pushed, as a log; the buffer is empty afterwards. A pushed error is raised."""
        if self.error is not None:
            error, self.error = self.error, None
            raise error
        rows = [(i, *r) for i, r in enumerate(self.rows)]
        self.rows.clear()
        return NestedLog(spark.createDataFrame(rows, COMPONENTS), self.meta)


def find(artifacts: dict[str, Any] | list, kind: type) -> Any:
    """The first artifact of a kind, or None."""
    return next(iter(find_all(artifacts, kind)), None)


def find_all(artifacts: dict[str, Any] | list, kind: type) -> list:
    return [a for a in (artifacts.values() if isinstance(artifacts, dict) else artifacts) if isinstance(a, kind)]
