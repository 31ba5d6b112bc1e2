"""Sinks of one's own: objects that are told when a log opens, of its components in order, and how it ends."""

from __future__ import annotations

import queue
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import Row
from pyspark.sql import functions as F

from ..errors import ChannelError, EventFlowError, mapped, of_message
from ..model import Meta
from .eventlog import NestedLog


class Sink:
    """Does nothing; subclasses override what they need."""

    def on_open(self, meta: Meta) -> None:
        pass

    def on_component(self, component: Row) -> None:
        """A component (seq, kind, attributes, events)."""

    def on_close(self) -> None:
        pass

    def on_error(self, error: Exception) -> None:
        """After an error the sink is not closed and leaves no artifacts."""

    def artifacts(self) -> list:
        return []


def consume(log: NestedLog, sink: Sink, stages: Callable[[], list[list]] = list) -> list[list]:
    """Opens the sink, hands it all components in order, one partition at a time on the driver, and closes it.

    Returns the artifacts of the stages before it and its own. A defect of the log, also one that a permissive reader gives as
    a component of kind error, goes to on_error and ends the run.
    """
    sink.on_open(log.meta)
    try:
        with mapped():
            for component in log.components.orderBy("seq").toLocalIterator():
                if component.kind == "error":
                    text = component.attributes["_error"].s
                    raise of_message(text) or EventFlowError(text)
                sink.on_component(component)
    except EventFlowError as e:
        sink.on_error(e)
        return []
    sink.on_close()
    return [*stages(), sink.artifacts()]


def consume_partitions(log: NestedLog, make: Callable[[], Sink]) -> None:
    """As consume, with a sink for each partition on the executors, where no order over the whole log is needed."""
    meta = log.meta

    def run(rows: Iterator[Row]) -> None:
        sink = make()
        sink.on_open(meta)
        for r in rows:
            sink.on_component(r)
        sink.on_close()

    log.components.where(F.col("kind") != "error").foreachPartition(run)


class Channel:
    """What a sink at one end is told, an iterator at the other gives; for a sink and a reader in two threads of the driver.

    Without a bound the sender never waits; with one it waits while as many components lie in the channel.
    """

    END = object()

    def __init__(self, bound: int | None = None):
        if bound is not None and bound < 1:
            raise ChannelError("a channel holds one component at least")
        self.items: queue.Queue = queue.Queue(bound or 0)

    def sender(self) -> Sink:
        return _Sender(self)

    def __iter__(self) -> Iterator[Any]:
        """Meta data, then components; an error of the sender's log is raised here."""
        while (item := self.items.get()) is not self.END:
            if isinstance(item, Exception):
                raise item
            yield item


class _Sender(Sink):
    def __init__(self, channel: Channel):
        self.channel = channel

    def on_open(self, meta: Meta) -> None:
        self.channel.items.put(meta)

    def on_component(self, component: Row) -> None:
        self.channel.items.put(component)

    def on_close(self) -> None:
        self.channel.items.put(Channel.END)

    def on_error(self, error: Exception) -> None:
        self.channel.items.put(error)
