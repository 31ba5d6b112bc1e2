"""Operators of one's own over a nested log.

A Handler gives column expressions: what it returns for meta data, traces and events is chained over all handlers, all trace
steps before any event step. by_component runs Python functions for what columns can't express, a batch of components at a
time. in_order numbers all events for handlers whose state follows the whole log.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.conditions import CNF, Outcome, all_of, predicate
from ..model import COMPONENTS, Meta
from .eventlog import NestedLog


class Handler:
    """Does nothing; subclasses override what they need. A None column means no change or no test."""

    def on_meta(self, meta: Meta) -> Meta:
        return meta

    def on_trace(self, attributes: Column, events: Column) -> tuple[Column | None, Column | None]:
        """Whether a trace stays, and its attributes."""
        return None, None

    def on_event(self, attributes: Column, in_trace: bool) -> tuple[Column | None, Column | None]:
        """Whether an event stays, and its attributes."""
        return None, None

    def observation(self) -> tuple[Observation, list[Column]] | None:
        """Aggregates over components (seq, kind, attributes, events) as a side effect of the first action that reads the log.

        That action must read it once: a sort reads its input twice, to sample it first.
        """
        return None


class Filter(Handler):
    """One clause as a handler, for traces, events or both."""

    def __init__(self, traces: CNF | None = None, events: CNF | None = None):
        self.traces, self.events = traces, events

    def on_trace(self, attributes: Column, events: Column) -> tuple[Column | None, Column | None]:
        return (predicate(all_of(self.traces, NestedLog._trace_scope())) if self.traces else None), None

    def on_event(self, attributes: Column, in_trace: bool) -> tuple[Column | None, Column | None]:
        return (predicate(all_of(self.events, NestedLog._event_scope(attributes))) if self.events else None), None


def observe_with(log: NestedLog, handlers: list[Handler], checked: bool = True) -> NestedLog:
    """Applies handlers in order; with checked, a trace after an event is an error."""
    if checked:
        log = log.checked_order()
    meta, df, is_trace = log.meta, log.components, F.col("kind") == "trace"
    for h in handlers:
        meta = h.on_meta(meta)
    for h in handlers:
        keep, attributes = h.on_trace(F.col("attributes"), F.col("events"))
        if keep is not None:
            df = df.where(F.when(is_trace, predicate(Outcome(keep))).otherwise(True))
        if attributes is not None:
            df = df.withColumn("attributes", F.when(is_trace, attributes).otherwise(F.col("attributes")))
    for h in handlers:
        keep, attributes = h.on_event(F.col("attributes"), False)
        if keep is not None:
            df = df.where(F.when(is_trace, True).otherwise(keep)).withColumn("events", F.filter("events", _inside(h, 0)))
        if attributes is not None:
            df = df.withColumn("attributes", F.when(is_trace, F.col("attributes")).otherwise(attributes))
            df = df.withColumn("events", F.transform("events", _inside(h, 1)))
    for h in handlers:
        if (own := h.observation()) is not None:
            df = df.observe(own[0], *own[1])
    return replace(log, components=df, meta=meta)


def _inside(handler: Handler, which: int) -> Callable[[Column], Column]:
    """The handler's test (0) or change (1) of an event inside a trace."""

    def run(event: Column) -> Column:
        own = handler.on_event(event["attributes"], True)[which]
        return F.struct(own.alias("attributes")) if which else own

    return run


def by_component(log: NestedLog, f: Callable[[pd.DataFrame], pd.DataFrame]) -> NestedLog:
    """f gets and returns frames of components (seq, kind, attributes, events); rows that it leaves out are dropped."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield f(frame)

    return replace(log, components=log.components.mapInPandas(run, COMPONENTS))


def in_order(log: NestedLog) -> DataFrame:
    """All events with n, their number in the log's order from 0, place in their component, and seq.

    Components fall into ranges of seq of about equal size, whose events are counted; the ranges' sums (one row for each) give
    each range its first number, and events are numbered inside their range, so no task sees all of them.
    """
    n = int(log.components.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(log.components.approxQuantile("seq", [i / n for i in range(1, n)], 1 / (4 * n)))) if n > 1 else []
    part = F.size(F.filter(F.array(*[F.lit(int(c)) for c in cuts]), lambda c: c < F.col("seq"))) if cuts else F.lit(0)
    size = F.when(F.col("kind") == "trace", F.size("events")).otherwise(1)
    sums = log.components.groupBy(part.alias("part_of")).agg(F.sum(size).alias("size"))
    base = sums.select("part_of", (F.sum("size").over(Window.orderBy("part_of")) - F.col("size")).alias("base"))
    inside = log.components.where("kind = 'trace'").select("seq", F.posexplode("events").alias("place", "e")).select("seq", "place", F.col("e.attributes").alias("attributes"))
    alone = log.components.where("kind = 'event'").select("seq", F.lit(0).alias("place"), "attributes")
    rows = inside.unionByName(alone).withColumn("part", part)
    # base has a row for each shuffle partition.
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("seq", "place")) - 1).join(F.broadcast(base), F.col("part") == F.col("part_of"))
    return rows.select("seq", "place", "attributes", (F.col("base") + F.col("k")).alias("n"))
