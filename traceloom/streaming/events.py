"""Structured Streaming over events: the stateless operators are the batch ones, since a FlatLog's events may be a stream.

Traces are not defined on unbounded input; with_sessions offers them by a watermark and a gap, as an extension of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..errors import StateError
from ..functions.conditions import CNF
from ..operators.eventlog import FlatLog


def event_stream(events: DataFrame, order: list[str], event_map: dict[str, tuple[str, str]], meta=None) -> FlatLog:
    """A log without traces over a streaming (or any) table of events; filter, validate, split and sample work on it."""
    out = FlatLog(events, None, order, event_map)
    return out if meta is None else replace(out, meta=meta)


def filtered(log: FlatLog, events: CNF) -> DataFrame:
    return log.filter(events=events).events


def running_counts(log: FlatLog, key: str) -> DataFrame:
    """key and n, for output mode update or complete."""
    return log.events.groupBy(key).agg(F.count("*").alias("n"))


def tee(*writes: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that hands each batch to all of writes, computed once."""

    def run(batch: DataFrame, epoch: int) -> None:
        held = batch.persist()
        try:
            for write in writes:
                write(held, epoch)
        finally:
            held.unpersist()

    return run


def order_checked(components: DataFrame, log_id: str = "log_id") -> DataFrame:
    """Components (log_id, seq, kind) passed through; a trace after an event of the same log fails the query."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else False
        whole = pd.concat(list(frames)).sort_values("seq")
        for kind in whole["kind"]:
            if kind == "event":
                seen = True
            elif seen:
                raise StateError(f"StateError: invalid transition in log {key[0]}")
        state.update((seen,))
        yield whole[[log_id, "seq", "kind"]]

    return components.select(log_id, "seq", "kind").groupBy(log_id).applyInPandasWithState(run, components.select(log_id, "seq", "kind").schema, "seen boolean", "append", GroupStateTimeout.NoTimeout)


def with_sessions(log: FlatLog, case: str, time: str, gap: str, late: str) -> DataFrame:
    """case, session and n_events of traces closed by a gap, once the watermark has passed."""
    return log.events.withWatermark(time, late).groupBy(case, F.session_window(time, gap).alias("session")).agg(F.count("*").alias("n_events"))
