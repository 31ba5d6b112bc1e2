"""Event logs in two layouts with the same operators.

FlatLog: one row for each event with typed columns, plus a table of traces that keeps empty ones; built from tables, and
what scales: predicates without errors reach the scan, only order- and trace-level operators shuffle, by case.
NestedLog: one row for each component in order, a trace with its events as an array; what files are read to and written
from, and what carries attributes of any name and type.
"""

from __future__ import annotations

import contextlib
import json
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from ..errors import AttributeTypeError, KeyMissingError, StateError, ValidationError, tagged
from ..functions.coin import coin
from ..functions.conditions import CNF, ColumnAttributes, MapAttributes, Outcome, ScopeView, Typed, all_of, failing, first_error, predicate
from ..functions.xmltypes import is_valid
from ..model import ATTR, ATTRIBUTES, FIELDS, Attribute, Meta, Scope
from .extensions import REGISTRY, Time

ATTR_TYPES = {f.name: f.dataType.simpleString() for f in ATTR}
#: First number of events outside traces in a nested log made from tables: after all traces.
ALONE = 1 << 61
#: Attributes inside an attribute, as they are held.
CHILDREN = "array<struct<key:string,type:string,value:string>>"


class Statistics:
    """What a collector leaves: counts, and the traces' lengths in order, which are fetched only if asked for."""

    def __init__(self, lengths: Callable[[], list[int]], traces: int, in_trace: int, total: int):
        self._lengths, self.traces, self.in_trace, self.total = lengths, traces, in_trace, total

    def counts(self) -> list[int]:
        return [self.traces, self.in_trace, self.total]

    def to_json(self) -> dict:
        return {"artifact": {"__type": "Statistics", "ct_trace": self._lengths(), "ct_event": self.total}}

    def __str__(self) -> str:
        return f"traces: {self.traces}\nevents: {self.in_trace}\nstandalone events: {self.total - self.in_trace}"


def worth_holding(df: DataFrame) -> bool:
    """Whether computing df again costs more than a scan with filters: then several readers should share it."""

    def costly(plan) -> bool:
        children = plan.children()
        return plan.nodeName() not in ("Project", "Filter", "CollectMetrics", "Range", "LocalRelation", "LogicalRelation") and not plan.nodeName().startswith("Relation") or any(costly(children.apply(i)) for i in range(children.size()))

    return df.storageLevel == StorageLevel.NONE and costly(df._jdf.queryExecution().optimizedPlan())


class _Log:
    meta: Meta

    def tables(self) -> list[DataFrame]:
        raise NotImplementedError

    @contextlib.contextmanager
    def held(self) -> Iterator[_Log]:
        """The log with its tables persisted inside the block, where they are worth it; all is released at its end."""
        held = [df.persist(StorageLevel.MEMORY_AND_DISK) for df in self.tables() if worth_holding(df)]
        try:
            yield self
        finally:
            for df in held:
                df.unpersist()

    def duplicate(self) -> tuple:
        """Two logs over one plan: inside one query Spark computes what they share once; across queries, hold the log with held()."""
        return self, replace(self)

    def repair(self):
        """Removes spaces from classifier names that are no NCName."""
        fixed = [replace(c, name=c.name if is_valid("NCName", c.name) else c.name.replace(" ", "")) for c in self.meta.classifiers]
        return replace(self, meta=replace(self.meta, classifiers=fixed))

    def declared(self) -> list[type]:
        out = []
        for e in self.meta.extensions:
            if e.prefix in REGISTRY:
                out.append(REGISTRY[e.prefix])
            else:
                warnings.warn(f"extension {e.name} ({e.prefix}) is unknown and not validated", stacklevel=3)
        return out

    def check_meta(self) -> None:
        for c in self.meta.classifiers:
            if not is_valid("NCName", c.name):
                raise ValidationError(f"classifier name {c.name!r} is no valid xs:NCName")

    def _component_error(self, scope: ScopeView, at: Scope) -> Column:
        """Error text of a component against globals and declared extensions; null if there is none."""
        errors = [F.lit(None).cast("string")]
        for g in self.meta.globals_of(at):
            kind = scope.attributes.type_of(g.key)
            errors.append(F.when(kind.isNull(), F.lit(tagged(ValidationError, f"{g.key} not found"))).when(kind != g.type, F.concat(F.lit(tagged(ValidationError, f"{g.key} expected {g.type}, got ")), kind)))
        for e in self.declared():
            own = e.validator(scope)
            if own is not None:
                errors.append(F.when(own.isNotNull(), F.concat(F.lit(f"{ValidationError.__name__}: "), F.regexp_replace(own, r"^\w+: ", ""))))
        return F.coalesce(*errors)


@dataclass
class _Origin:
    """What a filtered log came from: all events and traces before it, with what keeps them; so that aggregates by case need no
    second look at either."""

    events: DataFrame
    traces: DataFrame | None
    test: Column | None = None
    keep: Column | None = None


@dataclass
class FlatLog(_Log):
    """events: rows with the case column (null for events outside traces); traces: one row for each trace, or None.

    event_map and trace_map give attribute keys (type, column name); children gives, for a key of an event, the attributes
    that lie inside it, by key again.
    """

    events: DataFrame
    case: str | None
    order: list[str]
    event_map: dict[str, tuple[str, str]]
    traces: DataFrame | None = None
    trace_map: dict[str, tuple[str, str]] = field(default_factory=dict)
    meta: Meta = field(default_factory=Meta)
    children: dict[str, dict[str, tuple[str, str]]] = field(default_factory=dict)
    #: Not carried over by replace: a log that is changed has no origin.
    _origin: _Origin | None = field(default=None, init=False, repr=False, compare=False)

    def tables(self) -> list[DataFrame]:
        return [self.events] + ([self.traces] if self.traces is not None else [])

    def _event_scope(self) -> ScopeView:
        return ScopeView("event", ColumnAttributes({k: (t, F.col(c)) for k, (t, c) in self.event_map.items()}))

    def trace_rows(self) -> DataFrame:
        """The traces, or the cases that occur among the events."""
        if self.traces is not None:
            return self.traces
        return self.events.where(F.col(self.case).isNotNull()).select(self.case).distinct()

    def with_ends(self, *more: Column) -> DataFrame:
        """The traces with n_events_, first_ and last_ (timestamps of the first and last event in order) and what more aggregates.

        The events are read once; without a table of traces they give the cases too.
        """
        return self._grouped(self.events, self.traces, *more)

    def _grouped(self, events: DataFrame, traces: DataFrame | None, *more: Column) -> DataFrame:
        column = self.event_map.get(Time.KEY, ("date", None))[1]
        value = F.col(column) if column else F.lit(None).cast("timestamp")
        at = F.struct(*self.order)
        by = events.where(F.col(self.case).isNotNull()).groupBy(F.col(self.case).alias("case__"))
        ends = by.agg(F.count("*").alias("n_events_"), F.min_by(value, at).alias("first_"), F.max_by(value, at).alias("last_"), *more)
        if traces is None:
            return ends.withColumnRenamed("case__", self.case)
        return traces.join(ends, F.col(self.case) == F.col("case__"), "left").drop("case__").withColumn("n_events_", F.coalesce("n_events_", F.lit(0)))

    def _by_case(self, of: Callable[[Column], Column], name: str) -> DataFrame:
        """The log's traces with an aggregate over the events that it keeps, from one reading of the events.

        of gets a condition and returns the aggregate over the events for which it holds.
        """
        origin = self._origin or _Origin(self.events, self.traces)
        rows = self._grouped(origin.events, origin.traces, of(F.lit(True) if origin.keep is None else origin.keep).alias(name))
        return rows if origin.test is None else rows.where(origin.test)

    def _trace_scope(self) -> ScopeView:
        kind = self.event_map.get(Time.KEY, ("missing", None))[0]

        def end(name: str) -> Typed:
            c = F.col(name)
            return Typed(c, F.when(c.isNull(), failing(KeyMissingError, f"{Time.KEY} not found")).when(F.lit(kind != "date"), failing(AttributeTypeError, f"{Time.KEY} is no date")))

        return ScopeView("trace", ColumnAttributes({k: (t, F.col(c)) for k, (t, c) in self.trace_map.items()}), F.col("n_events_"), end("first_"), end("last_"))

    def filter(self, traces: CNF = (), events: CNF = ()) -> FlatLog:
        """Traces for which every clause of traces holds, with those of their events (and of events outside traces) for which
        every clause of events does. Trace conditions see all events; a trace that loses its events stays."""
        out, origin = self, self._origin
        if traces:
            test = predicate(all_of(list(traces), self._trace_scope()))
            kept = self.with_ends().where(test).drop("n_events_", "first_", "last_")
            own = self.events.join(kept.select(F.col(self.case).alias("case__")), F.col(self.case) == F.col("case__"), "left_semi")
            outside = self.events.where(F.col(self.case).isNull())
            out = replace(out, traces=kept, events=own.unionByName(outside))
            origin = _Origin(self.events, self.traces, test)
        if events:
            keep = predicate(all_of(list(events), out._event_scope()))
            origin = origin or _Origin(out.events, out.traces)
            origin = replace(origin, keep=keep if origin.keep is None else F.when(origin.keep, keep).otherwise(False))
            if out.case is not None and out.traces is None:
                out = replace(out, traces=out.trace_rows())
            out = replace(out, events=out.events.where(keep))
        if out is not self and out.case is not None:
            out._origin = origin
        return out

    def _order_error(self, before: Column, several: Column) -> Column | None:
        """Error of an event of a trace against the one before it: of a trace of two or more, all need a date and none comes early."""
        if self.case is None or not any(e is Time for e in self.declared()):
            return None
        kind, column = self.event_map.get(Time.KEY, (None, None))
        several = F.col(self.case).isNotNull() & several
        if kind is None:
            return F.when(several, F.lit(tagged(ValidationError, f"{Time.KEY} not found")))
        if kind != "date":
            return F.when(several, F.lit(tagged(ValidationError, f"{Time.KEY} is no date")))
        late = F.lit(tagged(ValidationError, "children of trace are not chronological"))
        return F.when(several & F.col(column).isNull(), F.lit(tagged(ValidationError, f"{Time.KEY} not found"))).when(several & (before > F.col(column)), late)

    def _judged(self) -> DataFrame:
        """Events with error_, what contradicts the log's declarations; events outside traces have no order among them."""
        own = self._component_error(self._event_scope(), Scope.EVENT)
        events = self.events
        if self._order_error(F.lit(None), F.lit(False)) is not None:
            # Events outside traces are spread over all tasks, each a group of its own.
            groups = [F.col(self.case), F.when(F.col(self.case).isNull(), F.xxhash64(*self.order))]
            column = self.event_map.get(Time.KEY, (None, None))[1]
            w = Window.partitionBy(*groups).orderBy(*self.order)
            several = F.lag(F.lit(True)).over(w).isNotNull() | F.lead(F.lit(True)).over(w).isNotNull()
            events = events.withColumns({"before_": F.lag(column).over(w) if column else F.lit(None), "several_": several})
            own = F.coalesce(self._order_error(F.col("before_"), F.col("several_")), own)
        return events.withColumn("error_", own).drop("before_", "several_")

    def validate(self) -> FlatLog:
        """The log unchanged; an event or trace that contradicts what is declared raises when it is read."""
        self.check_meta()
        events = self._judged().where(predicate(Outcome(F.lit(True), F.col("error_")))).drop("error_")
        traces = self.traces
        if traces is not None:
            traces = traces.where(predicate(Outcome(F.lit(True), self._component_error(self._trace_scope(), Scope.TRACE))))
        return replace(self, events=events, traces=traces)

    def violations(self) -> DataFrame:
        """Events that contradict what is declared, with error; nothing is raised."""
        return self._judged().withColumnRenamed("error_", "error").where(F.col("error").isNotNull())

    def inversions(self, order: list[str]) -> DataFrame:
        """Events whose timestamp is before that of the event before them in the given order of their case."""
        ts = F.col(self.event_map[Time.KEY][1])
        return self.events.withColumn("before_", F.lag(ts).over(Window.partitionBy(self.case).orderBy(*order))).where(F.col("before_") > ts)

    def statistics(self) -> DataFrame:
        """One row: traces, in_trace, total and standalone events."""
        inside = F.count(F.when(F.col(self.case).isNotNull(), 1)) if self.case else F.lit(0).cast("long")
        events = self.events.agg(inside.alias("in_trace"), F.count("*").alias("total"))
        # Both sides are one row.
        n = self.trace_rows().agg(F.count("*").alias("traces")) if self.case else self.events.sparkSession.range(1).select(F.lit(0).cast("long").alias("traces"))
        return n.join(F.broadcast(events)).select("traces", "in_trace", "total", (F.col("total") - F.col("in_trace")).alias("standalone"))

    def lengths(self) -> DataFrame:
        """case and n_events of every trace, empty ones too."""
        rows = self._by_case(lambda keep: F.count(F.when(keep, 1)), "n_kept_")
        return rows.select(self.case, F.coalesce("n_kept_", F.lit(0)).alias("n_events"))

    def durations(self) -> DataFrame:
        """case and duration_us of every trace, from its first to its last event in order; null without events or dates."""
        us = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_", "last_")]
        return self.with_ends().select(self.case, F.abs(us[1] - us[0]).alias("duration_us"))

    def inside(self, key: str, attributes: dict[str, tuple[str, str]]) -> FlatLog:
        """The log with attributes (type, column name) inside an event's attribute."""
        return replace(self, children=self.children | {key: self.children.get(key, {}) | attributes})

    def observed(self, observations: list[Observation]) -> FlatLog | None:
        """The log with its counts taken as a side effect of whatever reads its tables, one observation each; None if the cases
        are only known from the events, since those can't be counted in passing. counts_of reads the observations."""
        if self.case is not None and self.traces is None:
            return None
        inside = F.count(F.when(F.col(self.case).isNotNull(), 1)) if self.case else F.lit(0).cast("long") * F.count("*")
        events = self.events.observe(observations[0], inside.alias("in_trace"), F.count("*").alias("total"))
        traces = self.traces.observe(observations[1], F.count("*").alias("traces")) if self.traces is not None else None
        return replace(self, events=events, traces=traces)

    def counts_of(self, observations: list[Observation]) -> Statistics:
        n = observations[0].get
        return Statistics(self._lengths, observations[1].get["traces"] if self.traces is not None else 0, n["in_trace"], n["total"])

    def _lengths(self) -> list[int]:
        return [r.n_events for r in self.lengths().orderBy(self.case).toLocalIterator()] if self.case is not None else []

    def artifact(self) -> Statistics:
        r = self.statistics().first()
        return Statistics(self._lengths, r.traces, r.in_trace, r.total)

    def sequences(self, token: Column) -> DataFrame:
        """case and sequence: the tokens of a trace's events in order, joined; '' for an empty trace."""
        own = F.struct(*self.order, token.cast("string").alias("token__"))
        rows = self._by_case(lambda keep: F.array_sort(F.collect_list(F.when(keep, own))), "tokens_")
        text = F.array_join(F.transform("tokens_", lambda x: x["token__"]), "")
        return rows.select(self.case, F.coalesce(text, F.lit("")).alias("sequence"))

    def _by_coin(self, test: Callable[[Column], Column], seed: int) -> FlatLog:
        key = F.col(self.case) if self.case is not None else F.concat_ws("|", *self.order)
        if self.case is not None and not self.events.schema[self.case].nullable:
            own = key
        else:
            own = F.coalesce(key.cast("string"), F.concat_ws("|", *self.order))
        return replace(self, events=self.events.where(test(coin(seed, own))), traces=None if self.traces is None else self.traces.where(test(coin(seed, F.col(self.case)))))

    def split(self, ratio: float, seed: int) -> tuple[FlatLog, FlatLog]:
        """(train, test): traces and events outside traces go whole, by a coin of their own; both keep the meta data."""
        return self._by_coin(lambda u: u <= ratio, seed), self._by_coin(lambda u: u > ratio, seed)

    def sample(self, ratio: float, seed: int) -> FlatLog:
        return self._by_coin(lambda u: u <= ratio, seed)

    def map_events(self, f: Callable[[DataFrame], DataFrame]) -> FlatLog:
        """A handler of one's own on the events."""
        return replace(self, events=f(self.events))

    def attribute_types(self) -> DataFrame:
        """key, type and n: how often each attribute occurs among the events."""
        # One pass over the columns, then a row for each key.
        counts = self.events.agg(*[F.count(c).alias(f"c{i}") for i, (_, c) in enumerate(self.event_map.values())])
        rows = F.array(*[F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.col(f"c{i}").alias("n")) for i, (k, (t, _)) in enumerate(self.event_map.items())])
        return counts.select(F.explode(rows).alias("x")).select("x.*").where("n > 0")

    def nested(self) -> NestedLog:
        """The same log in the nested layout: traces numbered by case, then events outside traces in their order.

        Numbers are the cases themselves where those are integers from 0 on; others are numbered by a sort over all executors.
        """
        kind = ATTRIBUTES.simpleString()

        def attr(kind: str, c: Column, inside: dict[str, tuple[str, str]]) -> Column:
            own = {name: F.lit(None).cast(t) for name, t in ATTR_TYPES.items()} | {"type": F.lit(kind), FIELDS[kind]: c.cast(ATTR_TYPES[FIELDS[kind]])}
            if kind == "date":
                own["off"] = F.lit(0)
            if inside:
                given = F.array(*[F.when(F.col(x).isNotNull(), F.to_json(F.struct(F.lit(k).alias("key"), F.lit(t).alias("type"), F.col(x).alias("value")))) for k, (t, x) in inside.items()])
                given = F.filter(given, lambda x: x.isNotNull())
                own["children"] = F.when(F.size(given) > 0, F.concat(F.lit("["), F.array_join(given, ","), F.lit("]")))
            return F.struct(*[own[name].alias(name) for name in ATTR_TYPES])

        def attributes(columns: dict[str, tuple[str, str]], children: dict[str, dict[str, tuple[str, str]]]) -> Column:
            pairs = [F.struct(F.lit(k).alias("key"), F.when(F.col(c).isNotNull(), attr(t, F.col(c), children.get(k, {}))).alias("value")) for k, (t, c) in columns.items()]
            return F.map_from_entries(F.filter(F.array(*pairs), lambda p: p["value"].isNotNull())) if pairs else F.create_map().cast(kind)

        def in_order(df: DataFrame, keys: list[str], base: int) -> DataFrame:
            n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("seq_", F.lit(base) + F.monotonically_increasing_id())

        of_event = attributes(self.event_map, self.children)
        alone = self.events if self.case is None else self.events.where(F.col(self.case).isNull())
        events = F.lit(None).cast(f"array<struct<attributes:{kind}>>")
        alone = in_order(alone, self.order, ALONE).select(F.col("seq_").alias("seq"), F.lit("event").alias("kind"), of_event.alias("attributes"), events.alias("events"))
        if self.case is None:
            return NestedLog(alone, self.meta)
        own = self.events.where(F.col(self.case).isNotNull()).groupBy(F.col(self.case).alias("case__")).agg(F.array_sort(F.collect_list(F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(self.order)], F.to_json(of_event).alias("a")))).alias("e"))
        rows, whole = self.trace_rows(), isinstance(self.events.schema[self.case].dataType, IntegralType)
        rows = rows.withColumn("seq_", F.col(self.case).cast("long")) if whole else in_order(rows, [self.case], 0)
        traces = rows.join(own, F.col(self.case) == F.col("case__"), "left")
        inner = F.transform("e", lambda x: F.struct(F.from_json(x["a"], kind).alias("attributes")))
        traces = traces.select(F.col("seq_").alias("seq"), F.lit("trace").alias("kind"), attributes(self.trace_map, {}).alias("attributes"), F.coalesce(inner, F.array().cast(f"array<struct<attributes:{kind}>>")).alias("events"))
        return NestedLog(traces.unionByName(alone), self.meta)


@dataclass
class NestedLog(_Log):
    """components: seq, kind ('trace' or 'event'), attributes (map of typed values) and events (null for an event)."""

    components: DataFrame
    meta: Meta = field(default_factory=Meta)

    def tables(self) -> list[DataFrame]:
        return [self.components]

    @staticmethod
    def _event_scope(attributes: Column) -> ScopeView:
        return ScopeView("event", MapAttributes(attributes))

    @staticmethod
    def _trace_scope() -> ScopeView:
        def end(at: int) -> Typed:
            own = ScopeView("event", MapAttributes(F.try_element_at(F.col("events"), F.lit(at))["attributes"])).required(Time.KEY, "date")
            return own

        return ScopeView("trace", MapAttributes(F.col("attributes")), F.size("events"), end(1), end(-1))

    def filter(self, traces: CNF = (), events: CNF = ()) -> NestedLog:
        df = self.components
        is_trace = F.col("kind") == "trace"
        if traces:
            df = df.where(F.when(is_trace, predicate(all_of(list(traces), self._trace_scope()))).otherwise(True))
        if events:
            df = df.where(F.when(is_trace, True).otherwise(predicate(all_of(list(events), self._event_scope(F.col("attributes"))))))
            df = df.withColumn("events", F.filter("events", lambda e: predicate(all_of(list(events), self._event_scope(e["attributes"])))))
        return replace(self, components=df)

    def validate(self) -> NestedLog:
        self.check_meta()
        chain = [self._component_error(self._trace_scope(), Scope.TRACE)]
        if any(e is Time for e in self.declared()):
            chain.append(self._order_error())
        def event_error(e):
            return self._component_error(self._event_scope(e), Scope.EVENT)
        inner = F.filter(F.transform("events", lambda e: event_error(e["attributes"])), lambda x: x.isNotNull())
        chain.append(F.try_element_at(inner, F.lit(1)))
        error = F.when(F.col("kind") == "trace", F.coalesce(*chain)).otherwise(event_error(F.col("attributes")))
        return replace(self, components=self.components.where(predicate(Outcome(F.lit(True), error))))

    def _order_error(self) -> Column:
        """Of neighbours in a trace the second must not be before the first; with fewer than two events nothing is looked at."""
        n = F.size("events")
        stamps = F.transform("events", lambda e: F.struct(self._event_scope(e["attributes"]).required(Time.KEY, "date").value.alias("t"), self._event_scope(e["attributes"]).required(Time.KEY, "date").error.alias("e")))
        wrong = F.filter(stamps, lambda x: x["e"].isNotNull())
        late = F.exists(F.sequence(F.lit(1), n - 1), lambda i: F.element_at(stamps, (i + 1).cast("int"))["t"] < F.element_at(stamps, i.cast("int"))["t"])
        text = F.concat(F.lit(f"{ValidationError.__name__}: "), F.regexp_replace(F.try_element_at(wrong, F.lit(1))["e"], r"^\w+: ", ""))
        return F.when(n >= 2, F.coalesce(text, F.when(late, F.lit(tagged(ValidationError, "children of trace are not chronological")))))

    def checked_order(self) -> NestedLog:
        """Raises if a trace comes after an event; the order is total, so one task looks at kinds and numbers alone."""
        if not order_violations(self.components).isEmpty():
            raise StateError("invalid transition: a trace after an event")
        return self

    def statistics(self) -> DataFrame:
        n = F.when(F.col("kind") == "trace", F.size("events"))
        agg = self.components.agg(F.count(n).alias("traces"), F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("in_trace"), F.count(F.when(F.col("kind") == "event", 1)).alias("standalone"))
        return agg.select("traces", "in_trace", (F.col("in_trace") + F.col("standalone")).alias("total"), "standalone")

    def observed(self, observations: list[Observation]) -> NestedLog:
        """Counts traces, in_trace and standalone as a side effect of whatever action reads the log; counts_of reads them."""
        n = F.when(F.col("kind") == "trace", F.size("events"))
        return replace(self, components=self.components.observe(observations[0], F.count(n).alias("traces"), F.coalesce(F.sum(n), F.lit(0)).alias("in_trace"), F.count(F.when(F.col("kind") == "event", 1)).alias("standalone")))

    def counts_of(self, observations: list[Observation]) -> Statistics:
        n = observations[0].get
        return Statistics(self._lengths, n["traces"], n["in_trace"], n["in_trace"] + n["standalone"])

    def _lengths(self) -> list[int]:
        rows = self.components.where("kind = 'trace'").select("seq", F.size("events").alias("n")).orderBy("seq")
        return [r.n for r in rows.toLocalIterator()]

    def artifact(self) -> Statistics:
        r = self.statistics().first()
        return Statistics(self._lengths, r.traces, r.in_trace, r.total)

    def sequences(self, token: Callable[[Column], Column]) -> DataFrame:
        """seq and sequence of each component: '[abc]' for a trace, the token alone for an event outside traces."""
        inner = F.array_join(F.transform("events", lambda e: token(e["attributes"])), "")
        return self.components.select("seq", F.when(F.col("kind") == "trace", F.concat(F.lit("["), inner, F.lit("]"))).otherwise(token(F.col("attributes"))).alias("sequence"))

    def sequence(self, key: str = "concept:name") -> str:
        """All components in order as one text, on the driver; for small logs."""
        rows = self.sequences(lambda a: F.coalesce(F.element_at(a, key)["s"], F.lit("?"))).orderBy("seq").collect()
        return "".join(r.sequence for r in rows)

    def split(self, ratio: float, seed: int) -> tuple[NestedLog, NestedLog]:
        u = coin(seed, F.col("seq"))
        return replace(self, components=self.components.where(u <= ratio)), replace(self, components=self.components.where(u > ratio))

    def sample(self, ratio: float, seed: int) -> NestedLog:
        return self.split(ratio, seed)[0]

    def map_components(self, f: Callable[[DataFrame], DataFrame]) -> NestedLog:
        return replace(self, components=f(self.components))

    def with_attribute(self, attribute: Attribute) -> NestedLog:
        """Sets an attribute of every component; the last value of a key wins."""
        row = self.components.sparkSession.createDataFrame([(attribute.to_row(),)], "a struct<type:string,s:string,ts:timestamp,off:int,i:bigint,f:double,b:boolean,list:string,children:string>")
        without = F.map_filter("attributes", lambda k, v: k != attribute.key)
        return replace(self, components=self.components.join(F.broadcast(row)).withColumn("attributes", F.map_concat(without, F.create_map(F.lit(attribute.key), F.col("a")))).drop("a"))

    def without_attribute(self, key: str) -> NestedLog:
        return replace(self, components=self.components.withColumn("attributes", F.map_filter("attributes", lambda k, v: k != key)))

    @staticmethod
    def children(attributes: Column, key: str) -> Column:
        """The attributes inside an attribute (key, type, value as text); null if it has none or isn't there."""
        return F.from_json(F.try_element_at(attributes, F.lit(key))["children"], CHILDREN)

    @staticmethod
    def children_or(attributes: Column, key: str) -> Column:
        """As children; an attribute that isn't there is an error, one without children has none."""
        own = F.coalesce(NestedLog.children(attributes, key), F.array().cast(CHILDREN))
        return F.when(F.try_element_at(attributes, F.lit(key)).isNull(), F.raise_error(F.lit(tagged(KeyMissingError, f"{key} not found"))).cast(CHILDREN)).otherwise(own)

    @staticmethod
    def value_or(attributes: Column, key: str, kind: str) -> Column:
        """An attribute's value; one that isn't there or is of another type is an error."""
        own = ScopeView("event", MapAttributes(attributes)).required(key, kind)
        return F.when(own.error.isNotNull(), F.raise_error(own.error).cast(ATTR_TYPES[FIELDS[kind]])).otherwise(own.value)

    @staticmethod
    def child(attributes: Column, key: str, child: str) -> Column:
        """Text of a nested attribute's value."""
        return F.try_element_at(F.filter(NestedLog.children(attributes, key), lambda c: c["key"] == child), F.lit(1))["value"]

    def with_child(self, key: str, attribute: Attribute) -> NestedLog:
        """Sets an attribute inside the attribute key of every component that has it; the last value of a key wins."""
        kept = F.filter(F.from_json("a_.children", "array<string>"), lambda c: F.get_json_object(c, "$.key") != attribute.key)
        made = F.concat(F.lit("["), F.array_join(F.concat(F.coalesce(kept, F.array().cast("array<string>")), F.array(F.lit(json.dumps(attribute.to_json())))), ","), F.lit("]"))
        own = self.components.withColumn("a_", F.try_element_at("attributes", F.lit(key)))
        changed = F.map_concat(F.map_filter("attributes", lambda k, v: k != key), F.create_map(F.lit(key), F.col("a_").withField("children", made)))
        return replace(self, components=own.withColumn("attributes", F.when(F.col("a_").isNull(), F.col("attributes")).otherwise(changed)).drop("a_"))

    def collect(self) -> tuple[Meta, list, list]:
        """Meta data, traces and events on the driver."""
        rows = self.components.orderBy("seq").collect()
        return self.meta, [r for r in rows if r.kind == "trace"], [r for r in rows if r.kind == "event"]


def order_violations(components: DataFrame) -> DataFrame:
    """Components (seq, kind) that are no event but come after one: after the first of all events, which is one number."""
    first = components.where("kind = 'event'").agg(F.min("seq").alias("first_"))
    return components.select("seq", "kind").join(F.broadcast(first)).where("kind <> 'event' and seq > first_").drop("first_")


def classifier_column(log: FlatLog, keys: str) -> Column:
    """Values of a classifier's keys joined by '+'."""
    known = sorted(log.event_map, key=len, reverse=True)
    found = re.findall("|".join(map(re.escape, known)), keys)
    return F.concat_ws("+", *[F.col(log.event_map[k][1]).cast("string") for k in found])
