"""The concept, organizational and time extensions: views, predicates and validators; and their registry."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import ExtensionError, KeyMissingError
from ..functions.conditions import Condition, Outcome, ScopeView, Typed, failing, first_error
from ..model import ExtensionDecl


def _by_view(view: Callable[[ScopeView], dict[str, Typed]], key: str, test: Callable[[Column], Column]) -> Condition:
    """A test of one field of a view; the view's errors and the field's absence are errors."""

    def run(scope: ScopeView) -> Outcome:
        fields = view(scope)
        own = fields.get(key)
        if own is None:
            return Outcome(F.lit(False), failing(KeyMissingError, f"{key} not found"))
        errors = [f.error for f in fields.values()]
        missing = F.when(own.value.isNull(), failing(KeyMissingError, f"{key} not found"))
        return Outcome(test(own.value), first_error(*errors, missing))

    return run


class _Strings:
    """An extension whose view is a set of optional strings."""

    NAME: str
    PREFIX: str
    URI: str
    KEYS: dict[str, tuple[str, ...]]

    @classmethod
    def view(cls, scope: ScopeView) -> dict[str, Typed]:
        return {k: scope.optional(k, "string") for k in cls.KEYS.get(scope.kind, ())}

    @classmethod
    def declare(cls) -> ExtensionDecl:
        return ExtensionDecl(cls.NAME, cls.PREFIX, cls.URI)

    @classmethod
    def validator(cls, scope: ScopeView) -> Column | None:
        fields = cls.view(scope)
        return first_error(*(f.error for f in fields.values())) if fields else None

    @classmethod
    def filter_eq(cls, key: str, value: str) -> Condition:
        return cls._plain(key, lambda c: c == value)

    @classmethod
    def filter_in(cls, key: str, values: list[str]) -> Condition:
        return cls._plain(key, lambda c: c.isin(list(values)))

    @classmethod
    def filter_match(cls, key: str, pattern: str) -> Condition:
        """The pattern is looked for anywhere in the value."""
        return cls._plain(key, lambda c: c.rlike(pattern))

    @classmethod
    def _plain(cls, key: str, test: Callable[[Column], Column]) -> Condition:
        return _by_view(cls.view, key, test)


class Concept(_Strings):
    NAME, PREFIX, URI = "Concept", "concept", "http://www.xes-standard.org/concept.xesext"
    NAME_KEY, INSTANCE_KEY = "concept:name", "concept:instance"
    KEYS = {"event": (NAME_KEY, INSTANCE_KEY), "trace": (NAME_KEY,), "log": (NAME_KEY,)}


class Org(_Strings):
    NAME, PREFIX, URI = "Organizational", "org", "http://www.xes-standard.org/org.xesext"
    RESOURCE_KEY, ROLE_KEY, GROUP_KEY = "org:resource", "org:role", "org:group"
    KEYS = {"event": (RESOURCE_KEY, ROLE_KEY, GROUP_KEY)}


def attribute(key: str, kind: str, test: Callable[[Column], Column]) -> Condition:
    """A test of any attribute by type, for keys that no extension covers; absence or another type is an error."""

    def run(scope: ScopeView) -> Outcome:
        own = scope.required(key, kind)
        return Outcome(test(own.value), own.error)

    return run


@dataclass(frozen=True)
class Interval:
    """A span of time; a timestamp alone is one whose ends are equal."""

    start: datetime
    end: datetime

    @classmethod
    def at(cls, t: datetime) -> Interval:
        return cls(t, t)

    def duration(self) -> timedelta:
        return abs(self.end - self.start)


class Time:
    NAME, PREFIX, URI = "Time", "time", "http://www.xes-standard.org/time.xesext"
    KEY = "time:timestamp"

    @classmethod
    def declare(cls) -> ExtensionDecl:
        return ExtensionDecl(cls.NAME, cls.PREFIX, cls.URI)

    @classmethod
    def view(cls, scope: ScopeView) -> tuple[Column, Column, Column]:
        """Start, end and error. A trace spans its first and its last event in order; those between don't matter."""
        if scope.kind == "event":
            own = scope.required(cls.KEY, "date")
            return own.value, own.value, own.error
        if scope.kind != "trace" or scope.first is None:
            none = F.lit(None).cast("timestamp")
            return none, none, failing(ExtensionError, "time extension is not defined here")
        s, e = scope.first, scope.last
        error = first_error(F.when(scope.size == 0, failing(ExtensionError, "no interval found")), s.error, e.error, F.when(s.value > e.value, failing(ExtensionError, "invalid interval")))
        return s.value, e.value, error

    @classmethod
    def _condition(cls, other: Interval, test: Callable[[Column, Column, Column, Column], Column]) -> Condition:
        def run(scope: ScopeView) -> Outcome:
            s, e, error = cls.view(scope)
            # A constant without offset has the column's own kind, so that the comparison is pushed down.
            bounds = [F.lit(t) if t.tzinfo else F.to_timestamp_ntz(F.lit(t.isoformat(sep=" "))) for t in (other.start, other.end)]
            return Outcome(test(s, e, *bounds), error)

        return run

    @classmethod
    def filter_eq(cls, other: Interval) -> Condition:
        return cls._condition(other, lambda s, e, a, b: (s == a) & (e == b))

    @classmethod
    def filter_eq_tol(cls, other: Interval, tolerance: timedelta) -> Condition:
        most = int(tolerance / timedelta(microseconds=1))

        def near(x: Column, y: Column) -> Column:
            return F.abs(F.unix_micros(x.cast("timestamp")) - F.unix_micros(y.cast("timestamp"))) <= most

        return cls._condition(other, lambda s, e, a, b: near(s, a) & near(e, b))

    @classmethod
    def filter_before(cls, other: Interval) -> Condition:
        return cls._condition(other, lambda s, e, a, b: e < a)

    @classmethod
    def filter_after(cls, other: Interval) -> Condition:
        return cls._condition(other, lambda s, e, a, b: b < s)

    @classmethod
    def filter_in(cls, other: Interval) -> Condition:
        return cls._condition(other, lambda s, e, a, b: (a <= s) & (e <= b))

    @classmethod
    def filter_starts_in(cls, other: Interval) -> Condition:
        return cls._condition(other, lambda s, e, a, b: (a <= s) & (s <= b))

    @classmethod
    def filter_ends_in(cls, other: Interval) -> Condition:
        return cls._condition(other, lambda s, e, a, b: (a <= e) & (e <= b))

    @classmethod
    def validator(cls, scope: ScopeView) -> Column | None:
        """None: the order of a trace's events is the log's own check, since it needs neighbours."""
        return None


#: Known extensions by prefix; validators of declared ones run in EventLog.validate.
REGISTRY: dict[str, type] = {c.PREFIX: c for c in (Concept, Org, Time)}


def register(extension: type) -> None:
    REGISTRY[extension.PREFIX] = extension


def remove(prefix: str) -> type | None:
    return REGISTRY.pop(prefix, None)
