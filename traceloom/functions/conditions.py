"""Conditions with three outcomes (true, false, error) as pairs of columns, and their folding to one predicate.

A condition is built from a scope: the attributes of an event or a trace, and of a trace its first and last timestamp.
Where a condition can't fail its error is None, and a filter made of such conditions is a plain predicate that Catalyst
pushes down; otherwise value and error end in one CASE, so that no optimiser step reorders or prunes the error.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import AttributeTypeError, EventFlowError, KeyMissingError, tagged
from ..model import FIELDS


@dataclass
class Outcome:
    """value (null counts as false) and error text (null: none; None: can't fail)."""

    value: Column
    error: Column | None = None

    @property
    def message(self) -> Column:
        return F.lit(None).cast("string") if self.error is None else self.error


@dataclass
class Typed:
    """Value of an attribute asked for by type, and the error of asking."""

    value: Column
    error: Column


class MapAttributes:
    """Attributes held as map<string, ATTR>."""

    def __init__(self, column: Column):
        self.column = column

    def parts(self, key: str, kind: str) -> tuple[Column, Column, Column]:
        """Whether the key is present, whether its type is kind, and its value."""
        a = F.element_at(self.column, key)
        return a.isNotNull(), a["type"] == kind, a[FIELDS[kind]]

    def type_of(self, key: str) -> Column:
        return F.element_at(self.column, key)["type"]


class ColumnAttributes:
    """Attributes held as plain columns: key -> (type, column); null is absence."""

    def __init__(self, columns: dict[str, tuple[str, Column]]):
        self.columns = columns

    def parts(self, key: str, kind: str) -> tuple[Column, Column, Column]:
        if key not in self.columns:
            return F.lit(False), F.lit(False), F.lit(None)
        own, column = self.columns[key]
        return column.isNotNull(), F.lit(own == kind), column

    def type_of(self, key: str) -> Column:
        if key not in self.columns:
            return F.lit(None).cast("string")
        return F.when(self.columns[key][1].isNotNull(), F.lit(self.columns[key][0]))


@dataclass
class ScopeView:
    """What a condition sees: kind ('event', 'trace' or 'log'), attributes, and for a trace its ends (see Time)."""

    kind: str
    attributes: MapAttributes | ColumnAttributes
    size: Column | None = None
    first: Typed | None = None
    last: Typed | None = None

    def required(self, key: str, kind: str) -> Typed:
        present, ok, value = self.attributes.parts(key, kind)
        return Typed(value, F.when(~present, F.lit(tagged(KeyMissingError, f"{key} not found"))).when(~ok, F.lit(tagged(AttributeTypeError, f"{key} is no {kind}"))))

    def optional(self, key: str, kind: str) -> Typed:
        present, ok, value = self.attributes.parts(key, kind)
        return Typed(value, F.when(present & ~ok, F.lit(tagged(AttributeTypeError, f"{key} is no {kind}"))))


Condition = Callable[[ScopeView], Outcome]
CNF = list[list[Condition]]


def first_error(*errors: Column) -> Column:
    return F.coalesce(*errors) if len(errors) > 1 else errors[0]


def failing(kind: type[EventFlowError], text: str) -> Column:
    return F.lit(tagged(kind, text))


def constant(value: bool) -> Condition:
    return lambda scope: Outcome(F.lit(value))


def neg(condition: Condition) -> Condition:
    """Not; an error stays one."""

    def run(scope: ScopeView) -> Outcome:
        own = condition(scope)
        return Outcome(~F.coalesce(own.value, F.lit(False)), own.error)

    return run


def drop_err(condition: Condition) -> Condition:
    """An error counts as false."""

    def run(scope: ScopeView) -> Outcome:
        own = condition(scope)
        return Outcome(own.value & own.message.isNull())

    return run


def any_of(clause: list[Condition], scope: ScopeView) -> Outcome:
    """From left to right: the first true decides, an error before it wins; an empty clause is false."""
    value, error = F.lit(False), None
    for own in (c(scope) for c in reversed(clause)):
        if own.error is None and error is None:
            value = own.value | value
            continue
        rest = F.lit(None).cast("string") if error is None else error
        error = F.when(own.message.isNotNull(), own.message).when(own.value, F.lit(None).cast("string")).otherwise(rest)
        value = F.when(own.value, True).otherwise(value)
    return Outcome(value, error)


def all_of(cnf: CNF, scope: ScopeView) -> Outcome:
    """Clauses from left to right: a false one hides errors of later ones; no clause at all is true."""
    value, error = F.lit(True), None
    for own in (any_of(c, scope) for c in reversed(cnf)):
        if own.error is None and error is None:
            value = own.value & value
            continue
        rest = F.lit(None).cast("string") if error is None else error
        error = F.when(own.message.isNotNull(), own.message).when(own.value, rest)
        value = F.when(own.value, value).otherwise(False)
    return Outcome(value, error)


def predicate(outcome: Outcome) -> Column:
    """True or false, or a raised error, in one expression."""
    if outcome.error is None:
        return outcome.value
    return F.when(outcome.error.isNotNull(), F.raise_error(outcome.error).cast("boolean")).otherwise(F.coalesce(outcome.value, F.lit(False)))
