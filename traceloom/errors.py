"""Failures by kind. Errors raised inside a Spark expression carry their kind as a prefix and are mapped back by `mapped`."""

from __future__ import annotations

import contextlib
import re
from collections.abc import Iterator


class EventFlowError(Exception):
    """Base of all failures of this library."""


class StateError(EventFlowError):
    """A component in a place where it must not be."""


class StreamError(EventFlowError):
    """A stream or its configuration can't be used."""


class ValidationError(EventFlowError):
    """A component contradicts what the log declares."""


class KeyMissingError(EventFlowError):
    """A required key is absent."""


class XmlError(EventFlowError):
    """XML that can't be written or read."""


class ParseBooleanError(EventFlowError):
    """No boolean literal."""


class ParseIntError(EventFlowError):
    """No integer literal of 64 bits."""


class ParseFloatError(EventFlowError):
    """No floating-point literal."""


class Utf8Error(EventFlowError):
    """Bytes that are no UTF-8."""


class ParseDateTimeError(EventFlowError):
    """No date with time and offset."""


class XesError(EventFlowError):
    """A document that is no XES."""


class ChannelError(EventFlowError):
    """A channel end that is missing or taken."""


class ExtensionError(EventFlowError):
    """An extension's view doesn't apply."""


class AttributeTypeError(EventFlowError):
    """An attribute of another type than asked for."""


class ArtifactError(EventFlowError):
    """An artifact that is missing or of another type."""


class FlowError(EventFlowError):
    """A flow graph that can't run."""


KINDS = {c.__name__: c for c in EventFlowError.__subclasses__()}


def tagged(kind: type[EventFlowError], text: str) -> str:
    return f"{kind.__name__}: {text}"


def of_message(text: str) -> EventFlowError | None:
    m = re.search(rf"\b({'|'.join(KINDS)}): ([^\n]*)", text)
    return KINDS[m[1]](m[2].strip()) if m else None


@contextlib.contextmanager
def mapped() -> Iterator[None]:
    """Turns a Spark failure raised by one of our expressions or readers into the error it stands for."""
    try:
        yield
    except EventFlowError:
        raise
    except Exception as e:
        own = of_message(str(e))
        if own is None:
            raise
        raise own from e
