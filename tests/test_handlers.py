"""Handlers, buffers and artifacts."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from traceloom import errors
from traceloom.model import Attribute, Meta
from traceloom.operators.buffer import Buffer, find, find_all
from traceloom.operators.eventlog import Statistics
from traceloom.operators.extensions import Concept
from traceloom.operators.handlers import Filter, Handler, by_component, in_order, observe_with


@pytest.fixture()
def log(spark):
    b = Buffer()
    for name, letters in (("x", "abc"), ("y", "ad"), ("z", "")):
        b.push_trace([Attribute("concept:name", name)], [[Attribute("concept:name", c)] for c in letters])
    b.push_event([Attribute("concept:name", "e")])
    assert len(b) == 4
    return b.drain(spark)


class Upper(Handler):
    def on_event(self, attributes, in_trace):
        name = F.element_at(attributes, "concept:name")
        return None, F.map_concat(F.map_filter(attributes, lambda k, v: k != "concept:name"), F.create_map(F.lit("concept:name"), name.withField("s", F.upper(name["s"]))))

    def on_meta(self, meta):
        return Meta(attributes={"seen": Attribute("seen", True)})


class Counter(Handler):
    def __init__(self):
        self.own = Observation()

    def observation(self):
        return self.own, [F.count("*").alias("n")]


def test_handlers(log):
    counter = Counter()
    out = observe_with(log, [Filter(traces=[[Concept.filter_in("concept:name", ["x", "z"])]]), Filter(events=[[Concept.filter_in("concept:name", ["b", "c", "e"])]]), Upper(), counter])
    out.components.write.format("noop").mode("overwrite").save()
    assert counter.own.get == {"n": 3} and out.sequence() == "[BC][]E" and out.meta.attributes["seen"].value is True


def test_python_handler(log):
    assert by_component(log, lambda f: f[f["kind"] == "event"]).sequence() == "e"


def test_every_second_event(log):
    rows = in_order(log).where("n % 2 = 0").orderBy("n").collect()
    assert [r.attributes["concept:name"].s for r in rows] == ["a", "c", "d"]


def test_buffer(spark, log):
    b = Buffer.of(log)
    assert b.drain(spark).sequence() == log.sequence() == "[abc][ad][]e" and len(b) == 0
    b.push_error(errors.StreamError("broken"))
    with pytest.raises(errors.StreamError):
        b.drain(spark)


def test_artifacts(log):
    own = log.artifact()
    assert find({"a": 1, "b": own}, Statistics) is own and find([1], str) is None and find_all([1, own, 2], int) == [1, 2]
