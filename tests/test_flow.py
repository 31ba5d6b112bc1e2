"""Flows: configuration, planning errors, artifacts; plugins; channels; streaming; XML string types."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from traceloom import errors
from traceloom.functions.conditions import drop_err
from traceloom.functions.xmltypes import CLASSES, in_class, is_valid, letters_in, matches, parse_bool
from traceloom.operators.extensions import Concept, Org
from traceloom.plans import catalogue, plugins
from traceloom.plans.channels import ChannelNames
from traceloom.plans.flow import FlowGraph, Pipe, Segment, ThreadExecutor, toposort
from traceloom.plans.plugins import Declaration
from traceloom.sources.xes import read_xes
from traceloom.streaming import events as streaming

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")

YAML = """
generation: 0
artifacts: {}
staging: ~
pipes:
  - name: Only
    source: {name: XesReader, attributes: {path: {String: in.xes}}}
    streams:
      - name: Sample
        attributes: {ratio: {Float: 0.5}, seed: {Int: 0}}
      - {name: Statistics, artifact_sender: [stats]}
    sink: {name: XesWriter, attributes: {path: {String: out.xes}, indent: {Int: 1}}}
"""


def test_builder_json_and_yaml_are_equal():
    g = FlowGraph().source("Only", Segment("XesReader").attribute("path", "in.xes")).stream(Segment("Sample").attribute("ratio", 0.5).attribute("seed", 0))
    g.stream(Segment("Statistics").emit_artifact("stats")).sink(Segment("XesWriter").attribute("path", "out.xes").attribute("indent", 1))
    assert g.to_dict() == FlowGraph.from_yaml(YAML).to_dict() == FlowGraph.from_json(g.to_json()).to_dict()


def test_wiring_mistakes_are_found_before_running(spark):
    with pytest.raises(errors.FlowError):
        FlowGraph().stream(Segment("Sample"))
    with pytest.raises(errors.FlowError):
        FlowGraph().source("a", Segment("Receiver").acquire_stream("x")).execute(spark)
    with pytest.raises(errors.FlowError, match="no such plugin"):
        FlowGraph().source("a", Segment("Nothing")).execute(spark)
    with pytest.raises(errors.FlowError, match="stored"):
        FlowGraph().source("a", Segment("VoidStream").acquire_artifact("x")).execute(spark)
    loop = FlowGraph([Pipe(n, Segment("Receiver").acquire_stream(a), [Segment("Duplicator").emit_stream(b)]) for n, a, b in (("p", "x", "y"), ("q", "y", "x"))])
    with pytest.raises(errors.FlowError, match="wait"):
        loop.plan()
    twice = FlowGraph([Pipe(n, Segment("VoidStream"), [Segment("Statistics").emit_artifact("s")]) for n in "ab"])
    with pytest.raises(errors.ChannelError):
        twice.plan()


@needs_data
@pytest.mark.parametrize("executor", [None, ThreadExecutor()])
def test_train_and_test(spark, executor):
    graph = catalogue.train_test_flow(SF)
    got = graph.execute(spark, executor)
    counts = {n: got[n].counts() for n in ("raw", "sample", "train", "test")}
    assert [a + b for a, b in zip(counts["train"], counts["test"], strict=True)] == counts["sample"]
    stages = dict(graph.stages)
    assert [n for n, _ in stages["Train"]] == ["TableReader", "Repair", "Statistics", "Sample", "Statistics", "Split", "Statistics"] and [len(a) for _, a in stages["Train"]] == [0, 0, 1, 0, 1, 0, 1]
    assert graph.timings["Test"].keys() == {"acquisition", "execution", "emission"} and spark.sparkContext._jsc.getPersistentRDDs().size() == 0
    assert counts["raw"][0] == 1500 and graph.generation == 1 and not graph.pipes and len(got["__PIPES_GEN_0__"]) == 2


@needs_data
def test_flow_over_files(spark, tmp_path):
    src = FlowGraph().source("w", Segment("TableReader").attribute("folder", SF).attribute("log", "conversations")).sink(Segment("XesWriter").attribute("path", str(tmp_path / "a.xes")))
    src.execute(spark)
    g = FlowGraph().source("r", Segment("XesReader").attribute("path", str(tmp_path / "a.xes"))).stream(Segment("Duplicator").emit_stream("copy"))
    g.sink(Segment("XesWriter").attribute("path", str(tmp_path / "b.xes"))).source("c", Segment("Receiver").acquire_stream("copy")).stream(Segment("Statistics").emit_artifact("n"))
    n = g.execute(spark)["n"].counts()
    assert tuple(read_xes(spark, str(tmp_path / "b.xes")).statistics().first())[:3] == tuple(n)
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0


@needs_data
def test_counts_are_taken_in_passing(spark, tmp_path):
    """One pipe reads each of its tables once, whatever statistics it leaves; empty logs have counts too."""
    graph = catalogue.train_test_flow(SF)
    before = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)
    got = graph.execute(spark)
    after = spark.sparkContext._jsc.sc().statusTracker().getJobIdsForGroup(None)
    # Two tables' schemas, and one for each pipe.
    assert len(after) - len(before) == 4 and got["raw"].to_json()["artifact"]["ct_event"] == got["raw"].total
    none = spark.read.parquet(f"{SF}/orders.parquet").limit(0)
    (tmp_path / "t").mkdir()
    none.write.parquet(str(tmp_path / "t/orders.parquet"))
    spark.read.parquet(f"{SF}/lineitem.parquet").limit(0).write.parquet(str(tmp_path / "t/lineitem.parquet"))
    assert catalogue.train_test_flow(str(tmp_path / "t")).execute(spark)["test"].counts() == [0, 0, 0]


def test_channels():
    c = ChannelNames()
    with pytest.raises(errors.ChannelError):
        c.acquire_sender("x")
    c.owner = 1
    c.acquire_sender("x")
    with pytest.raises(errors.ChannelError, match="already"):
        c.acquire_sender("x")
    with pytest.raises(errors.ChannelError):
        c.dependencies()
    c.owner = 2
    c.acquire_receiver("x")
    assert c.dependencies() == {(2, 1)}


def test_toposort():
    assert toposort({(1, 2), (2, 3)}, [1, 2, 3]) == [3, 2, 1]
    with pytest.raises(errors.FlowError):
        toposort({(1, 2), (2, 1)}, [1, 2])


def test_plugin_binding(spark):
    d = Declaration(["a", "b"], {"b": lambda: 7}, ["x"], ["s"])
    p = d.bind(attributes={"a": 1, "c": 2}, artifacts=["p", "q"], streams=["t"])
    assert (p.attribute("a"), p.attribute("b"), p.artifact("x"), p.stream("s")) == (1, 7, "p", "t")
    assert p.artifacts_anon == ["q"]
    with pytest.warns(UserWarning, match="unused"):
        p.warn_unused()
    with pytest.raises(errors.StreamError):
        p.attribute("a")
    with pytest.raises(errors.StreamError):
        d.bind(attributes={}, artifacts=["p"], streams=["t"])
    with pytest.raises(errors.StreamError):
        d.bind(attributes={"a": 1}, streams=["t"])
    names = {r.name for r in plugins.list_plugins(spark).collect()}
    assert names >= {"VoidStream", "VoidSink", "Duplicator", "Statistics", "Validator", "Repair", "Split", "Sample", "Sender", "Receiver", "XesReader", "XesWriter"}


@pytest.mark.parametrize("kind, good, bad", [
    ("token", ["", "a", "a b", "a\u00a0b", "a\x1cb"], [" a", "a ", "a  b", "a\tb"]), ("Name", ["a", ":a", "_x-1.2", "é"], ["", "1a", "a b", "-a"]),
    ("NCName", ["a", "_x-1", "é中", "a\u0301"], ["", "a:b", "1a", "a b", "a\u00aa", "\u0301a", "a\uff21"]), ("anyURI", ["http://x", "see a:b"], ["", "abc", "1:"]),
])
def test_xml_strings(kind, good, bad):
    assert all(is_valid(kind, x) for x in good) and not any(is_valid(kind, x) for x in bad)


@pytest.mark.parametrize("name, inside, outside", [
    ("BaseChar", "Aéא가", "1中·_"), ("Ideographic", "中〇", "aあ"), ("CombiningChar", "\u0301\u05b0", "a"), ("Digit", "07٣", "a²"), ("Extender", "·々ー", "-a"), ("Letter", "a中", "1·"),
])
def test_letter_classes(name, inside, outside):
    assert all(in_class(name, x) for x in inside) and not any(in_class(name, x) for x in outside)


def test_letters_in_columns(spark):
    """Counts of each class are those of in_class, over every character of the basic plane and some beyond."""
    every = [chr(p) for p in (*range(0xD800), *range(0xE000, 0x10000), 0x10000, 0x1D7CE, 0x20000, 0x10FFFF)]
    given = [None, "", "A\u0300\u0660\u00b7\u3007", "acei0 \0\n", *("".join(every[i::97]) * 2 for i in range(97)), "".join(every)]
    df = spark.createDataFrame(list(enumerate(given)), "i int, text string").select("i", *[letters_in(k, F.col("text")).alias(k) for k in CLASSES])
    inside = {k: {x for x in every if in_class(k, x)} for k in CLASSES}
    want = [(i, *(None if t is None else sum(x in inside[k] for x in t) for k in CLASSES)) for i, t in enumerate(given)]
    assert sorted(map(tuple, df.collect())) == want and {t for _, t in df.dtypes} == {"int"}


def test_string_types_are_the_same_in_columns(spark):
    given = ["", "a", "a b", " a", "a\u00a0b", "a\x1cb", "a:b", "é中", "a\u00aa", "1", "_"]
    df = spark.createDataFrame([(x,) for x in given], "v string")
    for kind in ("token", "Name", "NCName", "anyURI"):
        assert [r[1] for r in df.select("v", matches(kind, F.col("v"))).collect()] == [is_valid(kind, x) for x in given], kind


def test_parse_bool():
    assert parse_bool("1") and not parse_bool("false")
    with pytest.raises(errors.ParseBooleanError):
        parse_bool("t")


@needs_data
def test_streaming_equals_batch(spark, tmp_path):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    event_map = {"concept:name": ("string", "event_type"), "time:timestamp": ("date", "ts")}
    cnf = [[Concept.filter_in("concept:name", ["view", "click"])], [drop_err(Org.filter_eq("org:role", "x")), Concept.filter_eq("concept:name", "view")]]
    log = streaming.event_stream(stream, ["ts", "event_id"], event_map)
    held = []
    q = streaming.filtered(log, cnf).writeStream.foreachBatch(streaming.tee(lambda df, _: held.append(df.count()), lambda df, _: held.append(df.count()))).option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert held[0] == held[1] == batch.where("event_type = 'view'").count() > 0


def test_streaming_order(spark, tmp_path):
    for name, kinds in (("good", ["trace", "event"]), ("bad", ["event", "trace"])):
        spark.createDataFrame([("l", i, k) for i, k in enumerate(kinds)], "log_id string, seq long, kind string").coalesce(1).write.parquet(str(tmp_path / name))
        stream = spark.readStream.schema("log_id string, seq long, kind string").parquet(str(tmp_path / name))
        q = streaming.order_checked(stream).writeStream.format("memory").queryName(f"order_{name}").option("checkpointLocation", str(tmp_path / f"{name}-c")).start()
        if name == "bad":
            with pytest.raises(Exception, match="invalid transition"):
                q.processAllAvailable()
        else:
            q.processAllAvailable()
            assert spark.table("order_good").count() == 2
        q.stop()
