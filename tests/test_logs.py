"""Nested logs: golden sequences, validation, order, routing, on a small document of our own."""

from __future__ import annotations

import threading
from dataclasses import replace
from datetime import datetime, timedelta, timezone
from xml.etree import ElementTree

import pytest
from pyspark.sql import functions as F

from traceloom import errors
from traceloom.functions.conditions import constant, drop_err, neg
from traceloom.model import ATTR, Attribute, Meta
from traceloom.operators import extensions
from traceloom.operators.eventlog import worth_holding
from traceloom.operators.extensions import Concept, Interval, Org, Time
from traceloom.operators.sinks import Channel, Sink, consume, consume_partitions
from traceloom.sources import xes
from traceloom.sources.tables import from_table
from traceloom.sources.xes import from_text, meta_to_json, parse, read_xes, rendered, write_folder, write_source, write_xes

N = Concept.NAME_KEY
HEAD = '<?xml version="1.0"?><log xes.version="1849.2016" xes.features="">'


def document(traces: dict[str, str], extra: str = "", day: int = 1) -> str:
    """One trace for each name, an event for each letter, a minute apart and a day for each trace."""
    out = [HEAD, '<extension name="Concept" prefix="concept" uri="http://x/concept.xesext"/><extension name="Time" prefix="time" uri="http://x/time.xesext"/>', extra]
    for i, (name, letters) in enumerate(traces.items()):
        events = "".join(f'<event><string key="concept:name" value="{c}"/><date key="time:timestamp" value="2020-01-{day + i:02d}T10:{j:02d}:00Z"/></event>' for j, c in enumerate(letters))
        out.append(f'<trace><string key="concept:name" value="{name}"/>{events}</trace>')
    return "".join([*out, "</log>"])


L = document({"north 1": "aed", "south 1": "acbd", "north 2": "abcd", "south 2": "acbd"})


def at(day: int, minute: int = 0) -> datetime:
    return datetime(2020, 1, day, 10, minute, tzinfo=timezone.utc)


def test_concept_filters(spark):
    log = from_text(spark, L)
    assert log.sequence() == "[aed][acbd][abcd][acbd]"
    cnf = [[neg(Concept.filter_match(N, "[ae]"))], [Concept.filter_eq(N, "c"), Concept.filter_match(N, "^[d-z]$")]]
    assert log.filter(events=cnf).sequence() == "[d][cd][cd][cd]"
    assert log.filter(traces=[[Concept.filter_match(N, "^north")]]).sequence() == "[aed][abcd]"
    assert log.filter(traces=[[Concept.filter_match(N, "2$")], [neg(Concept.filter_in(N, ["south 1", "north 2"]))]], events=[[neg(Concept.filter_eq(N, "c"))]]).sequence() == "[abd]"


def test_empty_clause_and_cnf(spark):
    log = from_text(spark, L)
    assert log.filter(events=[[]]).sequence() == "[][][][]"
    assert log.filter(events=[], traces=[]).sequence() == log.sequence()
    assert log.filter(traces=[[]]).sequence() == ""
    assert log.filter(events=[[constant(True)]]).sequence() == log.sequence()


def test_errors_are_tri_state(spark):
    log = from_text(spark, L)
    missing = Org.filter_eq(Org.ROLE_KEY, "x")
    with errors.mapped(), pytest.raises(errors.KeyMissingError):
        try:
            log.filter(events=[[missing]]).sequence()
        except Exception as e:
            raise errors.of_message(str(e)) from e
    assert log.filter(events=[[drop_err(missing)]]).sequence() == "[][][][]"
    assert log.filter(events=[[constant(True), missing]]).sequence() == log.sequence()  # an earlier true one hides the error
    assert log.filter(events=[[constant(False)], [missing]]).sequence() == "[][][][]"  # an earlier false clause too
    with pytest.raises(Exception, match="KeyMissingError"):
        log.filter(events=[[missing, constant(True)]]).sequence()
    with pytest.raises(Exception, match="KeyMissingError"):
        log.filter(traces=[[Org.filter_eq(Org.ROLE_KEY, "x")]]).sequence()


def test_time_filters(spark):
    log = from_text(spark, L)
    run = lambda c, traces=False: (log.filter(traces=[[c]]) if traces else log.filter(events=[[c]])).sequence()
    assert run(Time.filter_eq(Interval.at(at(2, 1)))) == "[][c][][]"
    assert run(Time.filter_eq_tol(Interval.at(at(2, 1)), timedelta(seconds=60))) == "[][acb][][]"
    assert run(Time.filter_before(Interval(at(2, 1), at(2, 2)))) == "[aed][a][][]"
    assert run(Time.filter_after(Interval(at(2, 1), at(3, 2)))) == "[][][d][acbd]"
    assert run(Time.filter_in(Interval(at(2, 2), at(3, 0)))) == "[][bd][a][]"
    assert run(Time.filter_in(Interval(at(1), at(2, 3))), True) == "[aed][acbd]"
    assert run(Time.filter_starts_in(Interval(at(2), at(3))), True) == "[acbd][abcd]"
    assert run(Time.filter_ends_in(Interval(at(2), at(3))), True) == "[acbd]"
    assert run(Time.filter_before(Interval.at(at(3))), True) == "[aed][acbd]"
    assert run(Time.filter_eq(Interval(at(1), at(1, 2))), True) == "[aed]"
    assert Interval(at(2), at(1)).duration() == timedelta(days=1)


def test_time_of_empty_and_reversed_traces(spark):
    log = from_text(spark, document({"x": "", "y": "ab"}))
    with pytest.raises(Exception, match="no interval found"):
        log.filter(traces=[[Time.filter_in(Interval(at(1), at(9)))]]).sequence()
    assert log.filter(traces=[[drop_err(Time.filter_in(Interval(at(1), at(9))))]]).sequence() == "[ab]"
    late = HEAD + '<trace><event><date key="time:timestamp" value="2020-01-02T00:00:00Z"/></event><event><date key="time:timestamp" value="2020-01-01T00:00:00Z"/></event></trace></log>'
    with pytest.raises(Exception, match="invalid interval"):
        from_text(spark, late).filter(traces=[[Time.filter_in(Interval(at(1), at(9)))]]).sequence()


def test_validation(spark):
    globals_ = '<global scope="event"><string key="concept:name" value="?"/></global><global scope="trace"><string key="concept:name" value="?"/></global>'
    good = from_text(spark, document({"x": "ab"}, globals_))
    assert good.validate().sequence() == "[ab]"
    missing = from_text(spark, document({"x": "ab"}, '<global scope="event"><string key="org:role" value="?"/></global>'))
    with pytest.raises(Exception, match="ValidationError: org:role not found"):
        missing.validate().sequence()
    wrong = from_text(spark, document({"x": "ab"}, '<global scope="event"><int key="concept:name" value="1"/></global>'))
    with pytest.raises(Exception, match="expected int, got string"):
        wrong.validate().sequence()
    late = document({"x": "ab"}).replace("10:01:00Z", "09:01:00Z")
    with pytest.raises(Exception, match="not chronological"):
        from_text(spark, late).validate().sequence()


def test_repair_and_classifiers(spark):
    log = from_text(spark, document({"x": "a"}, '<classifier name="Event Name" keys="concept:name"/>'))
    with pytest.raises(errors.ValidationError):
        log.validate()
    assert log.repair().validate().meta.classifiers[0].name == "EventName"


def test_unknown_extension_warns(spark):
    log = from_text(spark, document({"x": "a"}, '<extension name="Cost" prefix="cost" uri="http://x/c"/>'))
    with pytest.warns(UserWarning, match="unknown"):
        log.validate()
    own = extensions.remove("org")
    assert own is Org and "org" not in extensions.REGISTRY
    extensions.register(Org)


def test_order(spark):
    good = from_text(spark, HEAD + "<trace/><event/></log>")
    assert good.checked_order() is good
    with pytest.raises(errors.StateError):
        from_text(spark, HEAD + "<event/><trace/></log>").checked_order()


def flat(spark, rows, case_type="string"):
    """A log of rows (case, n, name, time) in order of n."""
    df = spark.createDataFrame(rows, f"own {case_type}, n int, name string, at timestamp")
    return from_table(df, "own", ["n"], {N: ("string", "name"), "time:timestamp": ("date", "at")}, meta=Meta([Concept.declare(), Time.declare()]))


def test_flat_validation(spark):
    good = [("x", 1, "a", at(1)), ("x", 2, "b", at(2)), ("y", 1, "c", None), (None, 1, "d", at(9)), (None, 2, "e", at(3)), (None, 3, "f", None)]
    assert flat(spark, good).validate().events.count() == 6 and flat(spark, good).violations().count() == 0
    with pytest.raises(Exception, match="ValidationError: time:timestamp not found"):
        flat(spark, [*good, ("y", 2, "g", at(5))]).validate().events.collect()
    with pytest.raises(Exception, match="not chronological"):
        flat(spark, [*good, ("x", 3, "g", at(1, 5))]).validate().events.collect()
    undated = replace(flat(spark, good), event_map={N: ("string", "name")})
    assert [r.name for r in undated.violations().orderBy("name").collect()] == ["a", "b"]


@pytest.mark.parametrize("case_type", ["string", "long"])
def test_flat_logs_nest(spark, case_type):
    case = {"x": 1, "y": 2, None: None} if case_type == "long" else {"x": "x", "y": "y", None: None}
    rows = [("y", 1, "c", None), ("x", 2, "b", at(2)), ("x", 1, "a", at(1)), (None, 2, "e", at(3)), (None, 1, "d", at(9))]
    log = flat(spark, [(case[r[0]], *r[1:]) for r in rows], case_type)
    own = log.nested()
    assert own.sequence() == "[ab][c]de" and own.validate().statistics().first() == (2, 3, 5, 2)
    assert tuple(log.statistics().first()) == (2, 3, 5, 2)
    assert from_table(log.events, None, ["name"], log.event_map).nested().sequence() == "abcde"


def test_filtered_logs_are_read_once(spark, tmp_path):
    """Sequences and lengths after filters of traces and events come from one grouping, and are those of the filtered events."""
    flat(spark, [("x", 1, "a", at(1)), ("x", 2, "b", at(2)), ("y", 1, "c", at(3)), ("z", 1, "b", at(4))]).events.write.parquet(str(tmp_path / "t"))
    log = from_table(spark.read.parquet(str(tmp_path / "t")), "own", ["n"], {N: ("string", "name"), "time:timestamp": ("date", "at")})
    kept = log.filter(traces=[[Time.filter_before(Interval.at(at(4)))]], events=[[neg(Concept.filter_eq(N, "b"))]]).filter(events=[[neg(Concept.filter_eq(N, "c"))]])
    assert {tuple(r) for r in kept.sequences(F.col("name")).collect()} == {("x", "a"), ("y", "")}
    assert {tuple(r) for r in kept.lengths().collect()} == {("x", 1), ("y", 0)} and kept.events.count() == 1
    plan = kept.lengths()._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1
    again = kept.filter(traces=[[Time.filter_before(Interval.at(at(9)))]])
    with pytest.raises(Exception, match="no interval found"):
        again.lengths().collect()  # a trace condition sees the events that are left


def test_statistics_and_routing(spark):
    log = from_text(spark, L.replace("</log>", '<event><string key="concept:name" value="z"/></event></log>'))
    assert tuple(log.statistics().first()) == (4, 15, 16, 1)
    own = log.artifact()
    assert own.counts() == [4, 15, 16] and own.to_json() == {"artifact": {"__type": "Statistics", "ct_trace": [3, 4, 4, 4], "ct_event": 16}}
    train, test = log.split(0.5, 7)
    assert train.components.count() + test.components.count() == 5
    assert log.split(0.0, 7)[0].components.count() == 0 and log.split(1.0, 7)[1].components.count() == 0
    a, b = log.duplicate()
    assert a.sequence() == b.sequence() == log.sequence()


def persistent(spark) -> int:
    return spark.sparkContext._jsc.getPersistentRDDs().size()


def test_nothing_stays_persisted(spark, tmp_path):
    before = persistent(spark)
    (tmp_path / "a.xes").write_text(L)
    log = read_xes(spark, str(tmp_path / "a.xes"))
    a, b = log.duplicate()
    assert a.sequence() == b.sequence() and persistent(spark) == before
    with log.held() as own:
        assert own.components.is_cached and own.sequence() == log.sequence()
    assert persistent(spark) == before and not log.components.is_cached
    scan = spark.range(5).where("id > 2")
    assert worth_holding(scan.groupBy("id").count()) and not worth_holding(scan)


def test_attributes(spark):
    log = from_text(spark, HEAD + '<trace><string key="k" value="v"><string key="inner" value="w"/></string></trace></log>')
    changed = log.with_attribute(Attribute("x", 1)).with_attribute(Attribute("x", 2)).without_attribute("k")
    row = changed.components.first()
    assert set(row.attributes) == {"x"} and row.attributes["x"].i == 2
    df = log.components
    assert df.select(log.child(df.attributes, "k", "inner")).first()[0] == "w"
    assert df.select(log.value_or(df.attributes, "k", "string")).first()[0] == "v" and df.select(log.children(df.attributes, "none")).first()[0] is None
    for wrong in (log.value_or(df.attributes, "none", "string"), log.value_or(df.attributes, "k", "int"), log.children_or(df.attributes, "none")):
        with pytest.raises(Exception, match="KeyMissingError|AttributeTypeError"):
            df.select(wrong).collect()
    new = log.with_child("k", Attribute("inner", 5)).with_child("k", Attribute("more", "z")).with_child("none", Attribute("x", 1)).components
    assert [tuple(c) for c in new.select(log.children_or(new.attributes, "k")).first()[0]] == [("inner", "int", "5"), ("more", "string", "z")]
    meta, traces, events = log.collect()
    assert len(traces) == 1 and not events


ACCEPTED = {
    "empty log": "<log/>", "interleaved meta": HEAD + '<string key="a" value="1"/><extension name="C" prefix="c" uri="http://x"/></log>', "list": HEAD + '<list key="l"><values><string key="a" value="1"/></values><int key="i" value="2"/></list></log>',
    "trace after event": HEAD + "<event/><trace/></log>", "plus sign": HEAD + '<int key="i" value="+5"/><float key="f" value="1e5"/><boolean key="b" value="1"/></log>', "ignored": HEAD + "<trace><event><event/></event></trace></log>",
}
REJECTED = {
    "boolean": (HEAD + '<boolean key="b" value="TRUE"/></log>', errors.ParseBooleanError), "int": (HEAD + '<int key="i" value=" 5"/></log>', errors.ParseIntError), "large": (HEAD + '<int key="i" value="9223372036854775808"/></log>', errors.ParseIntError),
    "float": (HEAD + '<float key="f" value="1.0.0"/></log>', errors.ParseFloatError), "date": (HEAD + '<date key="d" value="2002-05-30T09:30:10"/></log>', errors.ParseDateTimeError), "no key": (HEAD + '<string value="x"/></log>', errors.KeyMissingError),
    "scope": (HEAD + '<global scope="log"/></log>', errors.XesError), "element": (HEAD + "<foo/></log>", errors.XesError), "syntax": (HEAD + "<trace></log>", errors.XesError), "no root": ("<trace/>", errors.XesError),
    "late meta": (HEAD + '<trace/><string key="a" value="1"/></log>', errors.StateError), "values": (HEAD + "<values/></log>", errors.StateError), "event in attribute": (HEAD + '<string key="a" value="1"><event/></string></log>', errors.XesError),
}


@pytest.mark.parametrize("name", ACCEPTED)
@pytest.mark.filterwarnings("ignore")
def test_accepted(name):
    assert list(parse(ACCEPTED[name]))


@pytest.mark.parametrize("name", REJECTED)
def test_rejected(name):
    text, kind = REJECTED[name]
    with pytest.raises(kind):
        list(parse(text))


def test_components_before_a_defect_come_first():
    got, it = [], parse(L[: len(L) - 40])
    with pytest.raises(errors.XesError):
        for own in it:
            got.append(own)
    assert len(got) >= 4


def test_data_source_round_trip(spark, tmp_path):
    text = document({"x": "ab", "y": ""}, '<global scope="event"><string key="concept:name" value="?"/></global><float key="f" value="1.50"/><date key="d" value="2020-01-01T01:02:03.5+02:00"/><list key="l"><values><string key="a" value="&lt;&amp;"/></values></list>')
    a, b, c = tmp_path / "a.xes", tmp_path / "b.xes", tmp_path / "c.xes"
    a.write_text(text)
    log = read_xes(spark, str(a))
    write_xes(log, str(b), 1)
    write_source(read_xes(spark, str(b)), str(c), 1)
    assert b.read_text() == c.read_text()
    assert 'value="1.5"' in b.read_text() and "2020-01-01T01:02:03.500+02:00" in b.read_text() and "&lt;&amp;" in b.read_text()
    assert read_xes(spark, str(c)).sequence() == "[ab][]"
    two = read_xes(spark, str(a), str(b))
    assert two.components.count() == 4 and two.meta == log.meta
    d = tmp_path / "d.xes"
    d.write_text(document({"z": "c"}, '<classifier name="K" keys="concept:name"/><string key="f" value="other"/><string key="s" value="t"/>'))
    both = read_xes(spark, str(a), str(d)).meta
    assert [c.name for c in both.classifiers] == ["K"] and len(both.globals) == 1 and len(both.extensions) == 2
    assert both.attributes["f"].value == 1.5 and both.attributes["s"].value == "t"


def test_folder_of_documents(spark, tmp_path):
    log = from_text(spark, L)
    for path in (f"{tmp_path}/x", f"file://{tmp_path}/y"):
        write_folder(log, path, 1)
        back = read_xes(spark, path)
        assert back.sequence() == log.sequence() and back.meta == log.meta
    assert len(list((tmp_path / "x").glob("*.xes"))) > 1 and not list((tmp_path / "x").glob(".*xes*"))
    write_source(log, f"file://{tmp_path}/one.xes")
    assert read_xes(spark, f"file://{tmp_path}/one.xes").sequence() == log.sequence()


ORDER = ["extension", "global", "classifier", "attribute", "trace", "event"]
INSIDE = {"trace": ["attribute", "event"], "event": ["attribute"], "global": ["attribute"], "values": ["attribute"]}
NEEDED = {"extension": {"name", "prefix", "uri"}, "classifier": {"name", "scope", "keys"}, "global": {"scope"}, "list": {"key"}, "log": {"xes.version", "xes.features"}}


def check_document(text: str) -> None:
    """A written document has the order, the nesting and the XML attributes of the standard's schema."""
    kind = lambda e: "attribute" if e.tag in xes.ATTRIBUTE_TAGS else e.tag

    def look(e: ElementTree.Element) -> None:
        own = NEEDED.get(e.tag, {"key", "value"} if kind(e) == "attribute" else set())
        assert set(e.attrib) == own, e.tag
        inside = [kind(x) for x in e]
        if e.tag == "list":
            assert inside[-1:] == ["values"] and set(inside[:-1]) <= {"attribute"}
        else:
            allowed = ORDER if e.tag == "log" else INSIDE.get(e.tag, ["attribute"] if kind(e) == "attribute" else [])
            assert set(inside) <= set(allowed) and [allowed.index(x) for x in inside] == sorted(allowed.index(x) for x in inside), e.tag
        for x in e:
            look(x)

    root = ElementTree.fromstring(text)
    assert root.tag == "log"
    look(root)


EVERY_TYPE = '<string key="s" value="a&quot;&lt;&#10;é"><int key="inside" value="3"/></string><date key="d" value="2020-02-29T23:59:59.123456789-03:30"/><int key="i" value="-9223372036854775808"/><float key="f" value="-1e-7"/><boolean key="b" value="0"/><id key="x" value="7d1"/><list key="l"><values><string key="a" value="1"/><list key="m"><values/></list></values></list>'
ROUND_TRIPS = {
    "types of a log": HEAD + EVERY_TYPE + "</log>", "types of an event": HEAD + f"<event>{EVERY_TYPE}</event></log>", "types of a trace": HEAD + f"<trace>{EVERY_TYPE}<event>{EVERY_TYPE}</event><event/></trace><event/></log>",
    "types of a global": HEAD + f'<global scope="trace">{EVERY_TYPE}</global></log>', "declarations": L.replace("<trace>", '<classifier name="A" scope="trace" keys="x y"/><global><id key="q" value=""/></global><trace>', 1), "no version": "<log><trace/></log>",
    "repeated key": HEAD + '<string key="k" value="1"/><string key="k" value="2"/></log>', "order of meta": HEAD + '<string key="z" value="1"/><classifier name="A" keys="k"/><extension name="C" prefix="c" uri="http://x"/></log>',
}


@pytest.mark.parametrize("name", ROUND_TRIPS)
def test_written_documents_read_back_the_same(name):
    """What is read from a written document is what was written, and it is written the same again."""

    def read(text: str) -> tuple[Meta, list]:
        own = list(parse(text))
        return own[0], [xes.as_row(i, x) for i, x in enumerate(own[1:])]

    def write(meta: Meta, rows: list, indent: int) -> str:
        attr = lambda a: {k: dict(zip(ATTR.names, v, strict=True)) for k, v in a.items()}
        return "".join(rendered(meta, iter([{"kind": k, "attributes": attr(a), "events": None if e is None else [{"attributes": attr(x[0])} for x in e]} for _, k, a, e in rows]), indent))

    meta, rows = read(ROUND_TRIPS[name])
    for indent in (0, 1):
        text = write(meta, rows, indent)
        check_document(text)
        again = read(text)
        assert meta_to_json(again[0]) == meta_to_json(replace(meta, attributes=dict(sorted(meta.attributes.items())))) and again[1] == rows
        assert write(*again, indent) == text


def test_sinks_and_channels(spark, tmp_path):
    class Count(Sink):
        def __init__(self):
            self.calls = [0, 0, 0, 0]

        def on_open(self, meta):
            self.calls[0] += 1

        def on_component(self, component):
            self.calls[1] += 1

        def on_close(self):
            self.calls[2] += 1

        def on_error(self, error):
            self.calls[3] += 1
            assert isinstance(error, errors.XesError)

        def artifacts(self):
            return [tuple(self.calls)]

    log, own = from_text(spark, L), Count()
    assert consume(log, own, lambda: [[], ["x"]]) == [[], ["x"], [(1, 4, 1, 0)]]
    broken = tmp_path / "broken.xes"
    broken.write_text(L[: len(L) - 40])
    own = Count()
    assert consume(read_xes(spark, str(broken), mode="PERMISSIVE"), own) == [] and own.calls == [1, 3, 0, 1]
    consume_partitions(log, Sink)
    for bound in (None, 1):
        channel = Channel(bound)
        t = threading.Thread(target=consume, args=(log, channel.sender()))
        t.start()
        got = list(channel)
        t.join()
        assert got[0] == log.meta and len(got) == 5
    with pytest.raises(errors.ChannelError):
        Channel(0)


def test_permissive_reading(spark, tmp_path):
    f = tmp_path / "broken.xes"
    f.write_text(L[: len(L) - 40])
    kinds = [r.kind for r in read_xes(spark, str(f), mode="PERMISSIVE").components.orderBy("seq").collect()]
    assert kinds[-1] == "error" and kinds.count("trace") == 3
    with pytest.raises(Exception, match="XesError"):
        read_xes(spark, str(f)).components.count()
    with pytest.raises(errors.StreamError):
        read_xes(spark, str(tmp_path / "none.xes"))


def test_writer_checks_names():
    from traceloom.model import ExtensionDecl

    with pytest.raises(errors.ValidationError):
        list(rendered(Meta(attributes={"a b": Attribute("a b", "x")}), iter([])))
    with pytest.raises(errors.ValidationError):
        list(rendered(Meta(extensions=[ExtensionDecl("a b", "p", "http://x")]), iter([])))


def test_values_as_text():
    assert [xes.value_text("float", x) for x in (1.0, 1.5, 1e-7, 1e22)] == ["1", "1.5", "0.0000001", "10000000000000000000000"]
    assert xes.value_text("boolean", True) == "true"
