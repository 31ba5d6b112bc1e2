"""Queries over the driver's tables, one for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coin import coin_sql
from ..functions.conditions import drop_err, neg
from ..functions.xmltypes import CLASSES, NAME, NCNAME, TOKEN, URI, boolean, marked, marks_in, matches
from ..model import Attribute, Classifier, Global, Meta, Scope
from ..operators.eventlog import FlatLog, classifier_column, order_violations
from ..operators.extensions import Concept, Interval, Org, Time, attribute
from ..operators.handlers import Filter as Clauses
from ..operators.handlers import Handler, in_order, observe_with
from ..sources.tables import conversations_log, events_log, from_table, orders_log
from ..sources.xes import read_xes, write_folder
from .flow import FlowGraph, Segment, ThreadExecutor

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

C, O = Concept, Org
N, I = Concept.NAME_KEY, Concept.INSTANCE_KEY
EV = ("event_id", "user_id", "event_type")
LI = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
#: Bounds used by the time queries, for events and for line items.
E1, E2, E3 = datetime(2024, 1, 5, 6), datetime(2024, 1, 9, 18), datetime(2024, 1, 12)
O1, O2 = datetime(1996, 3, 1), datetime(1998, 9, 1)


def _query(name: str, sql: str) -> Callable[[Query], Query]:
    def run(f: Query) -> Query:
        QUERIES[name], SQL[name] = f, sql
        return f

    return run


def _events(name: str, cnf, sql: str) -> None:
    """Events of LOG_E for which a CNF holds."""
    QUERIES[name] = lambda spark, sf: events_log(spark, sf).filter(events=cnf).events.select(*EV)
    SQL[name] = f"SELECT event_id, user_id, event_type FROM events WHERE {sql}"


def _items(name: str, cnf, sql: str) -> None:
    QUERIES[name] = lambda spark, sf: orders_log(spark, sf).filter(events=cnf).events.select(*LI)
    SQL[name] = f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem WHERE {sql}"


SPANS = "SELECT l_orderkey AS k, arg_min(l_shipdate, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS s, arg_max(l_shipdate, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS e, count(*) AS n FROM lineitem GROUP BY l_orderkey"


def _orders(name: str, condition, sql: str) -> None:
    """Orders whose span fulfils a condition; the condition's error on orders without items counts as false."""
    QUERIES[name] = lambda spark, sf: orders_log(spark, sf).filter(traces=[[drop_err(condition)]]).traces.select("o_orderkey")
    SQL[name] = f"SELECT o_orderkey FROM orders JOIN ({SPANS}) x ON o_orderkey = k WHERE {sql}"


@_query("q01_stats_events", "SELECT count(DISTINCT user_id)::BIGINT AS traces, count(*)::BIGINT AS in_trace, count(*)::BIGINT AS total, 0::BIGINT AS standalone FROM events")
def q01(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).statistics()


@_query("q02_stats_orders_empty", "SELECT (SELECT count(*) FROM orders)::BIGINT AS traces, count(*)::BIGINT AS in_trace, count(*)::BIGINT AS total, 0::BIGINT AS standalone FROM lineitem")
def q02(spark: SparkSession, sf: str) -> DataFrame:
    return orders_log(spark, sf).statistics()


@_query("q03_trace_lengths", "SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_events FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey")
def q03(spark: SparkSession, sf: str) -> DataFrame:
    return orders_log(spark, sf).lengths()


@_query("q04_sequence", "SELECT user_id, string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) AS sequence FROM events GROUP BY user_id")
def q04(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).sequences(F.substring("event_type", 1, 1))


_events("q05_concept_eq", [[C.filter_eq(N, "purchase")]], "event_type = 'purchase'")
_events("q06_concept_in", [[C.filter_in(N, ["view", "click"])]], "event_type IN ('view', 'click')")
_events("q07_concept_match", [[C.filter_match(N, "^[cv]|er")]], "regexp_matches(event_type, '^[cv]|er')")
_events("q08_concept_instance", [[C.filter_eq(I, "42")]], "event_id::VARCHAR = '42'")
_events("q09_neg", [[neg(C.filter_eq(N, "click"))]], "event_type <> 'click'")
#: No log-ins, and of errors those with an odd number alone.
CNF2 = [[neg(C.filter_eq(N, "login"))], [C.filter_match(I, "[13579]$"), neg(C.filter_match(N, "^err"))]]
CNF2_SQL = "event_type <> 'login' AND (regexp_matches(event_id::VARCHAR, '[13579]$') OR NOT regexp_matches(event_type, '^err'))"


@_query("q10_cnf_events", f"SELECT user_id, coalesce(string_agg(substr(event_type, 1, 1), '' ORDER BY ts, event_id) FILTER (WHERE {CNF2_SQL}), '') AS sequence FROM events GROUP BY user_id")
def q10(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).filter(events=CNF2).sequences(F.substring("event_type", 1, 1))


TRACES2 = [[C.filter_eq(N, "O"), C.filter_eq(N, "F")], [attribute("priority", "string", lambda c: c.rlike("^[12]")), neg(C.filter_eq(N, "O"))]]
TRACES2_SQL = "(o_orderstatus = 'O' OR o_orderstatus = 'F') AND (regexp_matches(o_orderpriority, '^[12]') OR o_orderstatus <> 'O')"


@_query("q11_cnf_traces", f"SELECT o_orderkey, o_orderstatus, o_orderpriority FROM orders WHERE {TRACES2_SQL}")
def q11(spark: SparkSession, sf: str) -> DataFrame:
    return orders_log(spark, sf).filter(traces=TRACES2).traces.select("o_orderkey", "o_orderstatus", "o_orderpriority")


@_query("q12_cnf_both", f"SELECT o_orderkey, count(l_orderkey) FILTER (WHERE l_returnflag = 'A')::BIGINT AS n_events FROM orders JOIN ({SPANS}) x ON o_orderkey = k LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE s >= TIMESTAMP '{O1}' AND s <= TIMESTAMP '{O2}' GROUP BY o_orderkey")
def q12(spark: SparkSession, sf: str) -> DataFrame:
    return orders_log(spark, sf).filter(traces=[[drop_err(Time.filter_starts_in(Interval(O1, O2)))]], events=[[O.filter_eq(O.ROLE_KEY, "A")]]).lengths()


@_query("q13_empty_clause", "SELECT count(DISTINCT user_id)::BIGINT AS traces, 0::BIGINT AS in_trace, 0::BIGINT AS total, 0::BIGINT AS standalone FROM events")
def q13(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).filter(events=[[]]).statistics()


_events("q14_empty_cnf", [], "true")


@_query("q15_drop_err", "SELECT 'events' AS log, 0::BIGINT AS n UNION ALL SELECT 'orders', count(*)::BIGINT FROM lineitem WHERE regexp_matches(l_returnflag, '[AR]')")
def q15(spark: SparkSession, sf: str) -> DataFrame:
    cnf = [[drop_err(O.filter_match(O.ROLE_KEY, "[AR]"))]]
    a, b = (log.filter(events=cnf).events.agg(F.count("*").alias("n")) for log in (events_log(spark, sf), orders_log(spark, sf)))
    return a.select(F.lit("events").alias("log"), "n").unionByName(b.select(F.lit("orders").alias("log"), "n"))


_items("q16_org_eq", [[O.filter_eq(O.RESOURCE_KEY, "7")]], "l_suppkey = 7")
_items("q17_org_in", [[O.filter_in(O.GROUP_KEY, ["F"])]], "l_linestatus IN ('F')")
_items("q18_org_match", [[O.filter_match(O.RESOURCE_KEY, "^1\\d$"), neg(O.filter_in(O.ROLE_KEY, ["A", "N"]))]], "regexp_matches(l_suppkey::VARCHAR, '^1\\d$') OR l_returnflag NOT IN ('A', 'N')")


@_query("q19_trace_interval", "SELECT user_id, epoch_us(arg_min(ts, (ts, event_id)))::BIGINT AS start_us, epoch_us(arg_max(ts, (ts, event_id)))::BIGINT AS end_us, count(*)::BIGINT AS n_events FROM events GROUP BY user_id")
def q19(spark: SparkSession, sf: str) -> DataFrame:
    log = events_log(spark, sf)
    us = [F.unix_micros(F.col(c).cast("timestamp")) for c in ("first_", "last_")]
    return log.with_ends().select("user_id", us[0].alias("start_us"), us[1].alias("end_us"), F.col("n_events_").alias("n_events"))


_items("q20_time_eq_event", [[Time.filter_eq(Interval.at(O1)), Time.filter_eq(Interval.at(O2))]], f"l_shipdate = TIMESTAMP '{O1}' OR l_shipdate = TIMESTAMP '{O2}'")
_events("q21_time_eq_tol_event", [[Time.filter_eq_tol(Interval.at(E1), timedelta(hours=1))]], f"abs(epoch_us(ts) - epoch_us(TIMESTAMP '{E1}')) <= 3600000000::BIGINT")
_events("q22_time_before_event", [[Time.filter_before(Interval(E1, E2))]], f"ts < TIMESTAMP '{E1}'")
_events("q23_time_after_event", [[Time.filter_after(Interval(E1, E2))]], f"ts > TIMESTAMP '{E2}'")
_events("q24_time_in_event", [[drop_err(Time.filter_in(Interval(E1, E2)))]], f"ts >= TIMESTAMP '{E1}' AND ts <= TIMESTAMP '{E2}'")
_events("q25_time_starts_in_event", [[Time.filter_starts_in(Interval(E2, E3))]], f"ts BETWEEN TIMESTAMP '{E2}' AND TIMESTAMP '{E3}'")
_events("q26_time_ends_in_event", [[Time.filter_ends_in(Interval(E1, E3))]], f"ts BETWEEN TIMESTAMP '{E1}' AND TIMESTAMP '{E3}'")
_orders("q27_time_before_trace", Time.filter_before(Interval(O2, O2)), f"e < TIMESTAMP '{O2}'")
_orders("q28_time_after_trace", Time.filter_after(Interval(O1, O1)), f"s > TIMESTAMP '{O1}'")
_orders("q29_time_in_trace", Time.filter_in(Interval(O1, O2)), f"s >= TIMESTAMP '{O1}' AND e <= TIMESTAMP '{O2}'")
_orders("q30_time_starts_in_trace", Time.filter_starts_in(Interval(O1, O2)), f"s BETWEEN TIMESTAMP '{O1}' AND TIMESTAMP '{O2}'")
_orders("q31_time_ends_in_trace", Time.filter_ends_in(Interval(O1, O2)), f"e BETWEEN TIMESTAMP '{O1}' AND TIMESTAMP '{O2}'")


@_query("q32_time_order_violations", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b FROM lineitem) WHERE b > l_shipdate")
def q32(spark: SparkSession, sf: str) -> DataFrame:
    return orders_log(spark, sf).inversions(["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"]).select(*LI)


@_query("q33_global_missing", "SELECT 'ValidationError: org:level not found' AS error, count(*)::BIGINT AS n FROM lineitem")
def q33(spark: SparkSession, sf: str) -> DataFrame:
    log = orders_log(spark, sf)
    log.meta = Meta(globals=[Global(Scope.EVENT, [Attribute("org:role", "?"), Attribute("org:level", 0)])])
    return log.violations().groupBy("error").agg(F.count("*").alias("n"))


def checked_meta() -> Meta:
    return Meta([Concept.declare(), Time.declare()], [Global(Scope.EVENT, [Attribute("concept:name", "?"), Attribute("time:timestamp", E1)])])


@_query("q34_validate_ok", "SELECT event_id, user_id, event_type FROM events")
def q34(spark: SparkSession, sf: str) -> DataFrame:
    log = replace(events_log(spark, sf), order=["event_id"], meta=checked_meta())
    return log.validate().events.select(*EV)


@_query("q35_order_state", "SELECT seq, kind FROM (SELECT event_id AS seq, CASE WHEN event_id % 5 < 3 THEN 'event' ELSE 'trace' END AS kind, max(CASE WHEN event_id % 5 < 3 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM events) WHERE kind <> 'event' AND b = 1")
def q35(spark: SparkSession, sf: str) -> DataFrame:
    events = spark.read.parquet(f"{sf}/events.parquet")
    kind = F.when(F.col("event_id") % 5 < 3, "event").otherwise("trace")
    return order_violations(events.select(F.col("event_id").alias("seq"), kind.alias("kind")))


@_query("q36_ncname", f"SELECT v, regexp_full_match(v, '{NCNAME}') AS is_ncname, regexp_full_match(v, '{NAME}') AS is_name, regexp_full_match(v, '{TOKEN}') AS is_token FROM (SELECT DISTINCT p_name AS v FROM part UNION SELECT DISTINCT p_brand FROM part UNION SELECT DISTINCT p_type || ':' || p_size::VARCHAR FROM part UNION SELECT DISTINCT source FROM documents)")
def q36(spark: SparkSession, sf: str) -> DataFrame:
    part, docs = spark.read.parquet(f"{sf}/part.parquet"), spark.read.parquet(f"{sf}/documents.parquet")
    values = [part.select(F.col("p_name").alias("v")), part.select("p_brand"), part.select(F.concat("p_type", F.lit(":"), F.col("p_size").cast("string"))), docs.select("source")]
    v = values[0].union(values[1]).union(values[2]).union(values[3]).distinct()
    return v.select("v", *[matches(k, F.col("v")).alias(f"is_{k.lower()}") for k in ("NCName", "Name", "token")])


@_query("q37_token_bool", f"SELECT v, regexp_full_match(v, '{TOKEN}') AS is_token, CASE WHEN v IN ('true', '1') THEN true WHEN v IN ('false', '0') THEN false END AS as_bool FROM (SELECT DISTINCT l_linenumber::VARCHAR AS v FROM lineitem UNION SELECT DISTINCT o_orderpriority FROM orders UNION SELECT (o_orderkey % 2)::VARCHAR FROM orders UNION SELECT ' ' || o_orderstatus FROM orders UNION SELECT CASE WHEN o_orderkey % 2 = 0 THEN 'true' ELSE 'false' END FROM orders)")
def q37(spark: SparkSession, sf: str) -> DataFrame:
    items, orders = spark.read.parquet(f"{sf}/lineitem.parquet"), spark.read.parquet(f"{sf}/orders.parquet")
    v = items.select(F.col("l_linenumber").cast("string").alias("v")).union(orders.select("o_orderpriority")).union(orders.select((F.col("o_orderkey") % 2).cast("string")))
    v = v.union(orders.select(F.concat(F.lit(" "), "o_orderstatus"))).union(orders.select(F.when(F.col("o_orderkey") % 2 == 0, "true").otherwise("false"))).distinct()
    return v.select("v", matches("token", F.col("v")).alias("is_token"), boolean(F.col("v")).alias("as_bool"))


@_query("q38_split_train", f"SELECT event_id, user_id, event_type FROM events WHERE {coin_sql(0, 'user_id')} <= 0.8")
def q38(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).split(0.8, 0)[0].events.select(*EV)


@_query("q39_split_test", f"SELECT event_id, user_id, event_type FROM events WHERE {coin_sql(0, 'user_id')} > 0.8")
def q39(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).split(0.8, 0)[1].events.select(*EV)


@_query("q40_sample", f"SELECT o_orderkey, count(l_orderkey)::BIGINT AS n_events FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE {coin_sql(3, 'o_orderkey')} <= 0.1 GROUP BY o_orderkey")
def q40(spark: SparkSession, sf: str) -> DataFrame:
    return orders_log(spark, sf).sample(0.1, 3).lengths()


@_query("q41_duplicate_stats", "SELECT c AS copy, count(DISTINCT user_id)::BIGINT AS traces, count(*)::BIGINT AS in_trace FROM events, (SELECT unnest([1, 2]) AS c) GROUP BY c")
def q41(spark: SparkSession, sf: str) -> DataFrame:
    parts = [log.statistics().select(F.lit(i + 1).alias("copy"), "traces", "in_trace") for i, log in enumerate(events_log(spark, sf).duplicate())]
    return parts[0].unionByName(parts[1])


@_query("q42_attr_children", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'web' AS origin, CASE WHEN json_extract_string(props, '$.k') IS NULL THEN 1 ELSE 2 END::INTEGER AS n FROM events")
def q42(spark: SparkSession, sf: str) -> DataFrame:
    """Attributes inside attributes: k of the table, and one that is set afterwards."""
    df = spark.read.parquet(f"{sf}/events.parquet")
    df = df.withColumns({"k": F.get_json_object("props", "$.k"), "instance": df.event_id.cast("string")})
    log = from_table(df, None, ["ts", "event_id"], {N: ("string", "event_type"), I: ("string", "instance")}).inside(N, {"k": ("string", "k")}).nested()
    a = F.col("attributes")
    changed = log.with_child(N, Attribute("origin", "app")).with_child(N, Attribute("origin", "web"))
    return changed.components.select(log.value_or(a, I, "string").cast("long").alias("event_id"), log.child(a, N, "k").alias("k"), log.child(a, N, "origin").alias("origin"), F.size(log.children_or(a, N)).alias("n"))


@_query("q43_attr_types", "SELECT 'concept:name' AS key, 'string' AS type, count(event_type)::BIGINT AS n FROM events UNION ALL SELECT 'concept:instance', 'string', count(event_id)::BIGINT FROM events UNION ALL SELECT 'time:timestamp', 'date', count(ts)::BIGINT FROM events UNION ALL SELECT 'value', 'float', count(value)::BIGINT FROM events")
def q43(spark: SparkSession, sf: str) -> DataFrame:
    return events_log(spark, sf).attribute_types()


@_query("q44_attr_upsert_remove", "SELECT o_orderkey AS seq, 'second' AS x, NULL::VARCHAR AS status, 3::INTEGER AS n FROM orders")
def q44(spark: SparkSession, sf: str) -> DataFrame:
    log = orders_log(spark, sf).nested().with_attribute(Attribute("x", "first")).with_attribute(Attribute("x", "second")).without_attribute("concept:name")
    a = F.col("attributes")
    return log.components.select("seq", F.element_at(a, "x")["s"].alias("x"), F.element_at(a, "concept:name")["s"].alias("status"), F.size(F.map_keys(a)).alias("n"))


def train_test_flow(sf: str) -> FlowGraph:
    """Sample, split and count, as in a train and a test pipe."""
    graph = FlowGraph().source("Train", Segment("TableReader").attribute("folder", sf).attribute("log", "orders"))
    graph.stream(Segment("Repair")).stream(Segment("Statistics").emit_artifact("raw"))
    graph.stream(Segment("Sample").attribute("ratio", 0.1).attribute("seed", 0)).stream(Segment("Statistics").emit_artifact("sample"))
    graph.stream(Segment("Split").attribute("ratio", 0.8).attribute("seed", 1).emit_stream("test")).stream(Segment("Statistics").emit_artifact("train")).sink(Segment("VoidSink"))
    return graph.source("Test", Segment("Receiver").acquire_stream("test")).stream(Segment("Statistics").emit_artifact("test")).sink(Segment("VoidSink"))


def _flow_sql() -> str:
    parts = []
    for name, where in (("raw", "true"), ("sample", f"{coin_sql(0, 'o_orderkey')} <= 0.1"), ("train", f"{coin_sql(0, 'o_orderkey')} <= 0.1 AND {coin_sql(1, 'o_orderkey')} <= 0.8"), ("test", f"{coin_sql(0, 'o_orderkey')} <= 0.1 AND {coin_sql(1, 'o_orderkey')} > 0.8")):
        parts.append(f"SELECT '{name}' AS name, count(DISTINCT o_orderkey)::BIGINT AS traces, count(l_orderkey)::BIGINT AS in_trace, count(l_orderkey)::BIGINT AS total FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE {where}")
    return " UNION ALL ".join(parts)


@_query("q45_flow_train_test", _flow_sql())
def q45(spark: SparkSession, sf: str) -> DataFrame:
    artifacts = train_test_flow(sf).execute(spark)
    return spark.createDataFrame([(n, *artifacts[n].counts()) for n in ("raw", "sample", "train", "test")], "name string, traces long, in_trace long, total long")


@_query("q46_conv_sequences", "SELECT conv_id, string_agg(substr(role, 1, 1), '' ORDER BY turn) AS sequence FROM conversations GROUP BY conv_id")
def q46(spark: SparkSession, sf: str) -> DataFrame:
    return conversations_log(spark, sf).sequences(F.substring("role", 1, 1))


@_query("q47_xes_roundtrip", "SELECT count(DISTINCT conv_id)::BIGINT AS traces, count(*)::BIGINT AS in_trace, count(*)::BIGINT AS total, 0::BIGINT AS standalone FROM conversations")
def q47(spark: SparkSession, sf: str) -> DataFrame:
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or f"file://{tempfile.gettempdir()}"
    path = f"{base.rstrip('/')}/xes-{uuid.uuid4().hex}.xes"
    write_folder(conversations_log(spark, sf).nested(), path, 1)
    return read_xes(spark, path).statistics()


BY_LINE = "l_linenumber, l_partkey, l_suppkey, l_shipdate"


@_query("q48_validate_order", f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 'ValidationError: children of trace are not chronological' AS error FROM (SELECT *, lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY {BY_LINE}) AS b FROM lineitem) WHERE b > l_shipdate")
def q48(spark: SparkSession, sf: str) -> DataFrame:
    log = replace(orders_log(spark, sf), order=BY_LINE.split(", "), meta=Meta([Time.declare()]))
    return log.violations().select(*LI, "error")


def partly_outside(spark: SparkSession, sf: str) -> FlatLog:
    """Users by name as cases; errors belong to no case."""
    log = events_log(spark, sf)
    case = F.when(F.col("event_type") != "error", F.concat(F.lit("user "), F.col("user_id").cast("string")))
    return replace(log, events=log.events.withColumn("user", case), case="user", meta=Meta([Concept.declare(), Time.declare()]))


@_query("q49_events_outside", "SELECT count(DISTINCT user_id) FILTER (WHERE event_type <> 'error')::BIGINT AS traces, count(*) FILTER (WHERE event_type <> 'error')::BIGINT AS in_trace, count(*)::BIGINT AS total, count(*) FILTER (WHERE event_type = 'error')::BIGINT AS standalone FROM events")
def q49(spark: SparkSession, sf: str) -> DataFrame:
    return partly_outside(spark, sf).validate().nested().statistics()


_orders("q50_time_eq_tol_trace", Time.filter_eq_tol(Interval(O1, O1), timedelta(days=60)), f"abs(epoch_us(s) - epoch_us(TIMESTAMP '{O1}')) <= 5184000000000 AND abs(epoch_us(e) - epoch_us(TIMESTAMP '{O1}')) <= 5184000000000")


@_query("q51_duration", f"SELECT o_orderkey, epoch_us(e) - epoch_us(s) AS duration_us FROM orders LEFT JOIN ({SPANS}) x ON o_orderkey = k")
def q51(spark: SparkSession, sf: str) -> DataFrame:
    return orders_log(spark, sf).durations()


@_query("q52_org_validator", "SELECT 'ValidationError: org:resource is no string' AS error, count(*)::BIGINT AS n FROM lineitem")
def q52(spark: SparkSession, sf: str) -> DataFrame:
    log = orders_log(spark, sf)
    log = replace(log, event_map=log.event_map | {O.RESOURCE_KEY: ("int", "l_suppkey")}, meta=Meta([Org.declare()]))
    return log.violations().groupBy("error").agg(F.count("*").alias("n"))


class _Shout(Handler):
    """Roles in capitals."""

    def on_event(self, attributes, in_trace):
        name = F.element_at(attributes, N)
        return None, F.map_concat(F.map_filter(attributes, lambda k, v: k != N), F.create_map(F.lit(N), name.withField("s", F.upper(name["s"]))))


@_query("q53_handlers", "SELECT conv_id AS seq, '[' || coalesce(string_agg(upper(substr(role, 1, 1)), '' ORDER BY turn) FILTER (WHERE role <> 'system'), '') || ']' AS sequence FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'system') = 0 OR min(turn) FILTER (WHERE role = 'system') = min(turn)")
def q53(spark: SparkSession, sf: str) -> DataFrame:
    """Conversations whose system events, if any, come first, without these; then all in capitals."""

    class NoLateSystem(Handler):
        def on_trace(self, attributes, events):
            names = F.transform(events, lambda e: F.element_at(e["attributes"], N)["s"])
            return F.coalesce(F.array_position(names, "system"), F.lit(0)) <= 1, None

    own = observe_with(conversations_log(spark, sf).nested(), [NoLateSystem(), Clauses(events=[[neg(C.filter_eq(N, "system"))]]), _Shout()])
    return own.sequences(lambda a: F.substring(F.element_at(a, N)["s"], 1, 1))


@_query("q54_every_second_event", "SELECT conv_id AS seq, n FROM (SELECT conv_id, row_number() OVER (ORDER BY conv_id, turn) - 1 AS n FROM conversations) WHERE n % 2 = 0")
def q54(spark: SparkSession, sf: str) -> DataFrame:
    return in_order(conversations_log(spark, sf).nested()).where("n % 2 = 0").select("seq", F.col("n").cast("long").alias("n"))


@_query("q55_flow_json_threads", _flow_sql())
def q55(spark: SparkSession, sf: str) -> DataFrame:
    """As q45, from JSON and with a thread for each pipe."""
    artifacts = FlowGraph.from_json(train_test_flow(sf).close().to_json()).execute(spark, ThreadExecutor())
    return spark.createDataFrame([(n, *artifacts[n].counts()) for n in ("raw", "sample", "train", "test")], "name string, traces long, in_trace long, total long")


@_query("q56_repair", "SELECT event_id, 'EventName' AS name, event_type || '+' || event_id::VARCHAR AS value FROM events")
def q56(spark: SparkSession, sf: str) -> DataFrame:
    log = replace(events_log(spark, sf), meta=Meta(classifiers=[Classifier("Event Name", Scope.EVENT, f"{N} {I}")])).repair().validate()
    own = log.meta.classifiers[0]
    return log.events.select("event_id", F.lit(own.name).alias("name"), classifier_column(log, own.keys).alias("value"))


@_query("q57_anyuri", f"SELECT url AS v, regexp_matches(url, '{URI}') AS is_uri FROM pages UNION ALL SELECT props, regexp_matches(props, '{URI}') FROM events")
def q57(spark: SparkSession, sf: str) -> DataFrame:
    v = spark.read.parquet(f"{sf}/pages.parquet").select(F.col("url").alias("v")).unionAll(spark.read.parquet(f"{sf}/events.parquet").select("props"))
    return v.select("v", matches("anyURI", F.col("v")).alias("is_uri"))


def _letters_sql() -> str:
    return ", ".join(f"length(regexp_replace(coalesce(text, ''), '[^{CLASSES[k]}]', '', 'g'))::INTEGER AS {k.lower()}" for k in CLASSES)


@_query("q58_letter_classes", f"SELECT doc_id, {_letters_sql()} FROM documents")
def q58(spark: SparkSession, sf: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", marked(F.coalesce(F.col("text"), F.lit(""))).alias("text"))
    return docs.select("doc_id", *[marks_in(k, F.col("text")).alias(k.lower()) for k in CLASSES])


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Case and sequence of the events that are views or clicks inside a time span."""
    cnf = [[Concept.filter_in(N, ["view", "click"])], [drop_err(Time.filter_in(Interval(E1, E2)))]]
    return events_log(spark, sf).filter(events=cnf).sequences(F.substring("event_type", 1, 1))
