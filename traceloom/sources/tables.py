"""Logs over ordinary tables, and the three over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import Meta
from ..operators.eventlog import FlatLog


def from_table(events: DataFrame, case: str | None, order: list[str], event_map: dict[str, tuple[str, str]], traces: DataFrame | None = None, trace_map: dict | None = None, meta: Meta | None = None) -> FlatLog:
    """A log whose events are rows of a table; traces is a table with the case column, for empty traces and their attributes."""
    return FlatLog(events, case, order, event_map, traces, trace_map or {}, meta or Meta())


def events_log(spark: SparkSession, sf_dir: str) -> FlatLog:
    """Cases are users, ordered by time."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    df = df.withColumn("instance", df.event_id.cast("string"))
    return from_table(df, "user_id", ["ts", "event_id"], {"concept:name": ("string", "event_type"), "concept:instance": ("string", "instance"), "time:timestamp": ("date", "ts"), "value": ("float", "value")})


def orders_log(spark: SparkSession, sf_dir: str) -> FlatLog:
    """Cases are orders, events their line items; some orders have none."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    items = items.withColumns({"o_orderkey": items.l_orderkey, "resource": items.l_suppkey.cast("string")})
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    event_map = {"concept:name": ("string", "l_returnflag"), "org:resource": ("string", "resource"), "org:role": ("string", "l_returnflag"), "org:group": ("string", "l_linestatus"), "time:timestamp": ("date", "l_shipdate")}
    trace_map = {"concept:name": ("string", "o_orderstatus"), "priority": ("string", "o_orderpriority"), "date": ("date", "o_orderdate")}
    return from_table(items, "o_orderkey", ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], event_map, orders, trace_map)


def conversations_log(spark: SparkSession, sf_dir: str) -> FlatLog:
    """Cases are conversations, without timestamps."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return from_table(df, "conv_id", ["turn"], {"concept:name": ("string", "role")})
