"""Every query that has SQL gives the same rows as DuckDB on the smallest tables; plans push filters to the scan."""

from __future__ import annotations

import os

import pytest

from traceloom.plans import catalogue
from traceloom.sources.tables import events_log

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", catalogue.QUERIES)
def test_same_as_sql(spark, duck, name):
    got = catalogue.QUERIES[name](spark, SF)
    columns = sorted(got.columns)
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({catalogue.SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(columns).collect()))) == sorted(map(repr, want))


def test_filters_without_errors_reach_the_scan(spark):
    from traceloom.functions.conditions import drop_err
    from traceloom.operators.extensions import attribute

    cnf = [[drop_err(attribute("value", "float", lambda c: c > 5.0))]]
    plan = events_log(spark, SF).filter(events=cnf).events.select("event_id")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(value,5.0)" in plan and "props" not in plan


def test_letter_classes_cost_one_look_a_character(spark):
    """One table for all classes, looked into once; no pattern with hundreds of ranges, of which a text would try all."""
    plan = catalogue.QUERIES["q58_letter_classes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("translate(") == 1 and "regexp" not in plan


def test_flagship(spark):
    assert catalogue.flagship(spark, SF).count() > 0
