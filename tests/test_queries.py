"""Every registered query of the service desk against DuckDB on the smallest tables."""

import os
from decimal import Decimal

import duckdb
import pytest

from shoploom.plans import registry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the test tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.sql(f"create view {name.removesuffix('.parquet')} as select * from '{FOLDER}/{name}'")
    return con


def plain(value):
    if isinstance(value, (float, Decimal)):
        return round(float(value), 6)
    return str(value) if value is not None else None


def rows(columns, records):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in at) for r in records), key=str)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


def test_conditional_counts_share_one_scan(spark):
    plan = registry.queries()["ticket_status_kpis"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_filters_reach_the_scan(spark):
    plan = registry.queries()["filter_like_prefix"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(p_type,PROMO)" in plan


@pytest.mark.parametrize("name", ["weekly_chart", "daily_chart", "contract_detail_nested", "contract_report_metrics", "report_sheets", "amc_dashboard"])
def test_line_items_are_read_once(spark, name):
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("l_orderkey" in line and "Relation" in line for line in plan.splitlines()) == 1


@pytest.mark.parametrize("name", ["contract_report_metrics", "report_sheets", "amc_dashboard"])
def test_every_table_is_read_once(spark, name):
    plan = registry.queries()[name](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Relation" in line for line in plan.splitlines()) == 3


def test_a_ticket_is_two_events_at_most(spark):
    from shoploom.plans.tickets import YEARS, ticket_events
    from shoploom.sources.tables import Tables

    events = ticket_events(Tables(spark, FOLDER), *YEARS).groupBy("o_orderkey").count()
    assert events.where("count > 2").count() == 0 and events.count() > 1000


def test_contained_digits_are_met_by_equality(spark):
    plan = registry.queries()["delivery_resolution"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
