"""Every query with a SQL twin gives DuckDB's rows; those without run and have a test of their own elsewhere."""

import datetime

import pytest
from conftest import SMALL

from passagemill.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_as_duckdb(name, spark, duck, same):
    same(QUERIES[name](spark, SMALL), duck.sql(ORACLE_SQL[name]))


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_runs(name, spark):
    assert QUERIES[name](spark, SMALL).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_range_join_meets_all_orders_and_events(spark):
    orders = [(r["o_orderkey"], r["o_orderdate"].day, r["o_totalprice"] / 10000) for r in spark.read.parquet(f"{SMALL}/orders.parquet").collect()]
    by_day = {}
    for r in spark.read.parquet(f"{SMALL}/events.parquet").collect():
        by_day.setdefault(r["ts"].day, []).append(r["value"])
    want = {k: n for k, day, x in orders if (n := sum(v is not None and x - 1 <= v <= x + 1 for v in by_day.get(day, [])))}
    assert any(k % 10 for k in want)
    assert {r["o_orderkey"]: r["n"] for r in QUERIES["rl8_range_join_by_buckets"](spark, SMALL).collect()} == want


def test_slots_are_taken_by_all_users(spark):
    taken = {}
    for r in spark.read.parquet(f"{SMALL}/events.parquet").filter("event_type = 'signup'").collect():
        taken.setdefault(f"{r['ts']:%Y-%m-%d}", []).append(r["ts"].hour * 60 + r["ts"].minute)
    slots = {(r["day"], r["start"]) for r in QUERIES["tm5_slots"](spark, SMALL).collect()}
    want = {(day, s) for day, s in slots if not any(s < a + 35 and s + 30 > a - 15 for a in taken.get(day, []))}
    assert {(r["day"], r["start"]) for r in QUERIES["tm6_free_slots"](spark, SMALL).collect()} == want


def test_range_join_by_buckets_makes_no_pairs(spark):
    from passagemill.plans.relational import range_join

    day = datetime.datetime(2024, 1, 5)
    values = [0.5, 0.5, 1.5, 1.5000001, -3.0, float("nan"), float("inf"), None]
    orders = spark.createDataFrame([(1, day, 5000.0), (2, day, 0.0), (3, day, float("nan")), (4, None, 5000.0), (5, day, None), (5, day, -30000.0), (5, day, 5000.0)], "o_orderkey long, o_orderdate timestamp, o_totalprice double")
    events = spark.createDataFrame([(day, v) for v in values] + [(None, 0.5), (day + datetime.timedelta(1), 0.5)], "ts timestamp, value double")
    found = range_join(orders, events)
    assert {r["o_orderkey"]: r["n"] for r in found.collect()} == {1: 3, 2: 2, 3: 1, 5: 4}
    many = range_join(spark.range(2000).selectExpr("id o_orderkey", "timestamp '2024-01-05' o_orderdate", "5000.0D o_totalprice"), spark.range(2000).selectExpr("timestamp '2024-01-05' ts", "0.5D value"))
    assert {r["n"] for r in many.collect()} == {2000}
    assert "(value" not in many._jdf.queryExecution().optimizedPlan().toString()
