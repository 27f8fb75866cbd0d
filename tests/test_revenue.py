"""Net revenue by nation on rows the supplied tables lack, against a plain loop."""

from contextlib import contextmanager
from decimal import Decimal

import pytest

from quillon.plans import revenue_by_nation
from quillon.sources import read_table

SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_extendedprice double, l_discount double",
    "orders": "o_orderkey bigint, o_custkey bigint",
    "customer": "c_custkey bigint, c_nationkey int",
    "nation": "n_nationkey int, n_name string",
}


@contextmanager
def setting(spark, key, value):
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def frames(spark, tables):
    return [spark.createDataFrame(tables[t], SCHEMAS[t]) for t in SCHEMAS]


def by_loop(tables):
    """Every matching combination of rows, added one at a time."""
    totals = {}
    for order, price, discount in tables["lineitem"]:
        for o_order, o_cust in tables["orders"]:
            if order is None or o_order != order:
                continue
            for c_cust, c_nation in tables["customer"]:
                if o_cust is None or c_cust != o_cust:
                    continue
                for nation, name in tables["nation"]:
                    if c_nation is None or nation != c_nation:
                        continue
                    net = None
                    if price is not None and discount is not None:
                        net = Decimal(str(price)) * (1 - Decimal(str(discount)))
                    seen = totals.get((nation, name))
                    totals[nation, name] = (
                        seen if net is None else net if seen is None else seen + net
                    )
    return totals


def by_spark(spark, tables):
    return {
        (r.n_nationkey, r.n_name): r.revenue
        for r in revenue_by_nation(*frames(spark, tables)).collect()
    }


# nulls in every column, keys without a partner on either side, repeated keys
ODD = {
    "lineitem": [
        (1, 100.0, 0.0),
        (1, 0.01, 0.1),
        (1, None, 0.05),
        (2, 19.99, 0.07),
        (2, 19.99, None),
        (3, 50.5, 1.0),
        (4, 12.34, 0.03),
        (5, None, None),
        (9, 77.0, 0.0),
        (None, 88.0, 0.0),
    ],
    "orders": [(1, 10), (2, 10), (2, 11), (3, 11), (4, None), (5, 13), (6, 12), (None, 10)],
    "customer": [(10, 1), (11, 2), (11, 1), (12, 2), (13, 4), (14, None), (None, 1)],
    "nation": [(1, "A"), (2, "B"), (3, "C"), (4, "D"), (None, "E")],
}


@pytest.mark.parametrize("broadcast", ["-1", "10485760"])
def test_odd_rows(spark, broadcast):
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", broadcast):
        got = by_spark(spark, ODD)
    assert got == by_loop(ODD)
    assert got[4, "D"] is None  # an order whose only line has no price
    assert (3, "C") not in got  # a nation nobody ordered from


def test_empty_table(spark):
    assert by_spark(spark, {**ODD, "lineitem": []}) == {}


def test_hot_order(spark):
    """A third of all lines on one order, a third of the rest on one customer."""
    tables = {
        "lineitem": [
            (0 if i % 3 == 0 else i, round(900 + i * 0.37, 2), (i % 11) / 100)
            for i in range(3000)
        ],
        "orders": [(i, 0 if i % 3 == 1 else i) for i in range(3000)],
        "customer": [(i, i % 2) for i in range(3000)],
        "nation": [(0, "A"), (1, "B")],
    }
    nation_of = dict(tables["customer"])
    customer_of = dict(tables["orders"])
    expected = {(0, "A"): Decimal(0), (1, "B"): Decimal(0)}
    for order, price, discount in tables["lineitem"]:
        nation = nation_of[customer_of[order]]
        expected[nation, "AB"[nation]] += Decimal(str(price)) * (1 - Decimal(str(discount)))
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        assert by_spark(spark, tables) == expected


def test_total_beyond_a_long(spark):
    """Sums go on past what a long of hundredths of a cent can hold."""
    price = 9_000_000_000_000.25
    tables = {**ODD, "lineitem": [(1, price, 0.0)] * 200}
    assert by_spark(spark, tables) == {(1, "A"): Decimal(str(price)) * 200}


def test_same_result_in_any_partitioning(spark):
    tables = ("lineitem", "orders", "customer", "nation")
    inputs = [read_table(spark, "/root/testdata/sf0.01", t) for t in tables]
    once = sorted(revenue_by_nation(*inputs).collect())
    for parts in (3, 17):
        moved = [df.repartition(parts) for df in inputs]
        assert sorted(revenue_by_nation(*moved).collect()) == once


def test_plan(spark):
    """What must hold at any scale: pruned scans, early sums, one shuffle each."""
    tables = ("lineitem", "orders", "customer", "nation")
    inputs = [read_table(spark, "/root/testdata/sf0.01", t) for t in tables]
    with setting(spark, "spark.sql.autoBroadcastJoinThreshold", "-1"):
        plan = revenue_by_nation(*inputs)._jdf.queryExecution().executedPlan().toString()
    assert (
        "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_discount:double>" in plan
    )
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint>" in plan
    assert "ReadSchema: struct<c_custkey:bigint,c_nationkey:int>" in plan
    assert "ReadSchema: struct<n_nationkey:int,n_name:string>" in plan
    assert plan.count("PushedFilters: [IsNotNull(") == 4
    # one exchange for each of four tables, two for the sums moved to a new key
    assert plan.count("Exchange hashpartitioning(") == 6
    assert plan.count("Exchange") == 6
    assert plan.count("SortMergeJoin") == 3
    assert plan.count("partial_sum") == 3
    for absent in ("Broadcast", "NestedLoop", "Cartesian", "Python"):
        assert absent not in plan
