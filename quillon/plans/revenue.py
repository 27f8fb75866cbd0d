"""Revenue reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import net_units, units_to_money


def revenue_by_nation(
    lineitem: DataFrame, orders: DataFrame, customer: DataFrame, nation: DataFrame
) -> DataFrame:
    """Net revenue of line items by the nation of the ordering customer.

    Revenue is summed before each join, on the join's own key. The sum shuffles on
    the key the join needs, so it adds no exchange, and it is combined on the map
    side first: a key holding a third of all rows reaches the shuffle as one row
    per map task. The summed side then has one row per key, so no join task is hot
    on it. Summing early gives the same totals also where a key repeats on the
    other side, as a join repeats the whole sum.
    """
    by_order = lineitem.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(net_units(F.col("l_extendedprice"), F.col("l_discount"))).alias("units")
    )
    by_customer = (
        by_order.join(orders.select("o_orderkey", "o_custkey"), "o_orderkey")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(F.sum("units").alias("units"))
    )
    by_nation = (
        by_customer.join(customer.select("c_custkey", "c_nationkey"), "c_custkey")
        .groupBy(F.col("c_nationkey").alias("n_nationkey"))
        .agg(F.sum("units").alias("units"))
    )
    return by_nation.join(nation.select("n_nationkey", "n_name"), "n_nationkey").select(
        "n_nationkey", "n_name", units_to_money(F.col("units")).alias("revenue")
    )
