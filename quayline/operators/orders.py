"""Orders, customers and lines: filters, joins and aggregates."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from quayline.functions.money import EXACT, line_revenue, line_units, sum_cents, sum_units


def segment_customers(customer: DataFrame, segment: str) -> DataFrame:
    return customer.where(F.col("c_mktsegment") == segment).select("c_custkey", "c_mktsegment")


def orders_of_segment(orders: DataFrame, customer: DataFrame, segment: str) -> DataFrame:
    """Orders whose customer is in ``segment``; unknown customers drop out.

    A semi join without a broadcast hint: Spark broadcasts the customer keys while they are
    below its threshold and otherwise shuffles, where AQE splits a customer with a large
    share of the orders.
    """
    keys = segment_customers(customer, segment).select(F.col("c_custkey").alias("o_custkey"))
    return orders.join(keys, "o_custkey", "left_semi")


def line_revenues(lines: DataFrame) -> DataFrame:
    return lines.select("l_orderkey", "l_linenumber", line_revenue().alias("revenue"))


def order_totals(lines: DataFrame) -> DataFrame:
    """Revenue per order.  Partial sums collapse each order before the shuffle, so neither the
    shuffle nor a later join on the order key sees a hot order as more than one row a task."""
    return lines.groupBy("l_orderkey").agg(sum_units(line_units()).alias("revenue"))


def orders_with_totals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Every order with its revenue; 0 when it has no lines."""
    totals = order_totals(lines).withColumnRenamed("l_orderkey", "o_orderkey")
    return orders.join(totals, "o_orderkey", "left").withColumn(
        "revenue", F.coalesce("revenue", F.lit(0).cast(EXACT))
    )


def unshipped_orders(orders: DataFrame, lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Orders placed before ``as_of`` with the revenue of their lines shipped after it.

    Lines are summed per order before the join; the shuffle of that sum already has the
    partitioning the join wants.  Orders without such lines do not appear, and neither do
    orders whose remaining revenue is not positive.
    """
    placed = orders.where(F.col("o_orderdate") < F.lit(as_of)).select(
        "o_orderkey", "o_orderdate", "o_shippriority"
    )
    due = order_totals(lines.where(F.col("l_shipdate") > F.lit(as_of)))
    return (
        placed.join(due.withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey")
        .where(F.col("revenue") > 0)
        .select(F.col("o_orderkey").alias("l_orderkey"), "revenue", "o_orderdate", "o_shippriority")
    )


def daily_totals(orders: DataFrame) -> DataFrame:
    """Number and value of the orders of each day."""
    return orders.groupBy("o_orderdate").agg(
        F.count("*").alias("order_count"), sum_cents("o_totalprice").alias("daily_sum")
    )


def best_days(orders: DataFrame, k: int = 5) -> DataFrame:
    return daily_totals(orders).orderBy(F.desc("daily_sum"), "o_orderdate").limit(k)


def daily_segment_orders(orders: DataFrame, customer: DataFrame) -> DataFrame:
    """Orders per market segment and day."""
    customers = customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return (
        orders.select("o_custkey", "o_orderdate")
        .join(customers, "o_custkey")
        .groupBy("c_mktsegment", "o_orderdate")
        .agg(F.count("*").alias("order_count"))
    )
