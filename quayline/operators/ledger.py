"""The signed ledger: an order adds its whole revenue on its order date, each line takes its
own revenue away on its ship date.  The balance of an order as of a day is what has not
shipped yet.

``order_key`` is expected to be unique among the orders; a line without an order is no entry.
A line without a ship date has not shipped: it counts in its order's amount and is no entry, so
its order stays open.  An order without a date is not placed: neither it nor its lines are
entries.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from quayline.functions.money import EXACT, line_revenue, line_units, round_units, sum_units, to_cents
from quayline.operators.orders import orders_with_totals


def dated_lines(lines: DataFrame) -> DataFrame:
    return lines.where(F.col("l_shipdate").isNotNull())


def placed_orders(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("o_orderdate").isNotNull())


def ledger_entries(orders: DataFrame, lines: DataFrame, rounded: bool = False) -> DataFrame:
    """One entry per order and one per line: order_key, cust_key, amount, event_date, is_order.

    ``rounded`` gives the amounts of the exchange file, each rounded to cents by itself.
    """
    orders = placed_orders(orders)
    placed = orders_with_totals(
        orders.select("o_orderkey", "o_custkey", "o_orderdate"), lines
    ).select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_custkey").alias("cust_key"),
        F.col("revenue").alias("amount"),
        F.col("o_orderdate").alias("event_date"),
        F.lit(True).alias("is_order"),
    )
    owners = orders.select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key")
    )
    shipped = (
        dated_lines(lines)
        .select(
            F.col("l_orderkey").alias("order_key"),
            (-line_revenue()).alias("amount"),
            F.col("l_shipdate").alias("event_date"),
        )
        .join(owners, "order_key")
        .withColumn("is_order", F.lit(False))
    )
    entries = placed.unionByName(shipped)
    amount = to_cents("amount") if rounded else F.col("amount").cast(EXACT)
    return entries.withColumn("amount", amount)


def touched_months(orders: DataFrame, lines: DataFrame, new_orders: DataFrame, new_lines: DataFrame) -> DataFrame:
    """First days (``month``) of the event months whose entries change when rows are added: those of the
    new orders and of all their lines, of the new lines, and of the orders that new lines belong to."""

    def months(rows: DataFrame, day: str) -> DataFrame:
        return rows.select(F.trunc(day, "month").alias("month"))

    placed = placed_orders(orders).select("o_orderkey", "o_orderdate")
    added = new_lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(placed, "o_orderkey")
    # lines may have come before their order
    waiting = lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate").join(new_orders.select("o_orderkey"), "o_orderkey", "left_semi")
    found = [months(new_orders, "o_orderdate"), months(waiting, "l_shipdate"), months(added, "o_orderdate"), months(added, "l_shipdate")]
    return reduce(DataFrame.unionByName, found).where("month IS NOT NULL").distinct()


def ledger_of_months(orders: DataFrame, lines: DataFrame, months: list[dt.date]) -> DataFrame:
    """The ledger's entries of some event months (their first days).  Lines are read for the shipments of
    those months and for the totals of the orders placed in them."""

    def inside(day: str) -> Column:
        return F.trunc(day, "month").isin(months)

    placed = orders.where(inside("o_orderdate"))
    own = lines.join(placed.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    orders_of_them = ledger_entries(placed, own).where("is_order")
    return orders_of_them.unionByName(ledger_entries(orders, lines.where(inside("l_shipdate"))).where("NOT is_order"))


def in_ledger_order(entries: DataFrame) -> DataFrame:
    """By date, orders before lines; key and amount let the sort split a crowded day."""
    return entries.orderBy("event_date", F.desc("is_order"), "order_key", "amount")


def rounding_residuals(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """Orders whose cents-rounded entries do not add up to zero, with what is left over.

    Needs no ledger: the residual is the rounded total minus the sum of the rounded lines that
    have shipped.
    """
    units = line_units()
    shipped = F.when(F.col("l_shipdate").isNotNull(), round_units(units)).otherwise(0)
    sums = lines.groupBy(F.col("l_orderkey").alias("order_key")).agg(
        (to_cents(sum_units(units)) - sum_units(shipped)).cast(EXACT).alias("residual")
    )
    keys = placed_orders(orders).select(F.col("o_orderkey").alias("order_key"))
    return sums.where(F.col("residual") != 0).join(keys, "order_key", "left_semi")


def day_deltas(orders: DataFrame, lines: DataFrame) -> DataFrame:
    """The ledger summed per order and day: order_key, order_date, event_date, amount.

    Lines are scanned once and summed per order and ship date, so what meets the orders is
    bounded by the calendar no matter how many lines an order has.  From the join on, rows
    stay in its partitioning: the window that totals an order, the entry the order adds on its
    own date, and the final sum per day need no further shuffle.
    """
    # one row without a date holds what an order has not shipped
    days = (
        lines.groupBy("l_orderkey", "l_shipdate")
        .agg(sum_units(line_units()).alias("revenue"))
        .select(F.col("l_orderkey").alias("order_key"), "l_shipdate", "revenue")
    )
    placed = placed_orders(orders).select(
        F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("order_date")
    )
    by_day = Window.partitionBy("order_key").orderBy("l_shipdate")
    whole_order = by_day.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.coalesce(F.sum("revenue").over(whole_order).cast(EXACT), F.lit(0).cast(EXACT))
    place = F.row_number().over(by_day)

    def entry(day: str, amount: Column) -> Column:
        return F.struct(F.col(day).alias("event_date"), amount.cast(EXACT).alias("amount"))

    # the first row of an order also brings the order's own entry; it is the one without a date
    # where there is one, or where the order has no lines
    shipment = F.array(entry("l_shipdate", -F.col("revenue")))
    opening = F.array(entry("order_date", F.col("total")))
    entries = (
        F.when(F.col("l_shipdate").isNull(), opening)
        .when(F.col("place") == 1, F.concat(opening, shipment))
        .otherwise(shipment)
    )
    return (
        placed.join(days, "order_key", "left")
        .withColumns({"total": total, "place": place})
        .select("order_key", "order_date", F.inline(entries))
        .groupBy("order_key", "order_date", "event_date")
        .agg(F.sum("amount").cast(EXACT).alias("amount"))
    )
