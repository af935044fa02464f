"""Balances of orders over time, from day deltas (order_key, order_date, event_date, amount).

Windows here are partitioned by order.  Day deltas hold at most one row per order and day, so
such a partition is bounded by the calendar, whatever the number of lines of an order.
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window, functions as F

from quayline.functions.money import EXACT
from quayline.operators.orders import order_totals

# fixed value: balances up to one cent count as closed
CLOSED = Decimal("0.01")


def _timeline() -> Window:
    return Window.partitionBy("order_key").orderBy("event_date")


def _running_balance() -> Column:
    to_date = _timeline().rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return F.sum("amount").over(to_date).cast(EXACT)


def is_open() -> Column:
    return F.col("balance") > F.lit(CLOSED)


def balance_history(deltas: DataFrame) -> DataFrame:
    """Each balance with the day it starts (``event_date``) and the day the next one replaces
    it (``next_date``, null for the last)."""
    return deltas.select(
        "order_key",
        "order_date",
        "event_date",
        _running_balance().alias("balance"),
        F.lead("event_date").over(_timeline()).alias("next_date"),
    )


def balances_asof(deltas: DataFrame, as_of: dt.date | Column) -> DataFrame:
    """Balance of every order with an entry up to ``as_of``, from deltas or ledger entries.
    ``order_date`` is the latest order entry seen by then, null before the first."""
    day = as_of if isinstance(as_of, Column) else F.lit(as_of)
    if "order_date" in deltas.columns:
        placed = F.when(F.col("order_date") <= day, F.col("order_date"))
    else:
        placed = F.when(F.col("is_order"), F.col("event_date"))
    return (
        deltas.where(F.col("event_date") <= day)
        .groupBy("order_key")
        .agg(F.sum("amount").cast(EXACT).alias("balance"), F.max(placed).alias("order_date"))
    )


def open_orders_asof(orders: DataFrame, lines: DataFrame, as_of: dt.date) -> DataFrame:
    """Open balances as of a day straight from the tables: order_key, balance, order_date.

    Equal to ``balances_asof`` of the ledger kept open: an order placed by then has added its
    total and lost its shipped lines, so its balance is the revenue shipping later; an order
    not placed yet cannot be positive.  Both date filters reach the scans, and the ledger with
    its second pass over the lines is not needed.
    """
    day = F.lit(as_of)
    placed = orders.where(F.col("o_orderdate") <= day).select(
        F.col("o_orderkey").alias("order_key"), F.col("o_orderdate").alias("order_date")
    )
    # a line without a ship date has not shipped
    due = order_totals(lines.where(F.col("l_shipdate").isNull() | (F.col("l_shipdate") > day)))
    return (
        due.select(F.col("l_orderkey").alias("order_key"), F.col("revenue").alias("balance"))
        .where(is_open())
        .join(placed, "order_key")
        .select("order_key", "balance", "order_date")
    )


def bounded_balances_asof(
    deltas: DataFrame, head: dt.date, threshold: dt.date, versions: int = 3
) -> DataFrame:
    """Balances as of ``threshold`` when only the newest ``versions`` days of each order are
    remembered out of the entries up to ``head``; an order whose remembered days are all newer
    than ``threshold`` is missing.  With unlimited versions this is ``balances_asof``.

    One window sort serves everything: a day is remembered when fewer than ``versions`` days
    follow it, and it is the answer when the next day is past the threshold.
    """
    next_day = F.lead("event_date").over(_timeline())
    nth_later_day = F.lead("event_date", versions).over(_timeline())
    return (
        deltas.where(F.col("event_date") <= F.lit(head))
        .select(
            "order_key",
            "order_date",
            "event_date",
            _running_balance().alias("balance"),
            next_day.alias("next_date"),
            nth_later_day.isNull().alias("remembered"),
        )
        .where(
            F.col("remembered")
            & (F.col("event_date") <= F.lit(threshold))
            & (F.col("next_date").isNull() | (F.col("next_date") > F.lit(threshold)))
        )
        .select("order_key", "balance", "order_date", "event_date")
    )
