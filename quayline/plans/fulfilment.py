"""Ledger, balance and leaderboard reports over one market segment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from quayline.operators import balances, boards, ledger
from quayline.operators.orders import orders_of_segment
from quayline.plans.shipping_priority import SEGMENT, K
from quayline.sources.tables import Tables
from quayline.storage import fresh_dir

# the day the as-of reports show by default, well inside the data
AS_OF = dt.date(1998, 6, 30)


def _orders(tables: Tables, segment: str) -> DataFrame:
    return orders_of_segment(tables.orders, tables.customer, segment)


def ledger_exact(tables: Tables, segment: str = SEGMENT) -> DataFrame:
    return ledger.in_ledger_order(ledger.ledger_entries(_orders(tables, segment), tables.lineitem))


def ledger_rounded(tables: Tables, segment: str = SEGMENT) -> DataFrame:
    return ledger.in_ledger_order(
        ledger.ledger_entries(_orders(tables, segment), tables.lineitem, rounded=True)
    )


def ledger_residuals(tables: Tables, segment: str = SEGMENT) -> DataFrame:
    return ledger.rounding_residuals(_orders(tables, segment), tables.lineitem)


def day_deltas(tables: Tables, segment: str = SEGMENT) -> DataFrame:
    return ledger.day_deltas(_orders(tables, segment), tables.lineitem)


def balance_history(tables: Tables, segment: str = SEGMENT) -> DataFrame:
    return balances.balance_history(day_deltas(tables, segment))


def open_orders(tables: Tables, segment: str = SEGMENT, as_of: dt.date = AS_OF) -> DataFrame:
    return balances.open_orders_asof(_orders(tables, segment), tables.lineitem, as_of)


def leaderboard(
    tables: Tables, segment: str = SEGMENT, as_of: dt.date = AS_OF, k: int = K
) -> DataFrame:
    return boards.board(open_orders(tables, segment, as_of), k)


def leaderboard_two_phase(
    tables: Tables, segment: str = SEGMENT, as_of: dt.date = AS_OF, k: int = K, buckets: int = 8
) -> DataFrame:
    return boards.two_phase_board(open_orders(tables, segment, as_of), k, buckets)


def leaderboard_bounded(
    tables: Tables,
    segment: str = SEGMENT,
    head: dt.date = AS_OF,
    k: int = K,
    versions: int = 3,
) -> DataFrame:
    """The board a bounded memory shows: entries up to ``head`` have arrived, the board stands
    one day before."""
    threshold = head - dt.timedelta(days=1)
    known = balances.bounded_balances_asof(day_deltas(tables, segment), head, threshold, versions)
    return boards.board(known, k).drop("event_date")


def _last_day(tables: Tables) -> dt.date | None:
    """The last day of any order or shipment."""
    days = (tables.orders.agg(F.max("o_orderdate")), tables.lineitem.agg(F.max("l_shipdate")))
    return max((d for d in (day.first()[0] for day in days) if d), default=None)


def leaderboard_history(tables: Tables, segment: str = SEGMENT, k: int = K) -> DataFrame:
    """The boards of all month starts up to the last day of any order or shipment; orders with
    lines that have no ship date stay open until then."""
    return boards.monthly_boards(balance_history(tables, segment), until=_last_day(tables), k=k)


def leaderboard_daily(tables: Tables, segment: str = SEGMENT, k: int = K) -> DataFrame:
    """The boards of all days up to the last day of any order or shipment."""
    path = fresh_dir(tables.spark, "balances")
    balance_history(tables, segment).write.parquet(path)
    return boards.daily_boards(tables.spark.read.parquet(path), until=_last_day(tables), k=k)
