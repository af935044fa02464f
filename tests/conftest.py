from __future__ import annotations

import datetime as dt
import os
import random
import sys
from decimal import Decimal

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from quayline.session import local_session  # noqa: E402

CUSTOMER = "c_custkey BIGINT, c_mktsegment STRING"
ORDERS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderdate DATE, o_shippriority INT, o_totalprice DOUBLE"
LINES = (
    "l_orderkey BIGINT, l_linenumber INT, l_extendedprice DOUBLE, l_discount DOUBLE, l_shipdate DATE"
)


def day(text: str) -> dt.date:
    return dt.date.fromisoformat(text)


class Frames:
    """Small tables from tuples: customers (key, segment), orders (key, customer, date), lines
    (order, price, discount, date)."""

    def __init__(self, spark, customers, orders, lines):
        self.spark = spark
        self.rows = customers, orders, lines
        self.customer = spark.createDataFrame(customers, CUSTOMER)
        self.orders = spark.createDataFrame([(k, c, day(d), 0, 100.0) for k, c, d in orders], ORDERS)
        self.lineitem = spark.createDataFrame(
            [(k, i, float(p), float(x), day(d)) for i, (k, p, x, d) in enumerate(lines)], LINES
        )

    def entries(self, segment=None):
        """The ledger by hand: (order, day, amount, is_order)."""
        customers, orders, lines = self.rows
        segments = dict(customers)
        wanted = {k: d for k, c, d in orders if segment is None or segments.get(c) == segment}
        result = []
        for key, placed in wanted.items():
            own = [revenue(p, x) for k, p, x, _ in lines if k == key]
            result.append((key, day(placed), sum(own, Decimal(0)), True))
        for key, price, discount, shipped in lines:
            if key in wanted:
                result.append((key, day(shipped), -revenue(price, discount), False))
        return result


def revenue(price, discount) -> Decimal:
    return Decimal(str(price)) * (1 - Decimal(str(discount)))


def balances_by_hand(entries, as_of):
    sums = {}
    for key, when, amount, _ in entries:
        if when <= as_of:
            sums[key] = sums.get(key, Decimal(0)) + amount
    return sums


def open_by_hand(entries, as_of):
    return {k: b for k, b in balances_by_hand(entries, as_of).items() if b > Decimal("0.01")}


def random_frames(spark, seed, orders=60, lines=240, days=200, hot=False):
    """Random tables; ``hot`` gives one order a third of the lines and one customer a third of
    the orders."""
    rng = random.Random(seed)
    first = dt.date(1995, 1, 1)

    def any_day():
        return (first + dt.timedelta(days=rng.randrange(days))).isoformat()

    customers = [(c, rng.choice(["BUILDING", "MACHINERY"])) for c in range(1, 11)]
    customers[0] = (1, "BUILDING")
    placed = [
        (k, 1 if hot and k % 3 == 0 else rng.randrange(1, 13), any_day()) for k in range(1, orders + 1)
    ]
    placed[0] = (1, 1, placed[0][2])
    shipped = [
        (
            1 if hot and i % 3 == 0 else rng.randrange(1, orders + 6),
            rng.randrange(100, 9_999_999) / 100,
            rng.randrange(0, 11) / 100,
            any_day(),
        )
        for i in range(lines)
    ]
    return Frames(spark, customers, placed, shipped)


@pytest.fixture(scope="session")
def spark():
    # four shuffle partitions: enough to tell a partition-wise result from a global one
    return local_session(4, memory="4g")


@pytest.fixture
def frames(spark):
    return lambda customers, orders, lines: Frames(spark, customers, orders, lines)
