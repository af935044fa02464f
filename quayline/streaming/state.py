"""Keyed state with event-time timers: what is remembered of each order inside a stream.

Two processors read ledger entries per order.  ``DayDeltas`` adds up the open days of an order,
publishes each when the watermark has passed it and publishes what arrives later as a correction.
``Balances`` remembers an order's newest balances and publishes the one that holds as of the watermark
whenever it changes.  A third, ``BucketBoards``, keeps the open orders of a bucket of keys and
publishes the bucket's best.

A request to the state store costs far more than what it asks for, so orders with neighbouring keys are kept
together: a request serves a block of keys, and an order with a key far from all others has its own.

Rows behind the watermark reach the processors because the entries come without their event-time
column: the watermark is tracked above, but Spark has no column to filter by.  Days are numbers of days since
1970 in here.  The state store must support column families (``column_family_store``).
"""

from __future__ import annotations

import sys
from bisect import bisect_left, bisect_right
from collections.abc import Generator, Iterator
from contextlib import contextmanager
from decimal import Decimal
from heapq import nsmallest
from itertools import chain, islice

from pyspark import cloudpickle
from pyspark.sql import DataFrame, GroupedData, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor

DAY_MS = 86_400_000
# fixed value: balances up to one cent count as closed
CLOSED = Decimal("0.01")
# order keys whose orders are one value of the state: each request to the state store serves all of them
BLOCK_KEYS = 256
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"

# processors travel with their code: workers need not have the library
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@contextmanager
def column_family_store(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB, which these processors need; the
    session's setting is restored afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS_DB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def final_day(timers) -> int:
    """The last day that the watermark has passed."""
    return max(timers.getCurrentWatermarkInMs(), 0) // DAY_MS - 1


def order_rows(entries: DataFrame) -> GroupedData:
    """Entries with a watermark (``order_key, event_date, amount, is_order``) as the processors read
    them, grouped by block of order keys."""
    amount = F.col("amount").cast("decimal(38,4)").alias("amount")
    block = F.expr(f"order_key DIV {BLOCK_KEYS}").alias("block")
    # without the event-time column, by which Spark would drop late rows
    return entries.select(block, "order_key", F.unix_date("event_date").alias("day"), amount, "is_order").groupBy("block")


def _split(flat: list, lengths: list[int]) -> Iterator[list]:
    """The lists that stand end to end in ``flat``."""
    rest = iter(flat)
    return (list(islice(rest, n)) for n in lengths)


class _OrderProcessor(StatefulProcessor):
    """The orders of a block are one state value, with one timer: the end of the earliest open day.

    ``load`` and ``store`` turn that value into the orders and back, ``changed`` brings one order up to date
    and ``next_open`` is its earliest open day."""

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("orders", self.STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        arrived: dict[int, dict[int, list]] = {}
        for _, order, day, amount, is_order in rows:
            by_day = arrived.setdefault(order, {})
            if day in by_day:
                held = by_day[day]
                held[0] += amount
                held[1] |= is_order
            else:
                by_day[day] = [Decimal(0) + amount, is_order]
        yield from self._update(arrived, timerValues, 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self._update(None, timerValues, 1)

    def _update(self, arrived, timers, step) -> Iterator[Row]:
        final = final_day(timers)
        orders = self.load(self.state.get()) if self.state.exists() else {}
        before = self._earliest(orders)
        if arrived is None:
            waits = {order: self.next_open(held) for order, held in orders.items()}
            arrived = {order: {} for order, day in waits.items() if day is not None and day <= final}
        seen = timers.getCurrentProcessingTimeInMs() * 2 + step
        for order, by_day in arrived.items():
            held = yield from self.changed(order, orders.pop(order, None), by_day, final, seen)
            if held is not None:
                orders[order] = held
        if arrived:
            if orders:
                self.state.update(self.store(orders))
            else:
                self.state.clear()
        after = self._earliest(orders)
        # timers that have fired are gone, so after one the next is always set
        if after is not None and (step or after != before):
            self.handle.registerTimer((after + 1) * DAY_MS - 1)

    def _earliest(self, orders) -> int | None:
        return min((day for day in map(self.next_open, orders.values()) if day is not None), default=None)

    def close(self) -> None:
        pass


class DayDeltas(_OrderProcessor):
    """Publishes ``order_key, order_day, event_day, amount, late``: each day once when it is final, and
    what arrives for a final day at once as a further row with ``late``.  The state holds open days only."""

    STATE = """orders array<bigint>, lengths array<int>, days array<int>, amounts array<decimal(38,4)>,
        placed array<boolean>"""
    OUT = "order_key bigint, order_day int, event_day int, amount decimal(38,4), late boolean"

    @staticmethod
    def load(value) -> dict[int, dict[int, list]]:
        keys, lengths, *columns = value
        held = _split([[day, [amount, placed]] for day, amount, placed in zip(*columns)], lengths)
        return {key: dict(days) for key, days in zip(keys, held)}

    @staticmethod
    def store(orders) -> tuple:
        flat = [(day, *open_days[day]) for open_days in orders.values() for day in sorted(open_days)]
        return list(orders), [len(open_days) for open_days in orders.values()], *map(list, zip(*flat))

    @staticmethod
    def next_open(open_days) -> int:
        return min(open_days)

    def changed(self, key, open_days, by_day, final, seen) -> Generator[Row, None, dict | None]:
        open_days = open_days or {}
        for day, (amount, placed) in by_day.items():
            if day <= final:
                yield self._row(key, day, amount, placed, True)
                continue
            held = open_days.setdefault(day, [Decimal(0), False])
            held[0] += amount
            held[1] |= placed
        for day in sorted(d for d in open_days if d <= final):
            yield self._row(key, day, *open_days.pop(day), False)
        return open_days or None

    @staticmethod
    def _row(key, day, amount, placed, late) -> Row:
        return Row(order_key=key, order_day=day if placed else None, event_day=day, amount=amount, late=late)


class Balances(_OrderProcessor):
    """Publishes ``order_key, order_day, event_day, balance, as_of, seen`` whenever the balance that holds
    as of the last final day changes: the newest remembered one up to that day, null when all that is
    remembered is newer.

    ``versions`` is how many days of an order are remembered; without it all open days and the one
    that holds.  A late entry is added to its day and all newer ones, so balances are exact by event date.  An order
    that has come to nothing is forgotten.  ``seen`` orders the rows of one order."""

    STATE = """orders array<bigint>, lengths array<int>, days array<int>, balances array<decimal(38,4)>, placed array<int>,
        older array<boolean>, shown_day array<int>, shown array<decimal(38,4)>, next_open array<int>"""
    OUT = "order_key bigint, order_day int, event_day int, balance decimal(38,4), as_of int, seen bigint"

    def __init__(self, versions: int | None = None):
        self.versions = versions

    @staticmethod
    def load(value) -> dict[int, tuple]:
        keys, lengths, days, balances, *others = value
        return dict(zip(keys, zip(_split(days, lengths), _split(balances, lengths), *others)))

    @staticmethod
    def store(orders) -> tuple:
        days, balances, *others = map(list, zip(*orders.values()))
        return list(orders), list(map(len, days)), list(chain(*days)), list(chain(*balances)), *others

    @staticmethod
    def next_open(held) -> int | None:
        return held[-1]

    def changed(self, key, held, by_day, final, seen) -> Generator[Row, None, tuple | None]:
        days, balances, placed, older, shown_day, shown, _ = held or ([], [], None, False, None, None, None)
        for day, (amount, is_order) in by_day.items():
            at = bisect_left(days, day)
            if is_order:
                placed = day if placed is None else max(placed, day)
            if not (at < len(days) and days[at] == day) and (at or not older):
                days.insert(at, day)
                balances.insert(at, balances[at - 1] if at else Decimal(0))
            for i in range(at, len(days)):
                balances[i] += amount
        holds = bisect_right(days, final)  # the balance before this place holds
        first = len(days) - self.versions if self.versions else holds - 1
        if first > 0:
            del days[:first], balances[:first]
            older, holds = True, max(holds - first, 0)
        day, balance = (days[holds - 1], balances[holds - 1]) if holds else (None, None)
        if (day, balance) != (shown_day, shown):
            order_day = placed if placed is not None and placed <= final else None
            yield Row(order_key=key, order_day=order_day, event_day=day, balance=balance, as_of=final, seen=seen)
        if holds == len(days) and not balance:
            return None
        return days, balances, placed, older, day, balance, days[holds] if holds < len(days) else None


class BucketBoards(StatefulProcessor):
    """Keeps a bucket's open orders and publishes its best ``k`` whenever they change: ``bucket, place,
    order_key, order_day, balance, as_of, seen``; a single row without an order when none is open.

    The best are kept beside the orders, so that the bucket is read through only when one of them has
    fallen.  Of the rows of a micro-batch, one an order, some are held in memory at a time."""

    OUT = "bucket int, place int, order_key bigint, order_day int, balance decimal(38,4), as_of int, seen bigint"

    def __init__(self, k: int, buckets: int = 1, at_once: int = 50_000):
        self.k, self.span, self.at_once = k, BLOCK_KEYS * buckets, at_once

    def init(self, handle) -> None:
        # the open orders of a block of keys are one value
        self.open_orders = handle.getMapState("open", "block bigint", "keys array<bigint>, balances array<decimal(38,4)>, days array<int>")
        self.board = handle.getValueState("board", "keys array<bigint>, balances array<decimal(38,4)>, days array<int>")

    def _best(self, orders) -> list[tuple]:
        return nsmallest(self.k, orders, key=lambda r: (-r[1], r[0]))

    def _keep(self, newest: dict[int, tuple]) -> None:
        """Brings the blocks of some orders up to date; ``newest`` has no balance for closed ones."""
        blocks: dict[int, list] = {}
        for order in newest:
            blocks.setdefault(order // self.span, []).append(order)
        for block, orders in blocks.items():
            was = self.open_orders.getValue((block,))
            held = {order: values for order, *values in zip(*was)} if was else {}
            for order in orders:
                balance, day, _ = newest[order]
                held.pop(order, None)
                if balance is not None:
                    held[order] = balance, day
            if held:
                balances, days = map(list, zip(*held.values()))
                self.open_orders.updateValue((block,), (list(held), balances, days))
            elif was:
                self.open_orders.removeKey((block,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        as_of = seen = -1
        shown = [tuple(r) for r in zip(*self.board.get())] if self.board.exists() else []
        best = {order: (balance, day) for order, balance, day in shown}
        # with fewer than k on the board, all open orders are on it
        others, fallen, rows = len(best) == self.k, False, iter(rows)
        while part := list(islice(rows, self.at_once)):
            newest: dict[int, tuple] = {}
            for order, order_day, _, balance, row_as_of, row_seen, _ in part:
                as_of, seen = max(as_of, row_as_of), max(seen, row_seen)
                if order not in newest or newest[order][2] < row_seen:
                    closed = balance is None or order_day is None or balance <= CLOSED
                    newest[order] = (None if closed else balance, order_day, row_seen)
            self._keep(newest)
            for order, (balance, day, _) in newest.items():
                was = best.pop(order, None)
                fallen |= was is not None and (balance is None or balance < was[0])
                if balance is not None:
                    best[order] = balance, day
            others |= len(best) > self.k
            best = {order: held for order, *held in self._best((order, *held) for order, held in best.items())}
        if fallen and others:
            stored = (order for _, columns in self.open_orders.iterator() for order in zip(*columns))
            top = self._best(stored)
        else:
            top = [(order, *held) for order, held in best.items()]
        if top == shown:
            return
        if top:
            self.board.update(tuple(list(column) for column in zip(*top)))
        else:
            self.board.clear()
        for place, (order, balance, day) in enumerate(top or [(None, None, None)], 1):
            yield Row(bucket=key[0], place=place, order_key=order, order_day=day, balance=balance, as_of=as_of, seen=seen)

    def close(self) -> None:
        pass


def corrected_deltas(entries: DataFrame) -> DataFrame:
    """A stream of finished day deltas and corrections (``order_key, order_date, event_date, amount,
    late``); the sum per order and day is exact whenever entries arrive."""
    rows = order_rows(entries).transformWithState(DayDeltas(), DayDeltas.OUT, "Append", "EventTime")
    return rows.select(
        "order_key", F.date_from_unix_date("order_day").alias("order_date"), F.date_from_unix_date("event_day").alias("event_date"), "amount", "late"
    )


def balance_changes(entries: DataFrame, versions: int | None = None) -> DataFrame:
    """A stream of the balances that hold as of the watermark, one row per change."""
    return order_rows(entries).transformWithState(Balances(versions), Balances.OUT, "Append", "EventTime")


def bucket_boards(changes: DataFrame, k: int, buckets: int) -> DataFrame:
    """A stream of the best ``k`` open orders of each bucket of order keys, one set of rows per change."""
    dealt = changes.withColumn("bucket", F.pmod("order_key", F.lit(buckets)).cast("int"))
    return dealt.groupBy("bucket").transformWithState(BucketBoards(k, buckets), BucketBoards.OUT, "Append", "None")
