"""Leaderboards of open balances (order_key, balance, order_date)."""

from __future__ import annotations

import datetime as dt
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from quayline.functions.dates import month_start_on_or_after
from quayline.functions.money import EXACT
from quayline.operators.balances import CLOSED, is_open


def best_first() -> tuple[Column, Column]:
    return F.desc("balance"), F.asc("order_key")


def best_per(group: str) -> Window:
    """Best first within a group.  ``size``, the balance as DOUBLE, leads the order: it agrees
    with the balance and settles nearly every comparison of the sort without 38-digit decimals."""
    return Window.partitionBy(group).orderBy(F.desc("size"), *best_first())


def with_rank(top: DataFrame, *order: Column) -> DataFrame:
    """Position 1..k of the rows of an already limited result (k rows, one partition)."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("bigint"))


def board(balances: DataFrame, k: int = 10) -> DataFrame:
    """The k largest open balances.  Each task keeps its own best k rows and only those meet,
    so nothing is gathered but k rows per task."""
    return with_rank(balances.where(is_open()).orderBy(*best_first()).limit(k), *best_first())


def two_phase_board(balances: DataFrame, k: int = 10, buckets: int = 8) -> DataFrame:
    """The same board with the local phase spelled out: best k per bucket of the order key,
    then best k of those.  The rank filter becomes a limit per bucket in front of the shuffle,
    so a bucket's task receives k rows from each upstream task, not the bucket."""
    candidates = (
        balances.where(is_open())
        .withColumn("bucket", F.pmod("order_key", F.lit(buckets)))
        .withColumn("size", F.col("balance").cast("double"))
        .withColumn("local_rank", F.row_number().over(best_per("bucket")))
        .where(F.col("local_rank") <= k)
        .drop("bucket", "size", "local_rank")
    )
    return with_rank(candidates.orderBy(*best_first()).limit(k), *best_first())


def monthly_boards(history: DataFrame, until: dt.date | None, k: int = 10) -> DataFrame:
    """The board of the first day of every month, in one job.

    ``history`` is a balance history; each open balance is repeated for the month starts it
    covers (an equality on the date then does what a range join would), and the best k per
    date are kept, again in front of the shuffle.  Balances without a next date hold through
    ``until``; in a complete ledger, where every order ends at zero, there are none and
    ``until`` is None.
    """
    first = month_start_on_or_after(F.col("event_date"))
    last = F.date_sub("next_date", 1)
    if until is not None:
        last = F.least(F.coalesce(last, F.lit(until)), F.lit(until))
    covered = F.when(first <= last, F.sequence(first, last, F.expr("INTERVAL 1 MONTH")))
    return (
        history.where(is_open())
        .withColumn("size", F.col("balance").cast("double"))
        .select("order_key", "order_date", "balance", "size", F.explode(covered).alias("snapshot_date"))
        .withColumn("place", F.row_number().over(best_per("snapshot_date")))
        .where(F.col("place") <= k)
        .withColumn("rank", F.col("place").cast("bigint"))
        .drop("size", "place")
    )


# days in a block of floors
BLOCK_DAYS = 32


def _held_open(history: DataFrame, until: dt.date | None) -> DataFrame:
    """Open balances with the first and the last day they hold (``event_date``, ``last``)."""
    last = F.date_sub("next_date", 1)
    if until is not None:
        last = F.least(F.coalesce(last, F.lit(until)), F.lit(until))
    rows = history.where(is_open()).select("order_key", "order_date", "balance", "event_date", last.alias("last"))
    return rows.where("last >= event_date")


def daily_floors(held: DataFrame, k: int) -> DataFrame:
    """``day, floor``: a balance that the k-th of the day's board is not below, for days that have one.

    Taken from a pilot, the ``k`` highest balances that begin in each month: the k-th best of some orders is
    never above the k-th best of all.  The pilot's rows follow the calendar, not the orders."""
    month = held.withColumns({"month": F.trunc("event_date", "month"), "size": F.col("balance").cast("double")})
    pilot = month.withColumn("place", F.row_number().over(best_per("month"))).where(F.col("place") <= k)
    days = pilot.select("order_key", "balance", "size", F.explode(F.sequence("event_date", "last")).alias("day"))
    kth = days.withColumn("place", F.row_number().over(best_per("day"))).where(F.col("place") == k)
    return kth.select("day", F.col("balance").alias("floor"))


def _array(values: list[str]) -> Column:
    """Amounts as a constant column."""
    return F.from_json(F.lit(json.dumps(values)), f"array<{EXACT}>")


def near_daily_boards(history: DataFrame, until: dt.date | None, k: int = 10) -> DataFrame:
    """``order_key, order_date, balance, size, snapshot_date``: each open balance on the days on which it is not
    below the day's floor, among them all that are on a board.

    Floors, one amount a day, go through the driver: the calendar bounds them.  On days on which none is known
    all that is open stays.  ``history`` is read three times; store it first."""
    held = _held_open(history, until)
    first, final = held.agg(F.min("event_date"), F.max("last")).first()
    known = {r["day"]: r["floor"] for r in daily_floors(held, k).collect()}
    days = [known.get(first + dt.timedelta(days=i), CLOSED) for i in range((final - first).days + 1)] if first else [CLOSED]
    # the lowest floor of the blocks that a balance spans settles most of them at once
    blocks = [min(days[i : i + BLOCK_DAYS]) for i in range(0, len(days), BLOCK_DAYS)]
    floors, lowest = _array([str(v) for v in days]), _array([str(v) for v in blocks])
    origin = F.lit(first).cast("date")
    start, stop = F.datediff("event_date", origin), F.datediff("last", origin)
    block = F.floor(start / BLOCK_DAYS).cast("int")
    span = F.slice(lowest, block + 1, F.floor(stop / BLOCK_DAYS).cast("int") - block + 1)
    near = F.filter(F.sequence(start, stop), lambda d: F.element_at(floors, d + 1) <= F.col("balance"))
    picked = held.where(F.col("balance") >= F.array_min(span)).select(
        "order_key", "order_date", "balance", F.col("balance").cast("double").alias("size"), F.explode(near).alias("d")
    )
    return picked.withColumn("snapshot_date", F.date_add(origin, F.col("d"))).drop("d")


def daily_boards(history: DataFrame, until: dt.date | None, k: int = 10) -> DataFrame:
    """The board of every day from the first to the last on which an order is open, in one job.  What is ranked
    are the orders near the boards, not the open orders of every day."""
    ranked = near_daily_boards(history, until, k).withColumn("place", F.row_number().over(best_per("snapshot_date")))
    return ranked.where(F.col("place") <= k).withColumn("rank", F.col("place").cast("bigint")).drop("size", "place")
