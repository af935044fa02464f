"""Orders and lines joined while both arrive, so that no table has to be made beforehand.

A line carries neither its order's date nor its customer, and an order does not carry its revenue.  The
stream-stream join gives each line its order; the pair is two ledger entries, the line's share of the
order's revenue on the order's day and the line's shipment on its own.  An order's total is the
sum of those shares, whichever of the two arrived first.

Both sides have a watermark and a line's ship date lies within a stated reach of the order's date,
so Spark forgets orders and lines that can meet no partner any more.

A pair can come as late as the reach allows, and an operator behind the join in the same query would
have to wait that long.  So the pairs are a table of their own, which a second query reads: it goes
by the days of the orders it has seen, and a pair that comes later corrects what is published.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quayline.functions.money import EXACT, line_revenue
from quayline.streaming.sources import EVENT_TIME, with_event_time


JOINED = "order_key BIGINT, cust_key BIGINT, order_date DATE, ship_date DATE, revenue DECIMAL(38,4)"


@dataclass(frozen=True)
class Reach:
    """How many days before and after its order's date a line may ship.  The default is the benchmark's
    rule; pairs beyond it do not join."""

    before: int = 0
    after: int = 121


def joined_lines(orders: DataFrame, lines: DataFrame, reach: Reach = Reach(), delay: str = "0 seconds") -> DataFrame:
    """A stream of lines with their orders: ``order_key, cust_key, order_date, ship_date, revenue``.

    Lines without an order, without a ship date or beyond the reach do not appear.  Rows later than
    ``delay`` behind the slower stream are dropped and counted in the query's progress."""
    placed = with_event_time(orders, "o_orderdate", delay).select(
        F.col("o_orderkey").alias("order_key"), F.col("o_custkey").alias("cust_key"), F.col("o_orderdate").alias("order_date"),
        F.col(EVENT_TIME).alias("placed_at"),
    )
    shipped = with_event_time(lines, "l_shipdate", delay).select(
        F.col("l_orderkey").alias("line_key"), F.col("l_shipdate").alias("ship_date"), line_revenue().alias("revenue"),
        F.col(EVENT_TIME).alias("shipped_at"),
    )
    meets = (
        (F.col("order_key") == F.col("line_key"))
        & (F.col("shipped_at") >= F.col("placed_at") - F.expr(f"INTERVAL {reach.before} DAYS"))
        & (F.col("shipped_at") <= F.col("placed_at") + F.expr(f"INTERVAL {reach.after} DAYS"))
    )
    return placed.join(shipped, meets).select("order_key", "cust_key", "order_date", "ship_date", "revenue")


def start_joined_lines(joined: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends joined lines to a Parquet folder as soon as both sides are there, exactly once."""
    return (
        joined.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def joined_entries(joined: DataFrame) -> DataFrame:
    """The ledger entries of joined lines, of a table or a stream: ``order_key, cust_key, amount, event_date,
    is_order``; an order's revenue comes in as many parts as it has lines."""

    def entry(day: str, amount: Column, is_order: bool) -> Column:
        return F.struct(amount.cast(EXACT).alias("amount"), F.col(day).alias("event_date"), F.lit(is_order).alias("is_order"))

    parts = F.array(entry("order_date", F.col("revenue"), True), entry("ship_date", -F.col("revenue"), False))
    return joined.select("order_key", "cust_key", F.inline(parts))


def entry_stream_of_joined(joined: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """``joined_entries`` of a stream of joined lines whose watermark follows the orders' days, for
    the processors of ``streaming.state``."""
    return joined_entries(with_event_time(joined, "order_date", delay))
