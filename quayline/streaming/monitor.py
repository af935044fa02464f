"""Live order counts per market segment and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from quayline.functions.dates import event_time_to_day
from quayline.streaming.sources import EVENT_TIME, with_event_time


def daily_segment_stream(orders: DataFrame, customer: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """New orders per one-day window and segment, emitted when the day is final.

    Orders are counted per customer and day before they meet the static customer table, so a
    customer with a large share of the orders is one row per day in that join (a stateful
    stream has no adaptive skew handling).  The second count adds these up in the same window.
    The table is never collected: a stream's plan would broadcast it by the size of its compressed file.
    """
    per_customer = (
        with_event_time(orders, "o_orderdate", delay)
        .groupBy(F.window(EVENT_TIME, "1 day").alias("day"), "o_custkey")
        .agg(F.count("*").alias("n"))
    )
    segments = customer.select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return (
        per_customer.join(segments.hint("merge"), "o_custkey")
        .groupBy(F.window("day", "1 day").alias("day"), "c_mktsegment")
        .agg(F.sum("n").alias("order_count"))
        .select("c_mktsegment", event_time_to_day("day.start").alias("o_orderdate"), "order_count")
    )


def daily_order_stream(orders: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """New orders per one-day window, emitted when the day is final."""
    return (
        with_event_time(orders, "o_orderdate", delay)
        .groupBy(F.window(EVENT_TIME, "1 day").alias("day"))
        .agg(F.count("*").alias("order_count"))
        .select(event_time_to_day("day.start").alias("o_orderdate"), "order_count")
    )


def start_daily_segment_counts(
    counts: DataFrame, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    return (
        counts.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )
