"""The streaming reports over stored data: each is one query that runs until it has read everything."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from quayline.operators import boards
from quayline.operators.ledger import ledger_entries
from quayline.operators.orders import orders_of_segment
from quayline.plans.fulfilment import AS_OF
from quayline.plans.shipping_priority import SEGMENT, K
from quayline.sources.ledger import COLUMNS, stream_ledger_text, write_ledger, write_ledger_text
from quayline.sources.tables import Tables
from quayline.storage import fresh_dir
from quayline.streaming import ledger as live, state
from quayline.streaming.enrichment import JOINED, Reach, entry_stream_of_joined, joined_entries, joined_lines, start_joined_lines
from quayline.streaming.monitor import daily_order_stream, daily_segment_stream, start_daily_segment_counts
from quayline.streaming.sources import ended, stream_table
from quayline.streaming.words import latest_counts, start_word_count

# the registered late feed: every so many-th order before this day arrives after all others
LATE_KEYS = 50
LATE_BEFORE = dt.date(1997, 1, 1)
# the given tables ship lines up to seven years before and after their orders
TABLES_REACH = Reach(before=7 * 366, after=7 * 366)


def _segment_ledger(tables: Tables, segment: str, until: dt.date, rounded: bool = False) -> DataFrame:
    orders = orders_of_segment(tables.orders, tables.customer, segment)
    entries = ledger_entries(orders, tables.lineitem, rounded)
    return entries.where(F.col("event_date") <= F.lit(until))


def _stored_ledger(tables: Tables, segment: str, until: dt.date, root: str) -> DataFrame:
    """The segment's ledger as a stream over its stored table."""
    write_ledger(_segment_ledger(tables, segment, until), f"{root}/ledger")
    return stream_table(tables.spark, f"{root}/ledger").select(*COLUMNS)


def leaderboard_of_ledger_stream(tables: Tables, segment: str = SEGMENT, until: dt.date = AS_OF, k: int = K) -> DataFrame:
    """The board after the merged ledger has streamed in up to ``until``.  It stands at the
    last finished day, one day before the newest entry."""
    spark = tables.spark
    root = fresh_dir(spark, "ledger-stream")
    deltas = live.day_delta_stream(live.entry_stream(_stored_ledger(tables, segment, until, root)))
    live.start_day_deltas(deltas, f"{root}/deltas", f"{root}/checkpoint").awaitTermination()
    return boards.board(live.finished_balances(live.read_deltas(spark, f"{root}/deltas")), k)


def leaderboard_of_ledger_text(tables: Tables, segment: str = SEGMENT, until: dt.date = AS_OF, k: int = K) -> DataFrame:
    """The board after the ledger's exchange files (whole cents) have streamed in."""
    spark = tables.spark
    root = fresh_dir(spark, "ledger-text-stream")
    write_ledger_text(_segment_ledger(tables, segment, until, rounded=True), f"{root}/ledger")
    deltas = live.day_delta_stream(live.entry_stream(stream_ledger_text(spark, f"{root}/ledger")))
    live.start_day_deltas(deltas, f"{root}/deltas", f"{root}/checkpoint").awaitTermination()
    return boards.board(live.finished_balances(live.read_deltas(spark, f"{root}/deltas")), k)


def leaderboard_of_refreshes(tables: Tables, segment: str = SEGMENT, until: dt.date = AS_OF, k: int = K) -> DataFrame:
    """The last board a periodically refreshed leaderboard has published, with its day."""
    spark = tables.spark
    root = fresh_dir(spark, "board-refresh")
    deltas = live.day_delta_stream(live.entry_stream(_stored_ledger(tables, segment, until, root)))
    live.start_board_refresh(deltas, f"{root}/out", f"{root}/checkpoint", k).awaitTermination()
    return live.newest_board(spark, f"{root}/out")


def leaderboard_of_versions(
    tables: Tables, segment: str = SEGMENT, head: dt.date = AS_OF, k: int = K, versions: int = 3
) -> DataFrame:
    """The board of orders whose newest ``versions`` balances the stream remembers, after entries
    up to ``head`` have arrived; it stands one day before."""
    spark = tables.spark
    root = fresh_dir(spark, "versions-stream")
    entries = live.entry_stream(_stored_ledger(tables, segment, head, root))
    with state.column_family_store(spark):
        query = live.start_day_deltas(state.balance_changes(entries, versions), f"{root}/changes", f"{root}/checkpoint")
        query.awaitTermination()
    known = live.newest_balances(spark.read.parquet(f"{root}/changes"))
    return boards.board(known, k).drop("event_date")


def _table_streams(tables: Tables, segment: str, until: dt.date) -> tuple[DataFrame, DataFrame]:
    """The segment's orders up to ``until`` and all lines, as streams over their tables."""
    customers = tables.customer.where(F.col("c_mktsegment") == segment).select(F.col("c_custkey").alias("o_custkey"))
    orders = stream_table(tables.spark, f"{tables.path}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = stream_table(tables.spark, f"{tables.path}/lineitem.parquet")
    placed = orders.where(F.col("o_orderdate") <= F.lit(until)).join(customers.hint("merge"), "o_custkey", "left_semi")
    return placed, lines.select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate")


def _joined(tables: Tables, segment: str, until: dt.date, reach: Reach, root: str) -> str:
    """Runs the join of the two streams; where the joined lines are."""
    joined = joined_lines(*_table_streams(tables, segment, until), reach)
    start_joined_lines(joined, f"{root}/joined", f"{root}/checkpoint-join").awaitTermination()
    return f"{root}/joined"


def leaderboard_of_two_streams(
    tables: Tables, segment: str = SEGMENT, until: dt.date = AS_OF, k: int = K, buckets: int = 8, reach: Reach = TABLES_REACH
) -> DataFrame:
    """The same board from separate order and line streams: one query joins them as they arrive, a second
    keeps balances per order and boards per bucket of the key and publishes the merged board.  It
    stands one day before ``until``, where the feed ends."""
    spark = tables.spark
    root = fresh_dir(spark, "two-streams")
    joined = stream_table(spark, _joined(tables, segment, until, reach, root), JOINED)
    entries = entry_stream_of_joined(ended(joined, "order_date", root, until))
    with state.column_family_store(spark):
        best = state.bucket_boards(state.balance_changes(entries), k, buckets)
        live.start_two_phase_board(best, f"{root}/out", f"{root}/checkpoint", k).awaitTermination()
    return live.newest_board(spark, f"{root}/out").drop("as_of")


def enriched_entries_stream(tables: Tables, segment: str = SEGMENT, until: dt.date = AS_OF, reach: Reach = TABLES_REACH) -> DataFrame:
    """Amounts per order, customer and day up to the day before ``until`` from the two streams joined as
    they arrive: deltas that no batch job has prepared."""
    spark = tables.spark
    joined = spark.read.schema(JOINED).parquet(_joined(tables, segment, until, reach, fresh_dir(spark, "enriched")))
    entries = joined_entries(joined).where(F.col("event_date") < F.lit(until))
    return entries.groupBy("order_key", "cust_key", "event_date").agg(F.sum("amount").alias("amount"))


def corrected_deltas_stream(
    tables: Tables, segment: str = SEGMENT, until: dt.date = AS_OF, keys: int = LATE_KEYS, before: dt.date = LATE_BEFORE
) -> DataFrame:
    """Day deltas when the entries before ``before`` of every ``keys``-th order are delivered after all
    others, to one running query whose watermark has passed their days: they come out as
    corrections (``corrected``) and the merged deltas are exact."""
    spark = tables.spark
    root = fresh_dir(spark, "corrected")
    ledger = _segment_ledger(tables, segment, until)
    late = (F.col("order_key") % keys == 0) & (F.col("event_date") < F.lit(before))
    write_ledger(ledger.where(~late), f"{root}/ledger")
    entries = live.entry_stream(stream_table(spark, f"{root}/ledger").select(*COLUMNS))
    with state.column_family_store(spark):
        query = live.start_day_deltas(
            state.corrected_deltas(entries), f"{root}/deltas", f"{root}/checkpoint", processingTime="0 seconds"
        )
    try:
        query.processAllAvailable()
        write_ledger(ledger.where(late), f"{root}/ledger", mode="append")
        query.processAllAvailable()
    finally:
        query.stop()
    return live.merged_deltas(spark.read.parquet(f"{root}/deltas")).drop("order_date")


def daily_segment_orders_stream(tables: Tables) -> DataFrame:
    """Order counts per segment of all days: the feed is finite, so its end closes the newest."""
    spark = tables.spark
    root = fresh_dir(spark, "segment-stream")
    feed = stream_table(spark, f"{tables.path}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate")
    counts = daily_segment_stream(ended(feed, "o_orderdate", root), tables.customer)
    start_daily_segment_counts(counts, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{root}/counts")


def late_orders_stream(tables: Tables, keys: int = LATE_KEYS, before: dt.date = LATE_BEFORE) -> DataFrame:
    """Orders per day when every ``keys``-th order from before ``before`` is delivered after all
    others: the watermark has passed their days, so they are dropped.  ``late_dropped`` says
    that the stream has reported so."""
    spark = tables.spark
    root = fresh_dir(spark, "late-stream")
    orders = tables.orders.select("o_orderkey", "o_orderdate")
    is_late = (F.col("o_orderkey") % keys == 0) & (F.col("o_orderdate") < F.lit(before))
    orders.where(~is_late).write.parquet(f"{root}/orders")
    feed = ended(stream_table(spark, f"{root}/orders", orders.schema), "o_orderdate", root)
    query = start_daily_segment_counts(
        daily_order_stream(feed), f"{root}/counts", f"{root}/checkpoint", processingTime="0 seconds"
    )
    try:
        query.processAllAvailable()
        orders.where(is_late).write.mode("append").parquet(f"{root}/orders")
        query.processAllAvailable()
        dropped = sum(s.numRowsDroppedByWatermark for p in query.recentProgress for s in p.stateOperators)
    finally:
        query.stop()
    return spark.read.parquet(f"{root}/counts").withColumn("late_dropped", F.lit(dropped > 0))


def word_count_stream(tables: Tables, max_files: int = 100) -> DataFrame:
    """Word counts of the documents after the stream has read them all, some files at a time."""
    spark = tables.spark
    root = fresh_dir(spark, "word-stream")
    lines = stream_table(spark, f"{tables.path}/documents.parquet", max_files=max_files).select("text")
    start_word_count(lines, f"{root}/counts", f"{root}/checkpoint").awaitTermination()
    return latest_counts(spark, f"{root}/counts")
