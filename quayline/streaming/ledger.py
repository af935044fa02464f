"""From a stream of ledger entries to finished day deltas and boards.

A day of an order is final once the watermark has passed it; only then does its sum leave the
state.  The state therefore holds the open days, not the orders, and the finished deltas in
the sink give the board as of the last finished day, which is the day before the newest one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quayline.functions.dates import event_time_to_day
from quayline.functions.money import EXACT, line_revenue
from quayline.operators import boards
from quayline.operators.balances import is_open
from quayline.storage import folders, remove
from quayline.streaming import state
from quayline.streaming.folding import Folds
from quayline.streaming.sources import EVENT_TIME, with_event_time

DELTAS = "order_key BIGINT, order_date DATE, event_date DATE, amount DECIMAL(38,4)"
OPENING = "order_key BIGINT, order_date DATE, amount DECIMAL(38,4)"


def entry_stream(ledger: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Event time for a stream of stored ledger entries."""
    entries = ledger.select("order_key", "amount", "event_date", "is_order")
    return with_event_time(entries, "event_date", delay)


def union_stream(orders: DataFrame, lines: DataFrame, delay: str = "0 seconds") -> DataFrame:
    """Ledger entries from an order stream and a line stream; order entries have no amount yet
    (see ``add_order_amounts``).  Each stream has its own watermark and the slower one counts,
    so neither can make the other's rows late."""
    placed = with_event_time(orders, "o_orderdate", delay).select(
        F.col("o_orderkey").alias("order_key"),
        F.col("o_orderdate").alias("event_date"),
        EVENT_TIME,
        F.lit(0).cast(EXACT).alias("amount"),
        F.lit(True).alias("is_order"),
    )
    shipped = with_event_time(lines, "l_shipdate", delay).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_shipdate").alias("event_date"),
        EVENT_TIME,
        (-line_revenue()).alias("amount"),
        F.lit(False).alias("is_order"),
    )
    return placed.unionByName(shipped)


def day_delta_stream(entries: DataFrame) -> DataFrame:
    """Sum per order and day, emitted once when the day is final."""
    return (
        entries.groupBy(F.window(EVENT_TIME, "1 day").alias("day"), "order_key")
        .agg(
            F.sum("amount").cast(EXACT).alias("amount"),
            F.max(F.when(F.col("is_order"), F.col("event_date"))).alias("order_date"),
        )
        .select("order_key", "order_date", event_time_to_day("day.start").alias("event_date"), "amount")
    )


def add_order_amounts(deltas: DataFrame, order_book: DataFrame) -> DataFrame:
    """Finished deltas of ``union_stream`` with the amounts of the orders placed that day.

    ``order_book`` is a static table (order_key, revenue) of the wanted orders; the others
    drop out.  It grows with the data, so it is joined rather than broadcast by hand, and only
    after the deltas are summed: a stateful stream has no adaptive skew handling, but here an
    order is one row per day however many lines it has.
    """
    book = order_book.select("order_key", "revenue")
    amount = F.col("amount") + F.when(F.col("order_date").isNotNull(), F.col("revenue")).otherwise(0)
    return (
        deltas.join(book, "order_key")
        .withColumn("amount", amount.cast(EXACT))
        .select("order_key", "order_date", "event_date", "amount")
    )


def start_day_deltas(deltas: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends finished deltas to a Parquet folder, exactly once.  ``trigger`` as in
    ``DataStreamWriter.trigger``; default: everything available, then stop."""
    return (
        deltas.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start(path)
    )


def finished_balances(deltas: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Balance and order date per order from finished deltas, on top of an opening balance."""
    rows = deltas.select("order_key", "order_date", "amount")
    if opening is not None:
        rows = rows.unionByName(opening.select("order_key", "order_date", "amount"))
    return rows.groupBy("order_key").agg(
        F.sum("amount").cast(EXACT).alias("balance"), F.max("order_date").alias("order_date")
    )


def opening_balances(deltas: DataFrame, opening: DataFrame | None = None) -> DataFrame:
    """Deltas folded into one row per order that can still matter, to stand in for them.

    Orders that are placed and have shipped everything drop out, so the rows are the open
    orders (and those with lines shipped ahead of the order), not the history.  An entry that
    comes after its order was closed (a credit, a rounding) therefore makes a row without an
    order date, which no board shows; it stays until an order entry with its key arrives.
    """
    return (
        finished_balances(deltas, opening)
        .where(F.col("order_date").isNull() | is_open())
        .select("order_key", "order_date", F.col("balance").alias("amount"))
    )


def publish_board(top: DataFrame, path: str, number: int, keep: int | None = 2) -> None:
    """Writes the board after batch ``number`` to ``board/batch=n``; a repeated batch rewrites its own.
    Of all boards the newest ``keep`` stay, or all."""
    spark = top.sparkSession
    top.write.mode("overwrite").parquet(f"{path}/board/batch={number}")
    if keep is None:
        return
    older = sorted(int(name.partition("=")[2]) for name in folders(spark, f"{path}/board"))
    for batch_number in [n for n in older if n < number][: -(keep - 1) or None]:
        remove(spark, f"{path}/board/batch={batch_number}")


def _start_in_batches(rows: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: dict) -> StreamingQuery:
    return (
        rows.writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(each)
        .start()
    )


def start_board_refresh(
    deltas: DataFrame, path: str, checkpoint: str, k: int = 10, every: int = 20, keep: int | None = 2, **trigger
) -> StreamingQuery:
    """The live leaderboard: with every micro-batch the board as of the last finished day.

    Below ``path``, ``opening`` holds the opening balances of every ``every``-th batch and the
    deltas since, ``board/batch=n`` the board after batch n, of which the newest ``keep`` are kept.
    A refresh therefore reads the open orders and a few batches rather than the history and
    writes its own deltas only, except for the batch that folds them.  A repeated batch
    rewrites its own folders.  A batch that finishes no day brings no new board.  Pass
    ``processingTime="5 seconds"`` for a periodic refresh; started again on the same ``path`` and
    ``checkpoint`` it goes on where it was stopped or killed.
    """
    opening = Folds(f"{path}/opening", OPENING, every)

    def refresh(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            as_of = batch.agg(F.max("event_date")).first()[0]
            opening.add(batch.select("order_key", "order_date", "amount"), number, opening_balances)
        finally:
            batch.unpersist()
        if as_of is None:
            return
        rows = opening.before(spark, number + 1)
        placed = opening_balances(rows).where(F.col("order_date").isNotNull())
        top = boards.board(placed.withColumnRenamed("amount", "balance"), k)
        publish_board(top.withColumn("as_of", F.lit(as_of)), path, number, keep)

    return _start_in_batches(deltas, refresh, checkpoint, trigger)


def newest_bucket_boards(rows: DataFrame) -> DataFrame:
    """Of each bucket the rows of its last publication."""
    last = rows.groupBy("bucket").agg(F.max("seen").alias("seen"))
    return rows.join(last, ["bucket", "seen"]).select(*rows.columns)


def start_two_phase_board(
    bucket_boards: DataFrame, path: str, checkpoint: str, k: int = 10, every: int = 20, keep: int | None = 2, **trigger
) -> StreamingQuery:
    """The live leaderboard merged from boards that the stream keeps per bucket (``state.bucket_boards``).

    With every micro-batch that changes a bucket, the newest board of each bucket, ``k`` rows at most,
    is merged to ``board/batch=n`` as of the watermark.  What is read and written is a board per bucket and the
    changes since the last fold, whatever the number of open orders."""
    kept = Folds(f"{path}/buckets", state.BucketBoards.OUT, every)

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.persist()
        try:
            as_of = batch.agg(F.max("as_of")).first()[0]
            kept.add(batch, number, newest_bucket_boards)
        finally:
            batch.unpersist()
        if as_of is None:
            return
        best = newest_bucket_boards(kept.before(spark, number + 1)).where("order_key IS NOT NULL")
        top = boards.board(best.select("order_key", "balance", F.date_from_unix_date("order_day").alias("order_date")), k)
        publish_board(top.withColumn("as_of", F.date_from_unix_date(F.lit(as_of))), path, number, keep)

    return _start_in_batches(bucket_boards, merge, checkpoint, trigger)


def newest_board(spark: SparkSession, path: str) -> DataFrame:
    """The board published last, with its day."""
    published = spark.read.parquet(f"{path}/board")
    return published.where(F.col("batch") == published.agg(F.max("batch")).scalar()).drop("batch")


def merged_deltas(rows: DataFrame) -> DataFrame:
    """Finished deltas with their corrections folded in: one row per order and day, ``corrected`` where
    entries came late.  Rows without ``late`` are taken as on time."""
    late = F.col("late") if "late" in rows.columns else F.lit(False)
    return rows.groupBy("order_key", "event_date").agg(
        F.sum("amount").cast(EXACT).alias("amount"), F.max("order_date").alias("order_date"), F.bool_or(late).alias("corrected")
    )


def newest_balances(changes: DataFrame) -> DataFrame:
    """From ``state.balance_changes``: each order's last published balance, where it has one."""
    order = F.struct("seen", "balance", "order_day", "event_day")
    last = changes.groupBy("order_key").agg(F.max_by(order, "seen").alias("last"))
    return last.where("last.balance IS NOT NULL").select(
        "order_key", "last.balance", F.date_from_unix_date("last.order_day").alias("order_date"),
        F.date_from_unix_date("last.event_day").alias("event_date"),
    )


def read_deltas(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DELTAS).parquet(path)
