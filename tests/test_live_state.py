"""Keyed state, late corrections, joined streams and boards published while the streams run."""

import os
import time

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from quayline.operators import balances, boards, ledger
from quayline.operators.orders import orders_of_segment
from quayline.streaming import ledger as live, state
from quayline.streaming.enrichment import JOINED, Reach, entry_stream_of_joined, joined_entries, joined_lines, start_joined_lines
from quayline.streaming.sources import ended, stream_table
from tests.conftest import day, random_frames

CUTS = [day(d) for d in ("1995-01-01", "1995-01-20", "1995-02-05", "1995-02-06", "1995-03-01", "1995-03-20", "1995-12-31")]
SLICES = list(zip(CUTS, CUTS[1:]))
REACH = Reach(before=200, after=200)


@pytest.fixture(scope="module")
def sample(spark):
    f = random_frames(spark, 77, orders=70, lines=260, days=110)
    f.own = orders_of_segment(f.orders, f.customer, "BUILDING")
    f.ledger = ledger.ledger_entries(f.own, f.lineitem).persist()
    f.deltas = ledger.day_deltas(f.own, f.lineitem).persist()
    return f


_stamp = [time.time() - 100_000]


def deliver(table, column, folder, slices):
    """One file per slice, in this order of arrival."""
    for low, high in slices:
        before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
        table.where((F.col(column) >= F.lit(low)) & (F.col(column) < F.lit(high))).coalesce(1).write.mode("append").parquet(folder)
        for name in set(os.listdir(folder)) - before:
            _stamp[0] += 1
            os.utime(os.path.join(folder, name), (_stamp[0],) * 2)


def run(spark, stream, root, name="out"):
    with state.column_family_store(spark):
        query = live.start_day_deltas(stream, f"{root}/{name}", f"{root}/cp-{name}")
    query.awaitTermination()
    return query


def lost(query):
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def open_rows(df):
    return rows(df.where("balance > 0.01 AND order_date IS NOT NULL"), "order_key", "balance", "order_date", "event_date")


@pytest.mark.parametrize("versions, delay", [(3, 0), (2, 25), (1, 10)])
def test_versions_equal_the_bounded_report_across_a_restart(spark, sample, tmp_path, versions, delay):
    """Newest days in the stream's state, stopped and started again midway: the same rows as the batch
    operator, also where a lagging watermark makes remembered days too new."""
    root, source = str(tmp_path), str(tmp_path / "in")

    def changes():
        entries = live.entry_stream(stream_table(spark, source, sample.ledger.schema, max_files=1), f"{delay} days")
        return state.balance_changes(entries, versions)

    deliver(sample.ledger, "event_date", source, SLICES[:3])
    run(spark, changes(), root)
    deliver(sample.ledger, "event_date", source, SLICES[3:])
    assert lost(run(spark, changes(), root)) == 0
    head = sample.ledger.agg(F.max("event_date")).first()[0]
    threshold = head.fromordinal(head.toordinal() - delay - 1)
    want = balances.bounded_balances_asof(sample.deltas, head, threshold, versions)
    want = want.withColumn("order_date", F.when(F.col("order_date") <= F.lit(threshold), F.col("order_date")))
    found = live.newest_balances(spark.read.parquet(f"{root}/out"))
    assert open_rows(found) == open_rows(want)
    if delay:
        everything = balances.bounded_balances_asof(sample.deltas, head, threshold, 10_000)
        assert len(open_rows(want)) < len(open_rows(everything))


def test_late_rows_become_corrections(spark, sample, tmp_path):
    """Slices in any order of arrival: what the watermark has passed is published as a correction, and the merged
    deltas are those of the batch operator."""
    root, source = str(tmp_path), str(tmp_path / "in")
    deliver(sample.ledger, "event_date", source, [SLICES[i] for i in (1, 4, 0, 5, 3, 2)])
    query = run(spark, state.corrected_deltas(live.entry_stream(stream_table(spark, source, max_files=1))), root)
    assert lost(query) == 0
    published = spark.read.parquet(f"{root}/out")
    newest = sample.ledger.agg(F.max("event_date")).first()[0]
    merged, want = live.merged_deltas(published), sample.deltas.where(F.col("event_date") < F.lit(newest))
    assert rows(merged, "order_key", "event_date", "amount") == rows(want, "order_key", "event_date", "amount")
    late = merged.where("corrected").select("event_date").distinct()
    assert {r.event_date for r in late.collect()} <= {d for d in sample_days(sample) if in_slices(d, (0, 2, 3))}
    assert merged.where("corrected").count() > 0 and published.where("NOT late").groupBy("order_key", "event_date").count().where("count > 1").count() == 0
    placed = merged.where("order_date IS NOT NULL")
    assert placed.where("order_date <> event_date").count() == 0 and placed.count() == sample.own.where(F.col("o_orderdate") < F.lit(newest)).count()


def sample_days(sample):
    return [r.event_date for r in sample.ledger.select("event_date").distinct().collect()]


def in_slices(when, numbers):
    return any(SLICES[n][0] <= when < SLICES[n][1] for n in numbers)


def test_late_entries_correct_balances(spark, sample, tmp_path):
    """The same for balances: exact as of the watermark whatever came when."""
    root, source = str(tmp_path), str(tmp_path / "in")
    deliver(sample.ledger, "event_date", source, [SLICES[i] for i in (3, 0, 4, 1, 2)])
    run(spark, state.balance_changes(live.entry_stream(stream_table(spark, source, max_files=1))), root)
    arrived = sample.deltas.where(F.col("event_date") < F.lit(CUTS[5]))
    newest = arrived.agg(F.max("event_date")).first()[0]
    want = balances.balances_asof(arrived, newest.fromordinal(newest.toordinal() - 1))
    found = live.newest_balances(spark.read.parquet(f"{root}/out"))
    assert rows(found.where("balance > 0.01 AND order_date IS NOT NULL"), "order_key", "balance", "order_date") == rows(
        want.where("balance > 0.01 AND order_date IS NOT NULL"), "order_key", "balance", "order_date"
    )


def test_closed_orders_leave_the_state(spark, frames, tmp_path):
    f = frames([(1, "BUILDING")], [(k, 1, f"1995-01-{k:02d}") for k in range(1, 21)], [(k, 100, 0, f"1995-01-{k + 1:02d}") for k in range(1, 21)])
    entries = ledger.ledger_entries(f.orders, f.lineitem)
    deliver(entries, "event_date", str(tmp_path / "in"), [(day(f"1995-01-{a:02d}"), day(f"1995-01-{a + 4:02d}")) for a in range(1, 21, 4)])
    query = run(spark, state.balance_changes(live.entry_stream(stream_table(spark, str(tmp_path / "in"), max_files=1))), str(tmp_path))
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) < 20


def test_joined_streams_need_no_table_made_before(spark, sample, tmp_path):
    """Orders and lines arrive slice by slice, lines also before their orders."""
    root = str(tmp_path)
    orders = sample.own.select("o_orderkey", "o_custkey", "o_orderdate")
    lines = sample.lineitem.select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate")
    deliver(orders, "o_orderdate", f"{root}/orders", [SLICES[0]])
    deliver(lines, "l_shipdate", f"{root}/lines", [SLICES[0]])

    def query():
        both = stream_table(spark, f"{root}/orders", orders.schema), stream_table(spark, f"{root}/lines", lines.schema)
        return start_joined_lines(joined_lines(*both, REACH, "150 days"), f"{root}/joined", f"{root}/cp")

    query().awaitTermination()
    deliver(lines, "l_shipdate", f"{root}/lines", SLICES[1:])
    deliver(orders, "o_orderdate", f"{root}/orders", SLICES[1:])
    second = query()
    second.awaitTermination()
    assert lost(second) == 0
    found = joined_entries(spark.read.schema(JOINED).parquet(f"{root}/joined")).groupBy("order_key", "event_date").agg(F.sum("amount").alias("amount"))
    with_lines = sample.deltas.join(lines.select(F.col("l_orderkey").alias("order_key")).distinct(), "order_key", "left_semi")
    assert rows(found, "order_key", "event_date", "amount") == rows(with_lines, "order_key", "event_date", "amount")
    owners = spark.read.parquet(f"{root}/joined").select("order_key", "cust_key").distinct()
    assert owners.exceptAll(orders.select("o_orderkey", "o_custkey").distinct()).count() == 0


def test_reach_bounds_the_join_and_its_state(spark, frames, tmp_path):
    days = [f"1995-{m:02d}-15" for m in range(1, 11)]
    f = frames([(1, "BUILDING")], [(k, 1, d) for k, d in enumerate(days)], [(k, 10, 0, d[:8] + "20") for k, d in enumerate(days)] + [(0, 10, 0, "1995-09-01")])
    months = [(day(f"1995-{m:02d}-01"), day(f"1995-{m + 1:02d}-01")) for m in range(1, 11)]
    orders, lines = f.orders.select("o_orderkey", "o_custkey", "o_orderdate"), f.lineitem.drop("l_linenumber")
    deliver(orders, "o_orderdate", str(tmp_path / "orders"), months)
    deliver(lines, "l_shipdate", str(tmp_path / "lines"), months)
    both = stream_table(spark, str(tmp_path / "orders"), max_files=1), stream_table(spark, str(tmp_path / "lines"), max_files=1)
    query = start_joined_lines(joined_lines(*both, Reach(0, 30), "31 days"), str(tmp_path / "joined"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "joined")), "order_key") == [(k,) for k in range(10)]
    assert max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"]) < 15


def published(spark, path):
    return {r.as_of: rows(spark.read.parquet(f"{path}/board").where(F.col("as_of") == F.lit(r.as_of)), "rank", "order_key", "balance", "order_date")
            for r in spark.read.parquet(f"{path}/board").select("as_of").distinct().collect()}


def expected(deltas, as_of, k):
    top = boards.two_phase_board(balances.balances_asof(deltas, as_of).where("order_date IS NOT NULL"), k)
    return rows(top, "rank", "order_key", "balance", "order_date")


@pytest.mark.parametrize("k", [2, 10])
def test_bucket_boards_are_published_while_the_stream_runs(spark, sample, tmp_path, k):
    root, source = str(tmp_path), str(tmp_path / "in")
    deliver(sample.ledger, "event_date", source, SLICES)
    entries = live.entry_stream(stream_table(spark, source, max_files=1))
    with state.column_family_store(spark):
        best = state.bucket_boards(state.balance_changes(entries), k, 3)
        query = live.start_two_phase_board(best, f"{root}/out", f"{root}/cp", k, every=3, keep=None)
    query.awaitTermination()
    shown = published(spark, f"{root}/out")
    assert len(shown) >= len(SLICES) - 1
    for as_of, top in shown.items():
        assert top == expected(sample.deltas, as_of, k)
    newest = sample.ledger.agg(F.max("event_date")).first()[0]
    assert rows(live.newest_board(spark, f"{root}/out"), "rank", "order_key", "balance", "order_date") == expected(
        sample.deltas, newest.fromordinal(newest.toordinal() - 1), k
    )


def test_two_streams_to_one_board(spark, sample, tmp_path):
    """From both tables' streams to the board, through the joined lines, without a batch job."""
    root = str(tmp_path)
    orders = sample.own.select("o_orderkey", "o_custkey", "o_orderdate")
    deliver(orders, "o_orderdate", f"{root}/orders", SLICES)
    deliver(sample.lineitem.drop("l_linenumber"), "l_shipdate", f"{root}/lines", SLICES)
    both = stream_table(spark, f"{root}/orders"), stream_table(spark, f"{root}/lines")
    start_joined_lines(joined_lines(*both, REACH), f"{root}/joined", f"{root}/cp-join").awaitTermination()
    until = day("1995-03-01")
    joined = stream_table(spark, f"{root}/joined", JOINED).where(F.col("order_date") <= F.lit(until))
    entries = entry_stream_of_joined(ended(joined, "order_date", root, until))
    with state.column_family_store(spark):
        best = state.bucket_boards(state.balance_changes(entries), 10, 4)
        live.start_two_phase_board(best, f"{root}/out", f"{root}/cp", 10).awaitTermination()
    found = rows(live.newest_board(spark, f"{root}/out"), "rank", "order_key", "balance", "order_date")
    assert found == expected(sample.deltas, day("1995-02-28"), 10)


def test_refresh_on_a_timer_is_killed_and_resumed(spark, sample, tmp_path, monkeypatch):
    """A refresh that runs on a processing-time trigger dies inside a batch and is stopped once between batches; started
    again on the same folders it publishes every board that an undisturbed run does."""

    def refresh(name, source, **trigger):
        deltas = live.day_delta_stream(live.entry_stream(stream_table(spark, source, sample.ledger.schema, max_files=1)))
        return live.start_board_refresh(deltas, str(tmp_path / name), str(tmp_path / f"cp-{name}"), k=5, every=3, keep=None, **trigger)

    source = str(tmp_path / "in")
    deliver(sample.ledger, "event_date", source, SLICES[:4])
    timed = {"processingTime": "200 milliseconds"}
    plain, calls = boards.board, []

    def dies(*given):
        calls.append(given)
        if len(calls) == 3:
            raise RuntimeError("executor of the third board is gone")
        return plain(*given)

    monkeypatch.setattr(live.boards, "board", dies)
    first = refresh("broken", source, **timed)
    with pytest.raises(StreamingQueryException, match="third board"):
        first.awaitTermination(120)
    second = refresh("broken", source, **timed)
    second.processAllAvailable()
    second.stop()
    deliver(sample.ledger, "event_date", source, SLICES[4:])
    third = refresh("broken", source, **timed)
    third.processAllAvailable()
    third.stop()
    monkeypatch.setattr(live.boards, "board", plain)
    refresh("whole", source).awaitTermination()
    shown = published(spark, str(tmp_path / "broken"))
    assert shown == published(spark, str(tmp_path / "whole")) and len(shown) >= 5
    for as_of, top in shown.items():
        assert top == expected(sample.deltas, as_of, 5)
