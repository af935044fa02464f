import os
import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayline.operators import balances, boards, ledger
from quayline.operators.orders import daily_segment_orders, orders_of_segment
from quayline.operators.words import word_count
from quayline.sources import schemas
from quayline.sources.delimited import stream_delimited
from quayline.sources.ledger import write_ledger_text
from quayline.sources.text import read_lines, stream_lines
from quayline.streaming import ledger as live
from quayline.streaming.monitor import daily_segment_stream, start_daily_segment_counts
from quayline.streaming.folding import Folds
from quayline.streaming.sources import ended, stream_table
from quayline.streaming.words import latest_counts, start_word_count
from tests.conftest import day, random_frames

# week-long slices of the ledger, oldest first
SLICES = [day(f"1995-{m:02d}-{d:02d}") for m in (1, 2, 3) for d in (1, 8, 15, 22)] + [day("1995-04-01")]
UNTIL = day("1995-03-31")


def feed_in_files(table, column, folder, slices=SLICES, newest_first=False):
    """One file per slice, with increasing modification times in the order of arrival."""
    bounds = list(zip(slices, slices[1:]))
    if newest_first:
        bounds.reverse()
    for i, (low, high) in enumerate(bounds):
        rows = table.where((table[column] >= low) & (table[column] < high))
        rows.coalesce(1).write.mode("append").parquet(folder)
        stamp = time.time() - 1000 + i
        for name in os.listdir(folder):
            path = os.path.join(folder, name)
            if name.endswith(".parquet") and path not in seen_files:
                os.utime(path, (stamp, stamp))
                seen_files.add(path)


seen_files: set[str] = set()


@pytest.fixture(scope="module")
def sample(spark):
    f = random_frames(spark, 31, orders=80, lines=300, days=120)
    return f


def building(f):
    return orders_of_segment(f.orders, f.customer, "BUILDING")


def run(query):
    query.awaitTermination()
    return query


def dropped(query):
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])


def board_of(df):
    return [(r.rank, r.order_key, r.balance, r.order_date) for r in df.orderBy("rank").collect()]


def expected_board(f, entries, until=UNTIL):
    """The board of the day before the newest entry."""
    newest = entries.where(entries.event_date <= until).agg({"event_date": "max"}).first()[0]
    before = entries.where(entries.event_date < newest)
    return board_of(boards.board(balances.balances_asof(before, newest)))


def test_ledger_stream_file_by_file(spark, sample, tmp_path):
    entries = ledger.ledger_entries(building(sample), sample.lineitem)
    feed_in_files(entries, "event_date", str(tmp_path / "in"))
    stream = live.entry_stream(stream_table(spark, str(tmp_path / "in"), max_files=1))
    query = run(live.start_day_deltas(live.day_delta_stream(stream), str(tmp_path / "deltas"), str(tmp_path / "cp")))
    assert len(query.recentProgress) >= 12 and dropped(query) == 0
    # the state never holds more than the days of a slice, let alone the ledger
    peak = max(op["numRowsTotal"] for p in query.recentProgress for op in p["stateOperators"])
    assert peak < entries.count() / 4
    deltas = live.read_deltas(spark, str(tmp_path / "deltas"))
    assert board_of(boards.board(live.finished_balances(deltas))) == expected_board(sample, entries)
    assert deltas.groupBy("order_key", "event_date").count().where("count > 1").count() == 0


def test_late_rows_are_dropped_without_delay(spark, sample, tmp_path):
    entries = ledger.ledger_entries(building(sample), sample.lineitem)
    feed_in_files(entries, "event_date", str(tmp_path / "in"), newest_first=True)
    source = stream_table(spark, str(tmp_path / "in"), max_files=1)
    query = run(live.start_day_deltas(live.day_delta_stream(live.entry_stream(source)), str(tmp_path / "deltas"), str(tmp_path / "cp")))
    assert dropped(query) > 0


def test_delay_covers_disorder(spark, sample, tmp_path):
    """Newest first with enough delay: nothing is dropped, the finished days are exact."""
    entries = ledger.ledger_entries(building(sample), sample.lineitem)
    feed_in_files(entries, "event_date", str(tmp_path / "in"), SLICES[:5], newest_first=True)
    late = entries.where(entries.event_date >= SLICES[8])
    late.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.entry_stream(stream_table(spark, str(tmp_path / "in"), max_files=1), "40 days")
    query = run(live.start_day_deltas(live.day_delta_stream(stream), str(tmp_path / "deltas"), str(tmp_path / "cp")))
    assert dropped(query) == 0
    found = live.read_deltas(spark, str(tmp_path / "deltas"))
    want = ledger.day_deltas(building(sample), sample.lineitem).where(f"event_date < DATE '{SLICES[4]}'")
    got = found.where(f"event_date < DATE '{SLICES[4]}'").select("order_key", "event_date", "amount")
    assert got.exceptAll(want.select(got.columns)).count() == 0 and got.count() == want.count() > 0


def test_delimited_ledger_stream(spark, sample, tmp_path):
    entries = ledger.ledger_entries(building(sample), sample.lineitem, rounded=True)
    feed = entries.where(entries.event_date <= UNTIL)
    write_ledger_text(feed, str(tmp_path / "in"))
    stream = live.entry_stream(stream_delimited(spark, str(tmp_path / "in"), schemas.LEDGER))
    run(live.start_day_deltas(live.day_delta_stream(stream), str(tmp_path / "deltas"), str(tmp_path / "cp")))
    deltas = live.read_deltas(spark, str(tmp_path / "deltas"))
    assert board_of(boards.board(live.finished_balances(deltas))) == expected_board(sample, entries)


def test_board_refresh(spark, sample, tmp_path):
    entries = ledger.ledger_entries(building(sample), sample.lineitem)
    feed_in_files(entries, "event_date", str(tmp_path / "in"))
    stream = live.entry_stream(stream_table(spark, str(tmp_path / "in"), max_files=1))
    run(live.start_board_refresh(live.day_delta_stream(stream), str(tmp_path / "out"), str(tmp_path / "cp"), k=5))
    shown = spark.read.parquet(str(tmp_path / "out" / "board"))
    days = sorted(r.as_of for r in shown.select("as_of").distinct().collect())
    assert len(days) == 2  # the newest two boards are kept
    for as_of in days:
        want = boards.board(balances.balances_asof(entries, as_of), 5)
        assert board_of(shown.where(shown.as_of == as_of)) == board_of(want)


def test_board_refresh_keeps_few_folders_and_open_orders(spark, sample, tmp_path):
    entries = ledger.ledger_entries(building(sample), sample.lineitem)
    feed_in_files(entries, "event_date", str(tmp_path / "in"))
    stream = live.entry_stream(stream_table(spark, str(tmp_path / "in"), max_files=1))
    deltas = live.day_delta_stream(stream)
    run(live.start_board_refresh(deltas, str(tmp_path / "out"), str(tmp_path / "cp"), k=5, every=3))
    kept = {kind: sorted(p.name for p in (tmp_path / "out" / "opening" / kind).iterdir()) for kind in ("base", "recent")}
    assert len(kept["base"]) <= 2 and len(kept["recent"]) <= 6
    shown = spark.read.parquet(str(tmp_path / "out" / "board"))
    as_of = shown.agg({"as_of": "max"}).first()[0]
    want = boards.board(balances.balances_asof(entries, as_of), 5)
    assert board_of(shown.where(shown.as_of == as_of)) == board_of(want)
    carried = spark.read.parquet(str(tmp_path / "out" / "opening" / "base" / kept["base"][-1]))
    assert carried.where("order_date IS NOT NULL AND amount <= 0.01").count() == 0


def test_folds_over_many_batches(spark, tmp_path):
    folds = Folds(str(tmp_path / "f"), "word STRING, n BIGINT", every=4)

    def add(number):
        rows = spark.createDataFrame([("a", number), (f"w{number}", 1)], "word STRING, n BIGINT")
        folds.add(rows, number, lambda all_rows: all_rows.groupBy("word").agg(F.max("n").alias("n")))

    for number in range(14):
        add(number)
        if number % 5 == 0:
            add(number)  # a repeated batch changes nothing
        assert sum(1 for kind in (tmp_path / "f").iterdir() for _ in kind.iterdir()) <= 2 + 2 * 4
    found = {r.word: r.n for r in folds.rows(spark).groupBy("word").agg(F.max("n").alias("n")).collect()}
    assert found == {"a": 13, **{f"w{n}": 1 for n in range(14)}}


def test_the_end_of_a_feed_closes_its_newest_day(spark, sample, tmp_path):
    orders = sample.orders.select("o_orderkey", "o_custkey", "o_orderdate")
    orders.write.parquet(str(tmp_path / "in"))
    stream = ended(stream_table(spark, str(tmp_path / "in")), "o_orderdate", str(tmp_path))
    counts = daily_segment_stream(stream, sample.customer)
    query = run(start_daily_segment_counts(counts, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert dropped(query) == 0
    found, want = spark.read.parquet(str(tmp_path / "out")), daily_segment_orders(orders, sample.customer)
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0


def test_stream_paths(spark, sample, tmp_path):
    rows = sample.orders.coalesce(1)
    rows.write.parquet(str(tmp_path / "a{b}*c" / "in"))
    file = next((tmp_path / "a{b}*c" / "in").glob("*.parquet"))
    plain = tmp_path / "plain"
    plain.mkdir()
    odd = plain / "odd[1].parquet"
    odd.write_bytes(file.read_bytes())
    for path in (str(plain) + "/", str(plain), str(odd)):
        stream = stream_table(spark, path)
        query = stream.writeStream.format("memory").queryName("paths").trigger(availableNow=True).start()
        query.awaitTermination()
        assert spark.table("paths").count() == sample.orders.count()


def test_opening_balances_replace_closed_days(spark, sample):
    deltas = ledger.day_deltas(building(sample), sample.lineitem)
    cut, as_of = day("1995-02-10"), day("1995-03-20")
    known = deltas.selectExpr(
        "order_key", "event_date", "amount", "IF(event_date = order_date, order_date, NULL) AS order_date"
    )
    opening = live.opening_balances(known.where(known.event_date <= cut))
    later = known.where((known.event_date > cut) & (known.event_date <= as_of))
    folded = boards.board(live.finished_balances(later, opening).where("order_date IS NOT NULL"))
    assert board_of(folded) == board_of(boards.board(balances.balances_asof(deltas, as_of)))


def test_daily_segment_counts(spark, sample, tmp_path):
    feed_in_files(sample.orders, "o_orderdate", str(tmp_path / "in"))
    stream = stream_table(spark, str(tmp_path / "in"), max_files=1)
    counts = daily_segment_stream(stream, sample.customer)
    query = run(start_daily_segment_counts(counts, str(tmp_path / "out"), str(tmp_path / "cp")))
    assert dropped(query) == 0
    found = spark.read.parquet(str(tmp_path / "out"))
    arrived = sample.orders.where(sample.orders.o_orderdate < SLICES[-1])
    newest = arrived.agg({"o_orderdate": "max"}).first()[0]
    want = daily_segment_orders(arrived.where(arrived.o_orderdate < newest), sample.customer)
    assert found.exceptAll(want).count() == 0 and want.exceptAll(found).count() == 0


def test_word_count_over_files(spark, tmp_path):
    texts = ["one two two\nthree", "two  one ", "three three\n\nfour"]
    (tmp_path / "in").mkdir()
    for i, text in enumerate(texts):
        path = tmp_path / "in" / f"{i}.txt"
        path.write_text(text)
        os.utime(path, (time.time() - 100 + i,) * 2)
    stream = stream_lines(spark, str(tmp_path / "in"), max_files=1)
    run(start_word_count(stream, str(tmp_path / "out"), str(tmp_path / "cp")))
    found = {r.word: r.n for r in latest_counts(spark, str(tmp_path / "out")).collect()}
    assert found == {r.word: r.n for r in word_count(read_lines(spark, str(tmp_path / "in"))).collect()}
    # the first micro-batch had published the counts of the first file only
    first = {r.word: r.n for r in spark.read.parquet(str(tmp_path / "out" / "base" / "batch=0")).collect()}
    assert first == {"one": 1, "two": 2, "three": 1}


def test_amounts_stay_exact(spark, sample, tmp_path):
    entries = ledger.ledger_entries(building(sample), sample.lineitem)
    feed_in_files(entries, "event_date", str(tmp_path / "in"))
    stream = live.entry_stream(stream_table(spark, str(tmp_path / "in")))
    run(live.start_day_deltas(live.day_delta_stream(stream), str(tmp_path / "deltas"), str(tmp_path / "cp")))
    total = live.read_deltas(spark, str(tmp_path / "deltas")).agg({"amount": "sum"}).first()[0]
    newest = entries.where(entries.event_date < SLICES[-1]).agg({"event_date": "max"}).first()[0]
    expected = sum((r.amount for r in entries.where(entries.event_date < newest).collect()), Decimal(0))
    assert total == expected
