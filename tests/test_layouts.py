"""Stored layouts: the ledger by months, tables in buckets of the order key; boards of every day."""

import datetime as dt
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quayline.operators import balances, boards, ledger
from quayline.operators.orders import order_totals, orders_of_segment
from quayline.plans import fulfilment, shipping_priority
from quayline.sources.clustered import buckets_for, forget, open_clustered, write_clustered
from quayline.sources.ledger import extend_ledger, read_ledger_months
from quayline.sources.tables import Tables
from tests.conftest import day, open_by_hand, random_frames

DATA = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns or df.columns).collect()), key=str)


def months_of(path):
    """Each month folder's files with their times."""
    return {p.name.partition("=")[2]: sorted((f.name, f.stat().st_mtime_ns) for f in p.glob("*.parquet")) for p in Path(path).glob("event_month=*")}


def test_new_rows_rewrite_only_their_months(spark, frames, tmp_path):
    """Orders of four months, shipped within days; a later month, then a late line and an early one."""
    path = str(tmp_path / "ledger")
    customers = [(1, "BUILDING")]
    orders = [(k, 1, f"1995-{k:02d}-10") for k in (1, 2, 3, 4)]
    lines = [(k, 100 + k, 0.05, f"1995-{k:02d}-20") for k in (1, 2, 3, 4)]
    first = frames(customers, orders, lines)
    assert extend_ledger(path, first.orders, first.lineitem, first.orders, first.lineitem) == ["1995-01", "1995-02", "1995-03", "1995-04"]
    before = months_of(path)

    more_orders, more_lines = [(5, 1, "1995-05-02"), (6, 1, "1995-06-02")], [(5, 50, 0, "1995-05-09")]
    second, new = frames(customers, orders + more_orders, lines + more_lines), frames(customers, more_orders, more_lines)
    assert extend_ledger(path, second.orders, second.lineitem, new.orders, new.lineitem) == ["1995-05", "1995-06"]
    after = months_of(path)
    assert {m: after[m] for m in before} == before and set(after) == {*before, "1995-05", "1995-06"}

    # a line that ships in May for the order of February, and one whose order is not known yet
    last_lines = [(2, 7, 0, "1995-05-30"), (9, 3, 0, "1995-03-03")]
    third, new = frames(customers, orders + more_orders, lines + more_lines + last_lines), frames(customers, [], last_lines)
    assert extend_ledger(path, third.orders, third.lineitem, new.orders, new.lineitem) == ["1995-02", "1995-05"]
    assert {m for m, files in months_of(path).items() if files != after[m]} == {"1995-02", "1995-05"}

    # the unknown order comes: its line becomes an entry
    final, new = frames(customers, orders + more_orders + [(9, 1, "1995-06-01")], lines + more_lines + last_lines), frames(customers, [(9, 1, "1995-06-01")], [])
    assert extend_ledger(path, final.orders, final.lineitem, new.orders, new.lineitem) == ["1995-03", "1995-06"]
    found = read_ledger_months(spark, path)
    assert rows(found.drop("event_month")) == rows(ledger.ledger_entries(final.orders, final.lineitem))
    assert found.where("event_month <> date_format(event_date, 'yyyy-MM')").count() == 0
    assert extend_ledger(path, final.orders, final.lineitem, new.orders.limit(0), new.lineitem.limit(0)) == []


@pytest.mark.parametrize("seed", [3, 4])
def test_increments_add_up_to_the_ledger(spark, tmp_path, seed):
    f = random_frames(spark, seed, orders=50, lines=200, days=150)
    path = str(tmp_path / "ledger")
    bounds = [day("1995-01-01"), day("1995-02-10"), day("1995-04-01"), day("1995-12-31")]
    for low, high in zip(bounds, bounds[1:]):

        def part(table, column, start):
            return table.where((F.col(column) >= F.lit(start)) & (F.col(column) < F.lit(high)))

        extend_ledger(
            path, part(f.orders, "o_orderdate", bounds[0]), part(f.lineitem, "l_shipdate", bounds[0]),
            part(f.orders, "o_orderdate", low), part(f.lineitem, "l_shipdate", low),
        )
    assert rows(read_ledger_months(spark, path).drop("event_month")) == rows(ledger.ledger_entries(f.orders, f.lineitem))


def test_month_folders_are_pruned(spark, tmp_path):
    f = random_frames(spark, 5, orders=50, lines=200, days=150)
    extend_ledger(str(tmp_path / "l"), f.orders, f.lineitem, f.orders, f.lineitem)
    read = read_ledger_months(spark, str(tmp_path / "l")).where("event_month = '1995-02'")
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_month" in plan


@pytest.fixture(scope="module")
def clustered(spark, tmp_path_factory):
    """Clustered tables and their folder; plans are as they are beyond the broadcast threshold."""
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k, None) for k in settings}
    for key, value in settings.items():
        spark.conf.set(key, value)
    root = str(tmp_path_factory.mktemp("clustered"))
    tables = write_clustered(Tables(spark, DATA), root, 6)
    yield tables, root
    forget(tables)
    for key, value in before.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def exchanged_keys(df):
    return re.findall(r"Exchange hashpartitioning\((\w+)#", plan_of(df))


def test_joins_on_the_order_key_need_no_exchange_of_the_lines(spark, clustered):
    tables, _ = clustered
    for report, plain in (
        (shipping_priority.q3_dataflow, ["o_custkey", "o_custkey"]),
        (fulfilment.day_deltas, ["o_custkey", "o_custkey"]),
        (lambda t: order_totals(t.lineitem), []),
    ):
        loose = exchanged_keys(report(Tables(spark, DATA)))
        bucketed = report(tables)
        assert "l_orderkey" in loose
        # what is exchanged are customers and orders, the orders into the lines' buckets
        assert [k for k in exchanged_keys(bucketed) if k not in ("o_orderkey", "order_key")] == plain
        assert re.search(r"_lineitem\[.*Bucketed: true", plan_of(bucketed))
        assert rows(bucketed) == rows(report(Tables(spark, DATA)))


def test_orders_and_lines_meet_without_any_exchange(clustered):
    tables, _ = clustered
    joined = tables.orders.join(order_totals(tables.lineitem), tables.orders.o_orderkey == F.col("l_orderkey"))
    assert exchanged_keys(joined) == []


def test_buckets_are_files_in_order(spark, clustered):
    _, root = clustered
    for name, key in (("lineitem", "l_orderkey"), ("orders", "o_orderkey")):
        files = list(Path(root, name).glob("*.parquet"))
        assert len(files) <= 6
        for file in files:
            keys = [r[0] for r in spark.read.parquet(str(file)).select(key).collect()]
            assert keys == sorted(keys)


def test_another_session_opens_the_tables(spark, clustered):
    tables, root = clustered
    again = open_clustered(spark, Tables(spark, DATA), root, 6)
    assert rows(again.lineitem) == rows(tables.lineitem) and exchanged_keys(order_totals(again.lineitem)) == []
    forget(again)


def test_bucket_numbers_follow_the_input():
    assert (buckets_for(0), buckets_for(100 << 40, 256 << 20)) == (8, (100 << 40) // (256 << 20))


def test_boards_of_every_day_by_hand(spark):
    f = random_frames(spark, 9, orders=50, lines=200, days=90)
    history = balances.balance_history(ledger.day_deltas(f.orders, f.lineitem)).persist()
    entries = f.entries()
    placed = {k: d for k, _, d in f.rows[1]}
    last = max(when for _, when, _, _ in entries)
    found = {}
    for r in boards.daily_boards(history, last, 4).collect():
        found.setdefault(r.snapshot_date, []).append((r["rank"], r.order_key, r.balance, r.order_date))
    first = min(when for _, when, _, _ in entries)
    for n in range((last - first).days + 1):
        when = first + dt.timedelta(days=n)
        open_now = sorted(open_by_hand(entries, when).items(), key=lambda kv: (-kv[1], kv[0]))[:4]
        assert sorted(found.get(when, [])) == [(i, k, b, day(placed[k])) for i, (k, b) in enumerate(open_now, 1)]
    assert boards.daily_boards(history.limit(0), last, 4).count() == 0


def test_daily_boards_rank_few_rows(spark):
    """Less than twice the deltas are ranked for the boards of 2,500 days, where every open balance of
    every day would be a hundred times as many."""
    tables = Tables(spark, "/root/testdata/sf0.1")
    deltas = ledger.day_deltas(orders_of_segment(tables.orders, tables.customer, "BUILDING"), tables.lineitem).persist()
    history = balances.balance_history(deltas).persist()
    until = dt.date(2001, 11, 4)
    near = boards.near_daily_boards(history, until)
    held = boards._held_open(history, until)
    every = held.selectExpr("sum(datediff(last, event_date) + 1)").first()[0]
    assert near.count() < 2 * deltas.count() < every / 50
    monthly = boards.monthly_boards(history, until)
    starts = boards.daily_boards(history, until).where("day(snapshot_date) = 1")
    assert rows(starts, *sorted(monthly.columns)) == rows(monthly, *sorted(monthly.columns))
    deltas.unpersist(), history.unpersist()
