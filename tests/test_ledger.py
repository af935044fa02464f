import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from quayline.operators import balances, boards, ledger
from quayline.operators.orders import orders_of_segment
from tests.conftest import balances_by_hand, day, open_by_hand, random_frames

EDGES = (
    [(1, "BUILDING")],
    [(1, 1, "1995-01-05"), (2, 1, "1995-01-02"), (3, 1, "1995-01-03"), (4, 1, "1995-01-01"), (5, 1, "1995-01-01")],
    [
        (1, 100, 0.0, "1995-01-02"),  # shipped before the order
        (1, 40, 0.25, "1995-01-05"),  # on the order's day
        (1, 7, 0.0, "1995-02-01"),
        (2, 60, 0.5, "1995-01-10"),  # two lines on one day
        (2, 30, 0.0, "1995-01-10"),
        # 3 has no lines
        (4, 20, 0.0, "1995-03-01"),  # 4 and 5 tie
        (5, 20, 0.0, "1995-03-01"),
        (99, 20, 0.0, "1995-03-01"),  # no such order
    ],
)
SEEDS = [11, 12, 13]


def entry_rows(df):
    return sorted((r.order_key, r.event_date, r.amount, r.is_order) for r in df.collect())


def test_entries(frames):
    f = frames(*EDGES)
    assert entry_rows(ledger.ledger_entries(f.orders, f.lineitem)) == sorted(f.entries())


def test_undated_lines_keep_their_order_open(frames, spark):
    f = frames(*EDGES)
    undated = spark.createDataFrame([(1, 9, 500.0, 0.0, None), (1, 10, 100.0, 0.5, None)], f.lineitem.schema)
    lines = f.lineitem.unionAll(undated)
    expected = [(k, d, a + 550 if k == 1 and o else a, o) for k, d, a, o in f.entries()]
    entries = ledger.ledger_entries(f.orders, lines)
    assert entry_rows(entries) == sorted(expected)
    history = balances.balance_history(ledger.day_deltas(f.orders, lines))
    last = {r.order_key: r.balance for r in history.collect() if r.next_date is None}
    assert last.pop(1) == 550 and not any(last.values())
    end = day("2010-01-01")
    for table in (balances.balances_asof(entries, end), balances.balances_asof(ledger.day_deltas(f.orders, lines), end)):
        assert {r.order_key: r.balance for r in table.collect() if r.balance > 0} == {1: 550}
    assert {r.order_key: r.balance for r in balances.open_orders_asof(f.orders, lines, end).collect()} == {1: 550}
    residuals = {r.order_key: r.residual for r in ledger.rounding_residuals(f.orders, lines).collect()}
    rounded = {}
    for r in ledger.ledger_entries(f.orders, lines, rounded=True).collect():
        rounded[r.order_key] = rounded.get(r.order_key, 0) + r.amount
    assert residuals == {k: v for k, v in rounded.items() if v}


def test_undated_orders_are_no_entries_in_either_form(frames, spark):
    f = frames(*EDGES)
    orders = f.orders.withColumn("o_orderdate", F.expr("IF(o_orderkey = 1, NULL, o_orderdate)"))
    expected = sorted(e for e in f.entries() if e[0] != 1)
    assert entry_rows(ledger.ledger_entries(orders, f.lineitem)) == expected
    sums = {}
    for key, when, amount, _ in expected:
        sums[key, when] = sums.get((key, when), Decimal(0)) + amount
    assert {(r.order_key, r.event_date): r.amount for r in ledger.day_deltas(orders, f.lineitem).collect()} == sums
    assert all(r.order_key != 1 for r in ledger.rounding_residuals(orders, f.lineitem).collect())


def test_ledger_order(frames):
    f = frames(*EDGES)
    rows = ledger.in_ledger_order(ledger.ledger_entries(f.orders, f.lineitem).repartition(5)).collect()
    keys = [(r.event_date, not r.is_order, r.order_key, r.amount) for r in rows]
    assert keys == sorted(keys)


def test_day_deltas(frames):
    f = frames(*EDGES)
    found = {(r.order_key, r.event_date): r.amount for r in ledger.day_deltas(f.orders, f.lineitem).collect()}
    expected = {}
    for key, when, amount, _ in f.entries():
        expected[key, when] = expected.get((key, when), Decimal(0)) + amount
    assert found == expected


@pytest.mark.parametrize("seed", SEEDS)
def test_every_order_ends_at_zero(spark, seed):
    f = random_frames(spark, seed)
    history = balances.balance_history(ledger.day_deltas(f.orders, f.lineitem)).collect()
    last = [r for r in history if r.next_date is None]
    assert len(last) == f.orders.count() and all(r.balance == 0 for r in last)


@pytest.mark.parametrize("seed", SEEDS)
def test_asof_forms_agree(spark, seed):
    f = random_frames(spark, seed)
    orders = orders_of_segment(f.orders, f.customer, "BUILDING")
    entries = ledger.ledger_entries(orders, f.lineitem)
    deltas = ledger.day_deltas(orders, f.lineitem)
    dates = {k: day(d) for k, _, d in f.rows[1]}
    for as_of in [day("1995-01-01"), day("1995-02-14"), day("1995-06-01"), day("1996-01-01")]:
        hand = f.entries("BUILDING")
        expected = balances_by_hand(hand, as_of)
        for form in (entries, deltas):
            found = {r.order_key: r for r in balances.balances_asof(form, as_of).collect()}
            assert {k: r.balance for k, r in found.items()} == expected
            assert all(r.order_date == (dates[k] if dates[k] <= as_of else None) for k, r in found.items())
        direct = balances.open_orders_asof(orders, f.lineitem, as_of).collect()
        assert {r.order_key: r.balance for r in direct} == open_by_hand(hand, as_of)
        assert all(r.order_date == dates[r.order_key] for r in direct)


def test_placed_and_shipped_on_the_day(frames):
    f = frames([(1, "B")], [(1, 1, "1995-01-05")], [(1, 10, 0.0, "1995-01-05"), (1, 5, 0.0, "1995-01-06")])
    found = balances.open_orders_asof(f.orders, f.lineitem, day("1995-01-05")).collect()
    assert [(r.order_key, r.balance) for r in found] == [(1, Decimal(5))]


def test_one_cent_is_closed(frames):
    f = frames([(1, "B")], [(1, 1, "1995-01-01"), (2, 1, "1995-01-01")], [(1, 0.01, 0.0, "1995-02-01"), (2, 0.02, 0.0, "1995-02-01")])
    found = balances.open_orders_asof(f.orders, f.lineitem, day("1995-01-05")).collect()
    assert [r.order_key for r in found] == [2]


@pytest.mark.parametrize("seed", SEEDS)
def test_board_forms_agree(spark, seed):
    f = random_frames(spark, seed, orders=90)
    as_of = day("1995-03-15")
    open_orders = balances.open_orders_asof(f.orders, f.lineitem, as_of)
    hand = sorted(open_by_hand(f.entries(), as_of).items(), key=lambda e: (-e[1], e[0]))[:10]
    expected = [(i + 1, k, b) for i, (k, b) in enumerate(hand)]
    for board in (boards.board(open_orders), boards.two_phase_board(open_orders), boards.two_phase_board(open_orders, buckets=3)):
        assert [(r.rank, r.order_key, r.balance) for r in board.orderBy("rank").collect()] == expected


def test_board_tie_goes_to_the_lower_key(frames):
    f = frames(*EDGES)
    top = boards.board(balances.open_orders_asof(f.orders, f.lineitem, day("1995-01-12")), k=2)
    assert [(r.rank, r.order_key) for r in top.orderBy("rank").collect()] == [(1, 4), (2, 5)]


def test_bounded_memory_forgets(frames):
    """Four balances newer than the threshold: the older one is no longer remembered."""
    f = frames(
        [(1, "B")],
        [(1, 1, "1995-01-01")],
        [(1, 10, 0.0, f"1995-01-{d:02d}") for d in (11, 12, 13, 14)] + [(1, 10, 0.0, "1995-05-01")],
    )
    deltas = ledger.day_deltas(f.orders, f.lineitem)
    head, threshold = day("1995-01-31"), day("1995-01-05")
    assert balances.bounded_balances_asof(deltas, head, threshold, 3).count() == 0
    assert balances.bounded_balances_asof(deltas, head, threshold, 4).count() == 0
    kept = balances.bounded_balances_asof(deltas, head, threshold, 5).collect()
    assert [(r.order_key, r.balance) for r in kept] == [(1, Decimal(50))]
    near = balances.bounded_balances_asof(deltas, head, day("1995-01-13"), 3).collect()
    assert [(r.balance, r.event_date) for r in near] == [(Decimal(20), day("1995-01-13"))]


@pytest.mark.parametrize("seed", SEEDS)
def test_unbounded_memory_is_exact(spark, seed):
    f = random_frames(spark, seed)
    deltas = ledger.day_deltas(f.orders, f.lineitem)
    head, threshold = day("1995-05-01"), day("1995-04-10")
    bounded = balances.bounded_balances_asof(deltas, head, threshold, 10_000)
    assert {r.order_key: r.balance for r in bounded.collect()} == balances_by_hand(f.entries(), threshold)


def test_rounding_residuals(frames):
    f = frames(
        [(1, "B")],
        [(1, 1, "1995-01-01"), (2, 1, "1995-01-01"), (3, 1, "1995-01-01")],
        [(1, 0.05, 0.1, "1995-02-01")] * 2 + [(2, 0.05, 0.1, "1995-02-01")] + [(3, 10.0, 0.0, "1995-02-01")] * 2,
    )
    # 1: 0.045 twice is 0.09 in total but 0.05 + 0.05 by line
    found = ledger.rounding_residuals(f.orders, f.lineitem).collect()
    assert [(r.order_key, r.residual) for r in found] == [(1, Decimal("-0.01"))]


@pytest.mark.parametrize("seed", SEEDS)
def test_residuals_match_the_rounded_ledger(spark, seed):
    f = random_frames(spark, seed)
    orders = orders_of_segment(f.orders, f.customer, "BUILDING")
    sums = {}
    for r in ledger.ledger_entries(orders, f.lineitem, rounded=True).collect():
        sums[r.order_key] = sums.get(r.order_key, Decimal(0)) + r.amount
    expected = {k: v for k, v in sums.items() if v != 0}
    assert {r.order_key: r.residual for r in ledger.rounding_residuals(orders, f.lineitem).collect()} == expected


@pytest.mark.parametrize("seed", SEEDS)
def test_monthly_boards(spark, seed):
    f = random_frames(spark, seed, orders=40)
    history = balances.balance_history(ledger.day_deltas(f.orders, f.lineitem))
    found = {}
    for r in boards.monthly_boards(history, until=None, k=3).orderBy("snapshot_date", "rank").collect():
        found.setdefault(r.snapshot_date, []).append((r.rank, r.order_key, r.balance))
    expected = {}
    for month in range(12):
        as_of = dt.date(1995 + month // 12, month % 12 + 1, 1)
        top = sorted(open_by_hand(f.entries(), as_of).items(), key=lambda e: (-e[1], e[0]))[:3]
        if top:
            expected[as_of] = [(i + 1, k, b) for i, (k, b) in enumerate(top)]
    assert found == expected


def test_monthly_boards_of_a_cut_history(frames):
    f = frames([(1, "B")], [(1, 1, "1995-01-10")], [(1, 10, 0.0, "1995-02-05"), (1, 5, 0.0, "1995-12-05")])
    deltas = ledger.day_deltas(f.orders, f.lineitem)
    cut = balances.balance_history(deltas.where("event_date < DATE '1995-06-01'"))
    found = boards.monthly_boards(cut, until=day("1995-04-15")).orderBy("snapshot_date").collect()
    assert [(r.snapshot_date.month, r.balance) for r in found] == [(2, 15), (3, 5), (4, 5)]
