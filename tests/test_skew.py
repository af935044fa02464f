"""One order with a third of the lines, one customer with a third of the orders."""

import pytest

from quayline.operators import balances, boards, ledger
from quayline.operators.orders import daily_segment_orders, order_totals, orders_of_segment
from tests.conftest import balances_by_hand, day, open_by_hand, random_frames


@pytest.fixture(scope="module")
def hot(spark):
    return random_frames(spark, 21, orders=90, lines=1500, hot=True)


def test_results_are_whole(hot):
    orders = orders_of_segment(hot.orders, hot.customer, "BUILDING")
    hand = hot.entries("BUILDING")
    entries = ledger.ledger_entries(orders, hot.lineitem)
    assert sorted((r.order_key, r.event_date, r.amount, r.is_order) for r in entries.collect()) == sorted(hand)
    as_of = day(hot.rows[1][0][2])  # the day the hot order is placed
    deltas = ledger.day_deltas(orders, hot.lineitem)
    assert {r.order_key: r.balance for r in balances.balances_asof(deltas, as_of).collect()} == balances_by_hand(hand, as_of)
    direct = balances.open_orders_asof(orders, hot.lineitem, as_of)
    expected = open_by_hand(hand, as_of)
    assert {r.order_key: r.balance for r in direct.collect()} == expected
    best = max(expected.items(), key=lambda e: (e[1], -e[0]))
    assert boards.two_phase_board(direct).orderBy("rank").first().order_key == best[0] == 1


def test_hot_order_is_one_row_per_day_after_the_first_sum(hot):
    """What reaches the per-order windows is bounded by the calendar."""
    rows = ledger.day_deltas(hot.orders, hot.lineitem).where("order_key = 1").count()
    lines = hot.lineitem.where("l_orderkey = 1").count()
    assert lines >= 500 and rows <= 201


def test_skewed_join_is_split(spark, hot):
    """Forced through shuffles with tiny thresholds, the adaptive plan splits the hot customer
    and the result stays the same."""
    expected = orders_of_segment(hot.orders, hot.customer, "BUILDING").count()
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        kept = orders_of_segment(hot.orders.repartition(8), hot.customer, "BUILDING")
        assert len(kept.collect()) == expected
        assert "skew=true" in kept._jdf.queryExecution().executedPlan().toString()
        counts = daily_segment_orders(hot.orders, hot.customer)
        by_hand = {}
        segments = dict(hot.rows[0])
        for _, customer, when in hot.rows[1]:
            if customer in segments:
                key = segments[customer], day(when)
                by_hand[key] = by_hand.get(key, 0) + 1
        assert {(r.c_mktsegment, r.o_orderdate): r.order_count for r in counts.collect()} == by_hand
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_hot_order_is_split_in_the_ledger(spark, hot):
    """The join of the raw lines with their orders, forced through shuffles."""
    expected = sorted(hot.entries())
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "200",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        entries = ledger.ledger_entries(hot.orders, hot.lineitem.repartition(8))
        assert sorted((r.order_key, r.event_date, r.amount, r.is_order) for r in entries.collect()) == expected
        assert "skew=true" in entries._jdf.queryExecution().executedPlan().toString()
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def test_totals_are_summed_before_the_shuffle(hot):
    plan = order_totals(hot.lineitem)._jdf.queryExecution().executedPlan().toString()
    exchange = plan.index("Exchange hashpartitioning(l_orderkey")
    assert "partial_sum" in plan[exchange:] and "partial_sum" not in plan[:exchange]
