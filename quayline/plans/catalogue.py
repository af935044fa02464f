"""Every report by name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from quayline.operators import orders as o, words as w
from quayline.plans import files, fulfilment, live, shipping_priority as sp
from quayline.sources.tables import Tables

Plan = Callable[[Tables], DataFrame]

PLANS: dict[str, Plan] = {
    # shipping priority
    "q3": sp.q3,
    "q3_ranked": sp.q3_ranked,
    "q3_dataflow": sp.q3_dataflow,
    "q3_dataflow_top": sp.q3_dataflow_top,
    "q3_report": sp.q3_report,
    # filters, joins, aggregates, sorts
    "line_revenue": lambda t: o.line_revenues(t.lineitem),
    "segment_customers": lambda t: o.segment_customers(t.customer, sp.SEGMENT),
    "segment_orders": lambda t: o.orders_of_segment(t.orders, t.customer, sp.SEGMENT),
    "order_totals": lambda t: o.order_totals(t.lineitem),
    "order_totals_joined": lambda t: o.orders_with_totals(
        t.orders.select("o_orderkey", "o_custkey", "o_orderdate"), t.lineitem
    ),
    "daily_order_totals": lambda t: o.best_days(t.orders),
    "daily_segment_orders": lambda t: o.daily_segment_orders(t.orders, t.customer),
    "orders_sorted": files.orders_by_date,
    "lineitem_sorted": files.lines_by_ship_date,
    # delimited files
    "scan_delimited": lambda t: files.delimited_scan(t, "orders"),
    "scan_delimited_customer": lambda t: files.delimited_scan(t, "customer"),
    "scan_delimited_untidy": files.orders_untidy,
    "orders_sorted_file": files.orders_sorted_file,
    "scan_delimited_lineitem": lambda t: files.delimited_scan(t, "lineitem"),
    "ledger_delimited": files.ledger_text,
    "ledger_stored": files.ledger_stored,
    "ledger_incremental": files.ledger_incremental,
    # orders and lines in buckets of the order key
    "q3_clustered": lambda t: sp.q3(files.clustered(t)),
    "day_deltas_clustered": lambda t: fulfilment.day_deltas(files.clustered(t)),
    # ledger and balances
    "ledger_exact": fulfilment.ledger_exact,
    "ledger_rounded": fulfilment.ledger_rounded,
    "ledger_residuals": fulfilment.ledger_residuals,
    "day_deltas": fulfilment.day_deltas,
    "balance_history": fulfilment.balance_history,
    "ledger_asof_open": fulfilment.open_orders,
    # boards
    "leaderboard_asof": fulfilment.leaderboard,
    "leaderboard_two_phase": fulfilment.leaderboard_two_phase,
    "bounded_asof": fulfilment.leaderboard_bounded,
    "leaderboard_history": fulfilment.leaderboard_history,
    "leaderboard_daily": fulfilment.leaderboard_daily,
    # words
    "word_count": lambda t: w.word_count(t.documents),
    "word_count_running": lambda t: w.running_word_count(t.documents),
    # streams run to the end of the data
    "stream_leaderboard_asof": live.leaderboard_of_ledger_stream,
    "stream_ledger_delimited": live.leaderboard_of_ledger_text,
    "stream_late_orders": live.late_orders_stream,
    "stream_leaderboard_refresh": live.leaderboard_of_refreshes,
    "stream_leaderboard_two_phase": live.leaderboard_of_two_streams,
    "stream_bounded_asof": live.leaderboard_of_versions,
    "stream_enriched_deltas": live.enriched_entries_stream,
    "stream_corrected_deltas": live.corrected_deltas_stream,
    "stream_daily_segment_orders": live.daily_segment_orders_stream,
    "stream_word_count": live.word_count_stream,
}
