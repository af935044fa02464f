"""The registered queries as plain SQL over the same tables, to check results against.

Money is DECIMAL(15,2) before arithmetic and DOUBLE in the result; dates are ISO text.
"""

from __future__ import annotations

MONEY = "DECIMAL(15,2)"


def money(column: str) -> str:
    return f"CAST({column} AS {MONEY})"


def amount(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def day(expression: str) -> str:
    return f"CAST(CAST({expression} AS DATE) AS VARCHAR)"


# every line with its exact revenue, every order of the segment
BASE = f"""
    line AS (
        SELECT l_orderkey, l_linenumber, CAST(l_shipdate AS DATE) AS shipdate,
               {money('l_extendedprice')} * (1 - {money('l_discount')}) AS revenue
        FROM lineitem
    ),
    placed AS (
        SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS orderdate
        FROM orders JOIN customer ON o_custkey = c_custkey
        WHERE c_mktsegment = 'BUILDING'
    ),
    total AS (SELECT l_orderkey, sum(revenue) AS revenue FROM line GROUP BY l_orderkey)
"""

LEDGER = f"""
    {BASE},
    ledger AS (
        SELECT o_orderkey AS order_key, o_custkey AS cust_key, coalesce(revenue, 0) AS amount,
               orderdate AS event_date, true AS is_order
        FROM placed LEFT JOIN total ON l_orderkey = o_orderkey
        UNION ALL
        SELECT l_orderkey, o_custkey, -revenue, shipdate, false
        FROM line JOIN placed ON l_orderkey = o_orderkey
    )
"""

DELTAS = f"""
    {LEDGER},
    delta AS (
        SELECT order_key, orderdate AS order_date, event_date, sum(amount) AS amount
        FROM ledger JOIN placed ON o_orderkey = order_key
        GROUP BY order_key, orderdate, event_date
    )
"""

HISTORY = f"""
    {DELTAS},
    history AS (
        SELECT order_key, order_date, event_date,
               sum(amount) OVER (PARTITION BY order_key ORDER BY event_date
                                 ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance,
               lead(event_date) OVER (PARTITION BY order_key ORDER BY event_date) AS next_date
        FROM delta
    )
"""

REMAINING = f"""
    SELECT l_orderkey, sum(line.revenue) AS revenue, orderdate, 0 AS o_shippriority
    FROM line JOIN placed ON l_orderkey = o_orderkey
    WHERE orderdate < DATE '1995-03-15' AND shipdate > DATE '1995-03-15'
    GROUP BY l_orderkey, orderdate
"""


def q3(rank: str = "") -> str:
    return f"""
        WITH {BASE}, remaining AS ({REMAINING})
        SELECT l_orderkey, {amount('revenue')} AS revenue, {day('orderdate')} AS o_orderdate,
               o_shippriority {rank}
        FROM remaining
        ORDER BY remaining.revenue DESC, orderdate, l_orderkey LIMIT 10
    """


def open_balances(condition: str) -> str:
    return f"""
        SELECT order_key, sum(amount) AS balance, max(CASE WHEN is_order THEN event_date END) AS order_date
        FROM ledger WHERE {condition}
        GROUP BY order_key HAVING sum(amount) > 0.01
    """


def board(balances: str, tables: str = LEDGER, extra: str = "") -> str:
    return f"""
        WITH {tables}, balances AS ({balances})
        SELECT order_key, {amount('balance')} AS balance, {day('order_date')} AS order_date,
               {extra} row_number() OVER (ORDER BY balances.balance DESC, order_key) AS rank
        FROM balances ORDER BY rank LIMIT 10
    """


def scan(table: str, columns: dict[str, str]) -> str:
    return f"SELECT {', '.join(f'{e} AS {c}' for c, e in columns.items())} FROM {table}"


CENTS = {c: amount(money(c)) for c in (
    "c_acctbal", "o_totalprice", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
)}
DAYS = {c: day(c) for c in ("o_orderdate", "l_shipdate")}
CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
LINEITEM = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
]


def columns(names: list[str], exact: bool) -> dict[str, str]:
    forms = {**DAYS, **(CENTS if exact else {})}
    return {name: forms.get(name, name) for name in names}


ROUNDED = f"""
    WITH {LEDGER}
    SELECT order_key, cust_key, {amount('round(amount, 2)')} AS amount, {day('event_date')} AS event_date,
           is_order
    FROM ledger
"""

WORDS = """
    doc AS (
        SELECT doc_id, CASE WHEN text <> '' AND regexp_replace(text, ' +$', '') = '' THEN []
                            ELSE string_split(regexp_replace(text, ' +$', ''), ' ') END AS words
        FROM documents
    ),
    occurrence AS (
        SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS pos FROM doc
    )
"""
WORD_COUNT = f"WITH {WORDS} SELECT word, count(*) AS n FROM occurrence GROUP BY word"

SEGMENT_DAYS = f"""
    SELECT c_mktsegment, {day('o_orderdate')} AS o_orderdate, count(*) AS order_count
    FROM orders JOIN customer ON o_custkey = c_custkey
    {{condition}}
    GROUP BY c_mktsegment, o_orderdate
"""

# the boards of a stream stand at the day before its newest entry
STREAMED = """
    event_date < (SELECT max(event_date) FROM ledger WHERE event_date <= DATE '1998-06-30')
"""

SQL: dict[str, str] = {
    "q3": q3(),
    "q3_ranked": q3(
        ", row_number() OVER (ORDER BY remaining.revenue DESC, orderdate, l_orderkey) AS rank"
    ),
    "q3_dataflow": f"""
        WITH {BASE}, remaining AS ({REMAINING})
        SELECT l_orderkey, {amount('revenue')} AS revenue, {day('orderdate')} AS o_orderdate, o_shippriority
        FROM remaining WHERE remaining.revenue > 0
    """,
    "q3_dataflow_top": f"""
        WITH {BASE}, remaining AS ({REMAINING})
        SELECT l_orderkey, {amount('revenue')} AS revenue, {day('orderdate')} AS o_orderdate, o_shippriority,
               row_number() OVER (ORDER BY remaining.revenue DESC, l_orderkey) AS rank
        FROM remaining WHERE remaining.revenue > 0 ORDER BY rank LIMIT 10
    """,
    "q3_report": f"""
        WITH {BASE}, remaining AS ({REMAINING}), ranked AS (
            SELECT row_number() OVER (ORDER BY revenue DESC, l_orderkey) AS rank, l_orderkey,
                   {amount('round(revenue, 2)')} AS revenue, {day('orderdate')} AS orderdate
            FROM remaining WHERE revenue > 0
        )
        -- fixed value: the report's line format
        SELECT rank, printf('Rank %2d | orderKey: %8d | Revenue: %10.2f | orderDate: %s',
                            rank, l_orderkey, revenue, orderdate) AS line
        FROM ranked WHERE rank <= 10
    """,
    "line_revenue": f"WITH {BASE} SELECT l_orderkey, l_linenumber, {amount('revenue')} AS revenue FROM line",
    "segment_customers": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "segment_orders": f"""
        SELECT o_custkey, o_orderkey, o_orderstatus, o_totalprice, {day('o_orderdate')} AS o_orderdate,
               o_orderpriority, 0 AS o_shippriority
        FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')
    """,
    "order_totals": f"WITH {BASE} SELECT l_orderkey, {amount('revenue')} AS revenue FROM total",
    "order_totals_joined": f"""
        WITH {BASE}
        SELECT o_orderkey, o_custkey, {day('o_orderdate')} AS o_orderdate,
               {amount('coalesce(revenue, 0)')} AS revenue
        FROM orders LEFT JOIN total ON l_orderkey = o_orderkey
    """,
    "daily_order_totals": f"""
        SELECT {day('o_orderdate')} AS o_orderdate, count(*) AS order_count,
               {amount(f"sum({money('o_totalprice')})")} AS daily_sum
        FROM orders GROUP BY orders.o_orderdate
        ORDER BY sum({money('o_totalprice')}) DESC, orders.o_orderdate LIMIT 5
    """,
    "daily_segment_orders": SEGMENT_DAYS.format(condition=""),
    "orders_sorted": scan("orders", columns(ORDERS, False) | {"o_shippriority": "0"}),
    "lineitem_sorted": scan("lineitem", columns(LINEITEM, False)),
    "scan_delimited": scan("orders", columns(ORDERS, True)),
    "scan_delimited_customer": scan("customer", columns(CUSTOMER, True)),
    "scan_delimited_lineitem": scan("lineitem", columns(LINEITEM, True)),
    "ledger_delimited": ROUNDED,
    "ledger_stored": ROUNDED.replace("round(amount, 2)", "amount"),
    "orders_sorted_file": scan("orders", columns(ORDERS, True) | {"o_shippriority": "0"}),
    "scan_delimited_untidy": f"""
        SELECT o_orderkey, o_custkey, {amount(money('o_totalprice'))} AS o_totalprice, {day('o_orderdate')} AS o_orderdate,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority
        FROM orders
    """,
    "ledger_exact": ROUNDED.replace("round(amount, 2)", "amount"),
    "ledger_rounded": ROUNDED,
    "ledger_residuals": f"""
        WITH {LEDGER}
        SELECT order_key, {amount('sum(round(amount, 2))')} AS residual
        FROM ledger GROUP BY order_key HAVING sum(round(amount, 2)) <> 0
    """,
    "day_deltas": f"""
        WITH {DELTAS}
        SELECT order_key, {day('order_date')} AS order_date, {day('event_date')} AS event_date,
               {amount('amount')} AS amount
        FROM delta
    """,
    "balance_history": f"""
        WITH {HISTORY}
        SELECT order_key, {day('order_date')} AS order_date, {day('event_date')} AS event_date,
               {amount('balance')} AS balance, {day('next_date')} AS next_date
        FROM history
    """,
    "ledger_asof_open": f"""
        WITH {LEDGER}, balances AS ({open_balances("event_date <= DATE '1998-06-30'")})
        SELECT order_key, {amount('balance')} AS balance, {day('order_date')} AS order_date FROM balances
    """,
    "leaderboard_asof": board(open_balances("event_date <= DATE '1998-06-30'")),
    "leaderboard_two_phase": board(open_balances("event_date <= DATE '1998-06-30'")),
    "bounded_asof": board(
        """
        SELECT order_key, balance, order_date
        FROM (
            SELECT *, row_number() OVER (PARTITION BY order_key ORDER BY event_date DESC) AS age,
                   row_number() OVER (PARTITION BY order_key, event_date <= DATE '1998-06-29'
                                      ORDER BY event_date DESC) AS pick
            FROM history WHERE event_date <= DATE '1998-06-30'
        )
        WHERE age <= 3 AND pick = 1 AND event_date <= DATE '1998-06-29' AND balance > 0.01
        """,
        HISTORY,
    ),
    "leaderboard_history": f"""
        WITH {HISTORY},
        month AS (
            SELECT CAST(unnest(generate_series(
                DATE '1995-01-01', (SELECT max(event_date) FROM ledger), INTERVAL 1 MONTH)) AS DATE) AS snapshot
        ),
        ranked AS (
            SELECT snapshot, order_key, order_date, balance,
                   row_number() OVER (PARTITION BY snapshot ORDER BY balance DESC, order_key) AS rank
            FROM history JOIN month
              ON event_date <= snapshot AND (next_date IS NULL OR next_date > snapshot)
            WHERE balance > 0.01
        )
        SELECT {day('snapshot')} AS snapshot_date, order_key, {day('order_date')} AS order_date,
               {amount('balance')} AS balance, rank
        FROM ranked WHERE rank <= 10
    """,
    "word_count": WORD_COUNT,
    "word_count_running": f"""
        WITH {WORDS}
        SELECT doc_id, pos, word,
               count(*) OVER (PARTITION BY word ORDER BY doc_id, pos
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running_count
        FROM occurrence
    """,
    "stream_leaderboard_asof": board(open_balances(STREAMED)),
    "stream_leaderboard_refresh": board(
        open_balances(STREAMED),
        extra=f"(SELECT {day('max(event_date)')} FROM ledger WHERE {STREAMED}) AS as_of,",
    ),
    "stream_leaderboard_two_phase": board(open_balances(STREAMED)),
    "stream_daily_segment_orders": SEGMENT_DAYS.format(condition=""),
    "stream_late_orders": f"""
        SELECT {day('o_orderdate')} AS o_orderdate, count(*) AS order_count, true AS late_dropped
        FROM orders WHERE NOT (o_orderkey % 50 = 0 AND o_orderdate < DATE '1997-01-01')
        GROUP BY orders.o_orderdate
    """,
    "stream_ledger_delimited": board(
        open_balances(STREAMED), LEDGER.replace("coalesce(revenue, 0)", "round(coalesce(revenue, 0), 2)").replace("-revenue,", "round(-revenue, 2),")
    ),
    "stream_enriched_deltas": f"""
        WITH {LEDGER}
        SELECT order_key, cust_key, {day('event_date')} AS event_date, {amount('sum(amount)')} AS amount
        FROM ledger JOIN placed ON o_orderkey = order_key
        WHERE orderdate <= DATE '1998-06-30' AND event_date < DATE '1998-06-30'
          AND order_key IN (SELECT l_orderkey FROM total)
        GROUP BY order_key, cust_key, ledger.event_date
    """,
    "stream_corrected_deltas": f"""
        WITH {LEDGER}
        SELECT order_key, {day('event_date')} AS event_date, {amount('sum(amount)')} AS amount,
               bool_or(order_key % 50 = 0 AND event_date < DATE '1997-01-01') AS corrected
        FROM ledger WHERE {STREAMED}
        GROUP BY order_key, ledger.event_date
    """,
    "stream_word_count": WORD_COUNT,
}
for name in ("ledger_incremental", "q3_clustered", "day_deltas_clustered"):
    # the same rows from tables that are stored otherwise
    SQL[name] = SQL[{"ledger_incremental": "ledger_exact"}.get(name, name.removesuffix("_clustered"))]
SQL["leaderboard_daily"] = SQL["leaderboard_history"].replace("INTERVAL 1 MONTH", "INTERVAL 1 DAY")
# remembering three balances inside the stream gives the same board
SQL["stream_bounded_asof"] = SQL["bounded_asof"]
