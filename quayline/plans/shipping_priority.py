"""The shipping-priority question: which orders have the most revenue still to ship?"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from quayline.functions.text import rank_line
from quayline.operators.boards import with_rank
from quayline.operators.orders import order_totals, orders_of_segment, unshipped_orders
from quayline.sources.tables import Tables

# fixed values: the benchmark query's parameters
SEGMENT = "BUILDING"
DATE = dt.date(1995, 3, 15)
K = 10

# Lines arrive summed per order ({due}), which is what keeps the shuffle small and a hot order
# harmless; the outer sum is what the benchmark's query says and needs no further shuffle.
Q3 = """
    SELECT   o.o_orderkey AS l_orderkey, SUM(d.revenue) AS revenue, o.o_orderdate, o.o_shippriority
    FROM     {customer} c, {orders} o, {due} d
    WHERE    c.c_mktsegment = :segment
    AND      c.c_custkey = o.o_custkey
    AND      d.l_orderkey = o.o_orderkey
    AND      o.o_orderdate < :as_of
    GROUP BY o.o_orderkey, o.o_orderdate, o.o_shippriority
    ORDER BY revenue DESC, o.o_orderdate, l_orderkey
    LIMIT    {k}
"""


def q3(tables: Tables, segment: str = SEGMENT, as_of: dt.date = DATE, k: int = K) -> DataFrame:
    return tables.spark.sql(
        Q3,
        args={"segment": segment, "as_of": as_of},
        customer=tables.customer,
        orders=tables.orders,
        due=order_totals(tables.lineitem.where(F.col("l_shipdate") > F.lit(as_of))),
        k=k,
    )


def q3_ranked(tables: Tables, segment: str = SEGMENT, as_of: dt.date = DATE, k: int = K) -> DataFrame:
    return with_rank(
        q3(tables, segment, as_of, k), F.desc("revenue"), F.asc("o_orderdate"), F.asc("l_orderkey")
    )


def q3_dataflow(tables: Tables, segment: str = SEGMENT, as_of: dt.date = DATE) -> DataFrame:
    """The same question as a chain of operators, before the top-k: customers only filter the
    orders (an order appears once), and only positive remaining revenue counts."""
    orders = orders_of_segment(tables.orders, tables.customer, segment)
    return unshipped_orders(orders, tables.lineitem, as_of)


def q3_dataflow_top(
    tables: Tables, segment: str = SEGMENT, as_of: dt.date = DATE, k: int = K
) -> DataFrame:
    order = (F.desc("revenue"), F.asc("l_orderkey"))
    top = q3_dataflow(tables, segment, as_of).orderBy(*order).limit(k)
    return with_rank(top, *order)


def q3_report(tables: Tables, segment: str = SEGMENT, as_of: dt.date = DATE, k: int = K) -> DataFrame:
    """The ranked orders as printable lines."""
    top = q3_dataflow_top(tables, segment, as_of, k)
    return top.select("rank", rank_line("rank", "l_orderkey", "revenue", "o_orderdate").alias("line"))
