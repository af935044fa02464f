"""Column layouts of the ``|``-delimited files."""

# fixed values: the benchmark's table layouts, in file order
CUSTOMER = """
    c_custkey BIGINT, c_name STRING, c_address STRING, c_nationkey INT, c_phone STRING,
    c_acctbal DECIMAL(15,2), c_mktsegment STRING, c_comment STRING
"""
ORDERS = """
    o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DECIMAL(15,2),
    o_orderdate DATE, o_orderpriority STRING, o_clerk STRING, o_shippriority INT,
    o_comment STRING
"""
LINEITEM = """
    l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT,
    l_quantity DECIMAL(15,2), l_extendedprice DECIMAL(15,2), l_discount DECIMAL(15,2),
    l_tax DECIMAL(15,2), l_returnflag STRING, l_linestatus STRING, l_shipdate DATE,
    l_commitdate DATE, l_receiptdate DATE, l_shipinstruct STRING, l_shipmode STRING,
    l_comment STRING
"""
LEDGER = """
    order_key BIGINT, cust_key BIGINT, amount DECIMAL(38,4), event_date DATE,
    is_order BOOLEAN
"""

TABLES = {"customer": CUSTOMER, "orders": ORDERS, "lineitem": LINEITEM}
