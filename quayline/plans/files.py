"""Tables written as ``|``-delimited text and scanned back."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from quayline.operators.ledger import in_ledger_order, ledger_entries
from quayline.operators.orders import orders_of_segment
from quayline.plans.shipping_priority import SEGMENT
from quayline.sources import schemas
from quayline.sources.clustered import ClusteredTables, buckets_for, write_clustered
from quayline.sources.delimited import SEPARATOR, read_delimited, sort_rows, write_delimited, write_sorted
from quayline.sources.ledger import MONTH, extend_ledger, read_ledger, read_ledger_months, read_ledger_text, write_ledger, write_ledger_text
from quayline.sources.tables import Tables
from quayline.storage import fresh_dir, stored_bytes

# the registered increments of the ledger, and the fewest buckets of the registered clustered tables
INCREMENTS = (dt.date(1996, 7, 1), dt.date(1998, 1, 1))
BUCKETS = 16


def in_layout(table: DataFrame, schema: str) -> DataFrame:
    """The columns of a file layout in file order; columns the table lacks are empty."""
    fields = StructType.fromDDL(schema).fields
    return table.select(
        *[
            (F.col(f.name) if f.name in table.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in fields
        ]
    )


def delimited_scan(tables: Tables, name: str) -> DataFrame:
    """The table through a delimited file, back in the columns it came with."""
    table = tables.read(name)
    schema = schemas.TABLES[name]
    path = fresh_dir(tables.spark, name)
    write_delimited(in_layout(table, schema), path)
    scanned = read_delimited(tables.spark, path, schema)
    return scanned.select([c for c in scanned.columns if c in table.columns])


def ledger_text(tables: Tables, segment: str = SEGMENT) -> DataFrame:
    """The segment's ledger through its exchange file (amounts in whole cents)."""
    path = fresh_dir(tables.spark, "ledger-text")
    orders = orders_of_segment(tables.orders, tables.customer, segment)
    write_ledger_text(ledger_entries(orders, tables.lineitem), path)
    return read_ledger_text(tables.spark, path)


def ledger_stored(tables: Tables, segment: str = SEGMENT) -> DataFrame:
    """The segment's exact ledger through its stored, date-ordered table."""
    path = fresh_dir(tables.spark, "ledger")
    orders = orders_of_segment(tables.orders, tables.customer, segment)
    write_ledger(ledger_entries(orders, tables.lineitem), path)
    return read_ledger(tables.spark, path)


def _of_segment(tables: Tables, segment: str) -> tuple[DataFrame, DataFrame]:
    """The segment's orders and their lines, stored: increments go through them several times, and what they
    shuffle are these rows only."""
    path = fresh_dir(tables.spark, "segment")
    own = orders_of_segment(tables.orders, tables.customer, segment).select("o_orderkey", "o_custkey", "o_orderdate")
    own.write.parquet(f"{path}/orders")
    orders = tables.spark.read.schema(own.schema).parquet(f"{path}/orders")
    keys = orders.select(F.col("o_orderkey").alias("l_orderkey"))
    lines = tables.lineitem.select("l_orderkey", "l_extendedprice", "l_discount", "l_shipdate").join(keys, "l_orderkey", "left_semi")
    lines.write.parquet(f"{path}/lineitem")
    return orders, tables.spark.read.schema(lines.schema).parquet(f"{path}/lineitem")


def ledger_incremental(tables: Tables, segment: str = SEGMENT, cuts: tuple[dt.date, ...] = INCREMENTS) -> DataFrame:
    """The segment's ledger stored month by month in increments: before each of ``cuts``, and in the end, the
    orders placed and the lines shipped since the last one are added.  In ledger order."""
    path = fresh_dir(tables.spark, "ledger-months")
    orders, lines = _of_segment(tables, segment)
    bounds = [None, *cuts, None]
    for low, high in zip(bounds, bounds[1:]):

        def known(rows: DataFrame, day: str) -> DataFrame:
            return rows.where(F.col(day) < F.lit(high)) if high else rows

        def added(rows: DataFrame, day: str) -> DataFrame:
            new = known(rows, day)
            return new.where(F.col(day).isNull() | (F.col(day) >= F.lit(low))) if low else new

        extend_ledger(
            path, known(orders, "o_orderdate"), known(lines, "l_shipdate"), added(orders, "o_orderdate"), added(lines, "l_shipdate")
        )
    return in_ledger_order(read_ledger_months(tables.spark, path).drop(MONTH))


def clustered(tables: Tables, buckets: int | None = None) -> ClusteredTables:
    """The tables with orders and lines stored in buckets of the order key, as many as the lines' size asks for."""
    if buckets is None:
        most = int(tables.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
        lines = f"{tables.path}/lineitem.{'parquet' if tables.format == 'parquet' else 'csv'}"
        buckets = min(max(BUCKETS, buckets_for(stored_bytes(tables.spark, lines))), most)
    return write_clustered(tables, fresh_dir(tables.spark, "clustered"), buckets)


def orders_sorted_file(tables: Tables) -> DataFrame:
    """The orders through files in global date order."""
    path = fresh_dir(tables.spark, "orders-sorted")
    schema = schemas.TABLES["orders"]
    write_sorted(in_layout(tables.orders, schema), path, ["o_orderdate"])
    scanned = read_delimited(tables.spark, path, schema)
    return scanned.select([c for c in scanned.columns if c in tables.orders.columns])


def orders_untidy(tables: Tables, short: int = 3) -> DataFrame:
    """The orders through a file with blanks around the fields, blank lines between the rows, a
    separator behind them and, for every ``short``-th order, nothing behind the date."""
    path = fresh_dir(tables.spark, "orders-untidy")
    schema = schemas.TABLES["orders"]
    names = StructType.fromDDL(schema).fieldNames()
    fields = [F.concat(F.lit("  "), F.coalesce(F.col(n).cast("string"), F.lit("")), F.lit(" ")) for n in names]
    cut = names.index("o_orderdate") + 1
    line = F.when(F.col("o_orderkey") % short == 0, F.concat_ws(SEPARATOR, *fields[:cut])).otherwise(
        F.concat(F.concat_ws(SEPARATOR, *fields), F.lit(SEPARATOR))
    )
    rows = in_layout(tables.orders, schema).select(F.explode(F.array(line, F.lit(""), F.lit("   "))).alias("value"))
    rows.write.text(path)
    scanned = read_delimited(tables.spark, path, schema)
    return scanned.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


def orders_by_date(tables: Tables) -> DataFrame:
    return sort_rows(tables.orders, ["o_orderdate"], tiebreak=["o_orderkey"])


def lines_by_ship_date(tables: Tables) -> DataFrame:
    return sort_rows(
        tables.lineitem, ["l_shipdate"], tiebreak=["l_orderkey", "l_linenumber", "l_partkey"]
    )
