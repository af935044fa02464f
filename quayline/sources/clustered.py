"""Orders and lines stored in buckets of the order key, sorted by it.

A table of ``n`` buckets is read with the partitioning that a shuffle by the key would give, so that sums per
order and joins on the order key plan without an exchange of the lines, job after job.  The buckets
are chosen once, for the size of the lines; a customer's or a day's share does not matter to
them, an order's does: its lines are one bucket's.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quayline.sources.tables import Tables

KEYS = {"orders": "o_orderkey", "lineitem": "l_orderkey"}
# stored bytes of lines in a bucket, about; in a task's memory they are some ten times as many
BUCKET_BYTES = 16 << 20


def buckets_for(input_bytes: int, bucket_bytes: int = BUCKET_BYTES) -> int:
    return max(8, -(-input_bytes // bucket_bytes))


@dataclass(frozen=True)
class ClusteredTables(Tables):
    """``Tables`` whose orders and lines are bucketed tables of the session's catalogue, called
    ``<prefix>_orders`` and ``<prefix>_lineitem``; the other tables are those of ``path``."""

    prefix: str = ""

    def read(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.prefix}_{name}") if name in KEYS else super().read(name)


def write_clustered(tables: Tables, root: str, buckets: int) -> ClusteredTables:
    """Writes both tables below ``root``, one file per bucket, and registers them."""
    prefix = f"clustered_{uuid.uuid4().hex[:12]}"
    for name, key in KEYS.items():
        rows = getattr(tables, name)
        # dealt out as the buckets are, so that a bucket is written by one task
        dealt = rows.repartition(buckets, key)
        dealt.write.format("parquet").bucketBy(buckets, key).sortBy(key).option("path", f"{root}/{name}").saveAsTable(f"{prefix}_{name}")
    return ClusteredTables(tables.spark, tables.path, tables.format, prefix)


def open_clustered(spark: SparkSession, tables: Tables, root: str, buckets: int) -> ClusteredTables:
    """The tables that ``write_clustered`` left below ``root``, in a session that does not know them."""
    prefix = f"clustered_{uuid.uuid4().hex[:12]}"
    for name, key in KEYS.items():
        schema = spark.read.parquet(f"{root}/{name}").schema
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
        spark.sql(
            f"CREATE TABLE {prefix}_{name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{root}/{name}'"
        )
    return ClusteredTables(spark, tables.path, tables.format, prefix)


def forget(tables: ClusteredTables) -> None:
    """Takes the tables out of the catalogue; the files stay."""
    for name in KEYS:
        tables.spark.sql(f"DROP TABLE IF EXISTS {tables.prefix}_{name}")
