"""Runs a report and prints its first rows.

    python -m quayline q3 --data /data/tpch --format delimited
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quayline.plans.catalogue import PLANS
from quayline.session import BASE_CONF, cluster_conf
from quayline.sources import schemas
from quayline.sources.tables import Tables
from quayline.storage import stored_bytes


def input_bytes(spark: SparkSession, data: str, suffix: str) -> int:
    """Bytes of all tables a report may read."""
    return sum(stored_bytes(spark, f"{data}/{name}.{suffix}") for name in [*schemas.TABLES, "documents"])


def sized_for(spark: SparkSession, data: str, table_format: str) -> None:
    """Shuffles, splits and the state store by the size of the input."""
    suffix = "parquet" if table_format == "parquet" else "csv"
    for key, value in cluster_conf(input_bytes(spark, data, suffix)).items():
        spark.conf.set(key, value)


def main() -> None:
    parser = argparse.ArgumentParser(prog="python -m quayline")
    parser.add_argument("report", choices=sorted(PLANS))
    parser.add_argument("--data", required=True, help="folder of the tables")
    parser.add_argument("--format", choices=["parquet", "delimited"], default="parquet")
    parser.add_argument("--rows", type=int, default=20, help="rows to print")
    args = parser.parse_args()

    # master and resources come from spark-submit or the Spark defaults
    builder = SparkSession.builder.appName(f"quayline {args.report}")
    for key, value in BASE_CONF.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    sized_for(spark, args.data, args.format)
    PLANS[args.report](Tables(spark, args.data, args.format)).show(args.rows, truncate=False)
    spark.stop()


if __name__ == "__main__":
    main()
