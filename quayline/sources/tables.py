"""The three tables every report starts from, from Parquet or delimited text."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from quayline.functions.dates import event_time_to_day
from quayline.sources import schemas
from quayline.sources.delimited import read_delimited


def days_as_dates(df: DataFrame) -> DataFrame:
    """Timestamp columns to DATE, their UTC day.  Comparisons of time-zone-free columns with dates
    still reach the Parquet reader."""
    stamps = {}
    for field in df.schema:
        if isinstance(field.dataType, TimestampNTZType):
            stamps[field.name] = F.col(field.name).cast("date")
        elif isinstance(field.dataType, TimestampType):
            # a cast would take the day of the session's time zone
            stamps[field.name] = event_time_to_day(field.name)
    return df.withColumns(stamps) if stamps else df


def with_ship_priority(orders: DataFrame) -> DataFrame:
    """Data sets without ``o_shippriority`` get the benchmark's constant 0."""
    if "o_shippriority" in orders.columns:
        return orders
    return orders.withColumn("o_shippriority", F.lit(0).cast("int"))


@dataclass(frozen=True)
class Tables:
    """``path`` holds ``<table>.parquet`` (format ``parquet``) or ``<table>.csv`` with
    ``|``-separated fields (format ``delimited``); either may be a file or a folder."""

    spark: SparkSession
    path: str
    format: str = "parquet"

    def read(self, name: str) -> DataFrame:
        if self.format == "parquet":
            return days_as_dates(self.spark.read.parquet(f"{self.path}/{name}.parquet"))
        if self.format == "delimited":
            return read_delimited(self.spark, f"{self.path}/{name}.csv", schemas.TABLES[name])
        raise ValueError(f"unknown table format {self.format!r}")

    @cached_property
    def customer(self) -> DataFrame:
        return self.read("customer")

    @cached_property
    def orders(self) -> DataFrame:
        return with_ship_priority(self.read("orders"))

    @cached_property
    def lineitem(self) -> DataFrame:
        return self.read("lineitem")

    @cached_property
    def documents(self) -> DataFrame:
        return self.read("documents")

    def create_views(self) -> None:
        """Temp views ``customer``, ``orders`` and ``lineitem`` for plain ``spark.sql``."""
        for name in schemas.TABLES:
            getattr(self, name).createOrReplaceTempView(name)
