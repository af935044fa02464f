"""Event-time streams over folders of Parquet files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType

from quayline.functions.dates import day_to_event_time
from quayline.sources.tables import days_as_dates
from quayline.storage import is_folder

EVENT_TIME = "event_ts"


def stream_table(
    spark: SparkSession, path: str, schema=None, max_files: int | None = None
) -> DataFrame:
    """A table (one Parquet file or a folder of them) as a stream, timestamps as dates.  The
    schema is taken from the files already there unless given."""
    if not is_folder(spark, path):
        # as a plain path the source takes folders only: a pattern that matches the one file
        folder, _, name = path.rpartition("/")
        path = "/".join([folder, "".join(f"[{c}]" if c.isalnum() else f"\\{c}" for c in name)])
    reader = spark.readStream.schema(schema or spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return days_as_dates(reader.parquet(path))


def with_event_time(stream: DataFrame, day: str, delay: str = "0 seconds") -> DataFrame:
    """Event time of day-granular rows.  ``delay`` is how far behind the newest day rows may
    still arrive; older ones are dropped (and counted in the query's progress)."""
    return stream.withColumn(EVENT_TIME, day_to_event_time(day)).withWatermark(EVENT_TIME, delay)


# the end of a feed: later than any day of it
END = dt.date(9999, 12, 30)


def ended(stream: DataFrame, day: str, root: str, end: dt.date = END) -> DataFrame:
    """The stream of a finite feed with its end: a marker row on the day ``end``, that date in all date columns and
    zeros beside them, moves the watermark behind all earlier days, so that the newest of them is finished
    too.  The marker's own day never is.  ``root`` is a folder for the marker, which is there before the query
    starts."""
    spark = stream.sparkSession
    # no nulls: a filter that a join implies would take the row before the watermark
    marker = [
        (F.lit(end) if isinstance(f.dataType, DateType) else F.lit("0").cast(f.dataType)).alias(f.name) for f in stream.schema
    ]
    spark.range(1).select(*marker).coalesce(1).write.parquet(f"{root}/end")
    return stream.unionByName(stream_table(spark, f"{root}/end", stream.schema))
