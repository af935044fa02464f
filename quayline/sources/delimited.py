"""Delimited text: scans, streams and sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StringType

SEPARATOR = "|"

# PERMISSIVE keeps every row: a field that does not parse becomes null, a short row is padded
# with nulls, the empty field behind a trailing separator is ignored, blank lines are skipped.
# Blanks around a field are no part of it.
OPTIONS = {
    "sep": SEPARATOR,
    "mode": "PERMISSIVE",
    "header": "false",
    "dateFormat": "yyyy-MM-dd",
    "ignoreLeadingWhiteSpace": "true",
    "ignoreTrailingWhiteSpace": "true",
}


def read_delimited(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    return spark.read.schema(schema).options(**OPTIONS).csv(path)


def stream_delimited(
    spark: SparkSession, path: str, schema: str, max_files: int | None = None
) -> DataFrame:
    reader = spark.readStream.schema(schema).options(**OPTIONS)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(path)


def write_delimited(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).options(sep=SEPARATOR, header="false", dateFormat="yyyy-MM-dd").csv(path)


def sort_rows(
    df: DataFrame, columns: list[int | str], tiebreak: list[str] | None = None
) -> DataFrame:
    """Global ascending sort by the text of ``columns`` (positions or names), missing first.

    ``tiebreak`` columns follow the sort key; the default is all others.  They make the order
    repeatable, and they let the range partitioner split a value that holds a large share of
    the rows (a single date).
    """
    names = [df.columns[c] if isinstance(c, int) else c for c in columns]
    if tiebreak is None:
        tiebreak = [c for c in df.columns if c not in names]

    def as_text(name: str) -> Column:
        kind = df.schema[name].dataType
        # ISO dates sort the same as their text
        return F.col(name) if isinstance(kind, (StringType, DateType)) else F.col(name).cast("string")

    keys = [as_text(n).asc_nulls_first() for n in names]
    return df.orderBy(*keys, *[F.col(t).asc_nulls_first() for t in tiebreak])


def write_sorted(
    df: DataFrame, path: str, columns: list[int | str], tiebreak: list[str] | None = None
) -> None:
    """Part files in global order: file n ends where file n+1 begins."""
    write_delimited(sort_rows(df, columns, tiebreak), path)
