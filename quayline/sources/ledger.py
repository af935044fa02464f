"""The ledger as a stored table: date-ordered Parquet, or the delimited exchange file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from quayline.functions.money import to_cents
from quayline.operators.ledger import in_ledger_order, ledger_of_months, touched_months
from quayline.sources import schemas
from quayline.sources.delimited import SEPARATOR, read_delimited, stream_delimited, write_delimited

MONTH = "event_month"
COLUMNS = ["order_key", "cust_key", "amount", "event_date", "is_order"]
# every field as it stands in the file
_TEXT = ", ".join(f"{c} STRING" for c in COLUMNS)


def write_ledger(ledger: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Range-partitioned by date, so that an as-of read skips the files after its date."""
    in_ledger_order(ledger.select(*COLUMNS)).write.mode(mode).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.LEDGER).parquet(path)


def write_ledger_months(ledger: DataFrame, path: str) -> None:
    """Replaces the event months that ``ledger`` has entries of and leaves all others as they are:
    one folder per month, its files in ledger order."""
    month = F.date_format("event_date", "yyyy-MM").alias(MONTH)
    rows = in_ledger_order(ledger.select(*COLUMNS)).select(*COLUMNS, month)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)


def read_ledger_months(spark: SparkSession, path: str) -> DataFrame:
    """All entries, and ``event_month`` by which folders are skipped."""
    return spark.read.schema(f"{schemas.LEDGER}, {MONTH} STRING").parquet(path)


def extend_ledger(path: str, orders: DataFrame, lines: DataFrame, new_orders: DataFrame, new_lines: DataFrame) -> list[str]:
    """Brings the stored ledger up to date after orders and lines were added, and returns the months
    that were written: those of the new rows, and those of the orders that have new lines,
    because an order's entry is its whole revenue.  ``orders`` and ``lines`` hold the new rows too.

    The months, bounded by the calendar, come to the driver; a repeated or broken-off run writes the
    same months again."""
    months = sorted(r.month for r in touched_months(orders, lines, new_orders, new_lines).collect())
    if months:
        write_ledger_months(ledger_of_months(orders, lines, months), path)
    return [f"{m:%Y-%m}" for m in months]


def write_ledger_text(ledger: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``order_key|cust_key|amount|event_date|is_order``, amounts with two decimals."""
    rows = ledger.select(*COLUMNS).withColumn("amount", to_cents("amount").cast("decimal(38,2)"))
    write_delimited(in_ledger_order(rows), path, mode)


def _typed(text: DataFrame) -> DataFrame:
    """Fields as types, null where one does not parse.  As in the writer's language, any flag
    other than ``true`` means a line entry."""
    kinds = {f.name: f.dataType for f in StructType.fromDDL(schemas.LEDGER)}
    fields = {c: F.trim(c).try_cast(kinds[c]) for c in COLUMNS[:-1]}
    fields["is_order"] = F.lower(F.trim("is_order")).eqNullSafe("true")
    return text.select(
        *[v.alias(c) for c, v in fields.items()], F.concat_ws(SEPARATOR, *COLUMNS).alias("line")
    )


_COMPLETE = " AND ".join(f"{c} IS NOT NULL" for c in COLUMNS[:-1])


def ledger_rows(text: DataFrame) -> DataFrame:
    """Ledger entries from rows of text fields, of a table or a stream.

    A row whose key, date or amount does not parse fails the job: an entry that goes missing
    changes a balance and nobody would see it.  ``ledger_rejects`` lists such rows.
    """
    broken = F.raise_error(F.concat(F.lit("not a ledger entry: "), F.col("line"))).cast("boolean")
    return _typed(text).where(F.when(F.expr(_COMPLETE), True).otherwise(broken)).select(*COLUMNS)


def read_ledger_text(spark: SparkSession, path: str, skip_rejects: bool = False) -> DataFrame:
    """The entries of an exchange file.  With ``skip_rejects`` the caller has looked at
    ``ledger_rejects`` and wants the others."""
    text = read_delimited(spark, path, _TEXT)
    return _typed(text).where(_COMPLETE).select(*COLUMNS) if skip_rejects else ledger_rows(text)


def ledger_rejects(spark: SparkSession, path: str) -> DataFrame:
    """The rows of an exchange file that are no entries: ``line``."""
    return _typed(read_delimited(spark, path, _TEXT)).where(f"NOT ({_COMPLETE})").select("line")


def stream_ledger_text(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``read_ledger_text`` for files as they arrive, with the same parser."""
    return ledger_rows(stream_delimited(spark, path, _TEXT, max_files))
