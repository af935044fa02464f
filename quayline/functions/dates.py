"""Days as event time, independent of the session time zone."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

SECONDS_PER_DAY = 86_400


def day_to_event_time(day: str | Column) -> Column:
    """Midnight UTC of a DATE, which is where one-day windows start."""
    return F.timestamp_seconds(F.unix_date(day).cast("bigint") * SECONDS_PER_DAY)


def event_time_to_day(stamp: str | Column) -> Column:
    days = F.floor(F.unix_seconds(stamp) / SECONDS_PER_DAY).cast("int")
    return F.date_from_unix_date(days)


def month_start_on_or_after(day: Column) -> Column:
    first = F.trunc(day, "month")
    return F.when(first == day, day).otherwise(F.add_months(first, 1))


def iso_text(day: str | Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")
