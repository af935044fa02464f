"""Words of a line and report lines."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def words_of(text: str | Column) -> Column:
    """The single-space separated pieces of a line.

    Runs of spaces give empty words between words and before the first one, but not after the
    last.  An empty line is one empty word; a line of spaces only has no words.
    """
    column = F.col(text) if isinstance(text, str) else text
    trimmed = F.rtrim(column)
    pieces = F.split(trimmed, " ")
    return F.when((trimmed == "") & (column != ""), F.array().cast("array<string>")).otherwise(pieces)


def rank_line(rank: str, key: str, revenue: str, day: str) -> Column:
    """Fixed-width report line of a ranked order."""
    # fixed value: the report's line format
    return F.format_string(
        "Rank %2d | orderKey: %8d | Revenue: %10.2f | orderDate: %s",
        F.col(rank),
        F.col(key),
        F.round(revenue, 2).cast("double"),
        F.date_format(day, "yyyy-MM-dd"),
    )
