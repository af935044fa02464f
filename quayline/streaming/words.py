"""Running word counts of a stream of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from quayline.operators.words import word_count
from quayline.streaming.folding import Folds

COUNTS = "word STRING, n BIGINT"


def _newest(counts: DataFrame) -> DataFrame:
    """Counts only grow, so the newest count of a word is its largest."""
    return counts.groupBy("word").agg(F.max("n").alias("n"))


def start_word_count(lines: DataFrame, path: str, checkpoint: str, every: int = 20, **trigger) -> StreamingQuery:
    """After each micro-batch the new counts of the words it changed are published below
    ``path``; every ``every``-th batch folds them into one row per word."""
    published = Folds(path, COUNTS, every)
    return (
        word_count(lines)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .foreachBatch(lambda changed, number: published.add(changed, number, _newest))
        .start()
    )


def latest_counts(spark: SparkSession, path: str) -> DataFrame:
    """The newest count of every word."""
    return _newest(Folds(path, COUNTS).rows(spark))
