"""Results that a stream publishes batch by batch, kept in a bounded number of folders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from quayline.storage import folders, remove


@dataclass(frozen=True)
class Folds:
    """Rows of micro-batches below ``path``: every ``every``-th batch folds all rows so far into
    ``base/batch=n``, the others add ``recent/batch=n``.

    Batch n needs the newest base before it and what came since; older folders go when batch n
    starts, since batch n-1 is committed by then.  A repeated batch rewrites its own folder.
    """

    path: str
    schema: str
    every: int = 20

    def _base(self, number: int) -> int:
        """The fold that batch ``number`` builds on, negative for the first batch."""
        return (number - 1) // self.every * self.every if number > 0 else -1

    def _read(self, spark: SparkSession, first: int, last: int) -> DataFrame:
        """The base ``first`` and the recent rows after it, up to batch ``last``."""
        paths = [f"{self.path}/base/batch={first}"]
        paths += [f"{self.path}/recent/batch={n}" for n in range(first + 1, last + 1)]
        return spark.read.schema(self.schema).parquet(*paths)

    def before(self, spark: SparkSession, number: int) -> DataFrame | None:
        """All rows before batch ``number``."""
        return None if number == 0 else self._read(spark, self._base(number), number - 1)

    def add(self, rows: DataFrame, number: int, fold: Callable[[DataFrame], DataFrame]) -> None:
        spark = rows.sparkSession
        self._expire(spark, self._base(number))
        if number % self.every:
            rows.write.mode("overwrite").parquet(f"{self.path}/recent/batch={number}")
            return
        earlier = self.before(spark, number)
        everything = rows if earlier is None else earlier.unionByName(rows)
        fold(everything).write.mode("overwrite").parquet(f"{self.path}/base/batch={number}")

    def _expire(self, spark: SparkSession, base: int) -> None:
        for kind, keep_from in (("base", base), ("recent", base + 1)):
            for name in folders(spark, f"{self.path}/{kind}"):
                if int(name.partition("=")[2]) < keep_from:
                    remove(spark, f"{self.path}/{kind}/{name}")

    def rows(self, spark: SparkSession) -> DataFrame:
        """All rows published so far, folded or not."""
        bases = [int(n.partition("=")[2]) for n in folders(spark, f"{self.path}/base")]
        recent = [int(n.partition("=")[2]) for n in folders(spark, f"{self.path}/recent")]
        if not bases:
            return spark.createDataFrame([], self.schema)
        return self._read(spark, max(bases), max([max(bases), *recent]))
