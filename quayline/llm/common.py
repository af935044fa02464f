"""What several operators share: slices of long columns, gathered words, tables written on the
way and gapless numbers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import os
from collections.abc import Callable, Iterator
from functools import wraps
from inspect import signature

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from quayline.storage import fresh_dir

SLICE_BYTES = 8 << 20
# the folder that holds the library
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


# texts vary in length by orders of magnitude: a batch is bounded by its bytes
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def importable(spark: SparkSession) -> None:
    """Puts the library's folder on the path of Python workers, for sessions that were not
    started there, and keeps batches small.  Where executors have no such folder, ship the library
    with ``--py-files``."""
    if spark.conf.get(BATCH_BYTES, None) != str(SLICE_BYTES):
        spark.conf.set(BATCH_BYTES, str(SLICE_BYTES))
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([p for p in paths if p] + [ROOT])


def give_back() -> None:
    """Returns memory that a task has freed to the system: a worker lives on, for tasks of other kinds and
    beside other workers."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def _giving_back(function: Callable) -> Callable:
    """The function over a task's batches, which gives memory back at the end of the task."""

    @wraps(function)
    def run(batches: Iterator) -> Iterator:
        yield from function(batches)
        give_back()

    return run


def arrow_function(kind: str) -> Callable[[Callable], Callable]:
    """``arrow_udf`` for functions that workers import from here."""
    importable(SparkSession.active())

    def wrapped(function: Callable) -> Callable:
        by_batch = list(signature(function).parameters) == ["batches"]
        return F.arrow_udf(_giving_back(function) if by_batch else function, kind)

    return wrapped


def map_batches(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` for functions that workers import from here."""
    importable(df.sparkSession)
    return df.mapInArrow(_giving_back(function), schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def plain_strings(column: pa.Array) -> pa.Array:
    """The column with 64-bit offsets, null as the empty string."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about ``limit`` bytes: what a task holds does not follow the batch.
    A longer text is a slice of its own."""
    if not len(column):
        return
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset + 1 : column.offset + len(column) + 1]
    first, start = 0, int(np.frombuffer(column.buffers()[1], np.int64)[column.offset])
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(ends, start + limit, side="right")))
        yield column.slice(first, last - first)
        first, start = last, int(ends[last - 1])


def as_bytes(column: pa.Array) -> Iterator[bytes]:
    """Every text as UTF-8."""
    for part in slices(plain_strings(column)):
        yield from part.cast(pa.large_binary()).to_pylist()


def gather(flat: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat`` (piece i has ``lengths[i]`` items) laid end to end in the order of
    ``picks``; and where each picked piece ends."""
    starts = np.cumsum(lengths) - lengths
    own = lengths[picks]
    ends = np.cumsum(own)
    # indices of slices, which are small: 32 bits halve the largest arrays here
    kind = np.int32 if max(len(flat), int(ends[-1]) if len(ends) else 0) < 1 << 31 else np.int64
    index = np.repeat((starts[picks] - (ends - own)).astype(kind), own)
    index += np.arange(len(index), dtype=kind)
    return flat[index], ends


def stored(df: DataFrame, label: str) -> DataFrame:
    """The rows, written to the shared folder and read from there: later steps neither repeat
    the work nor depend on the executors that did it."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_in_blocks(df: DataFrame, label: str) -> DataFrame:
    """``stored`` with ``_block`` (the task that wrote a row) and ``_row`` (unique)."""
    numbered = df.withColumns({"_block": F.spark_partition_id(), "_row": F.monotonically_increasing_id()})
    return stored(numbered, label)


def ranked(blocks: DataFrame, key: str) -> DataFrame:
    """``stored_in_blocks`` rows with ``_rank``: gapless from 0 within each ``key``.

    Blocks are counted first; only the rows of one key and one block are numbered together, so
    a key with a third of all rows is spread over all blocks."""
    counts = blocks.groupBy(key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col(key).alias("_key"), F.col("_block").alias("_in"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base")
    )
    within = F.row_number().over(Window.partitionBy(key, "_block").orderBy("_row"))
    numbered = blocks.withColumn("_place", within)
    same = numbered[key].eqNullSafe(bases["_key"]) & (numbered["_block"] == bases["_in"])
    return numbered.join(bases, same).withColumn("_rank", F.col("_base") + F.col("_place") - 1).drop("_key", "_in", "_base", "_place")
