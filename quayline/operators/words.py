"""Word counts."""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from quayline.functions.text import words_of

# words that a block of lines holds, about: the most rows that are numbered together
WORDS_PER_BLOCK = 1_000_000


def words(lines: DataFrame, text: str = "text") -> DataFrame:
    return lines.select(F.explode(words_of(text)).alias("word"))


def word_count(lines: DataFrame, text: str = "text") -> DataFrame:
    """Frequent words are summed before the shuffle."""
    return words(lines, text).groupBy("word").agg(F.count("*").alias("n"))


def _cut(lines: DataFrame, order: str, parts: int) -> DataFrame:
    """Adds ``coarse``: the lines cut into about equal ranges of ``order``, null for no key."""
    probabilities = [i / parts for i in range(1, parts)]
    cuts = sorted(set(lines.approxQuantile(order, probabilities, 0.5 / parts))) if probabilities else []
    if not cuts:
        return lines.withColumn("coarse", F.when(F.col(order).isNotNull(), 0))
    splits = [float("-inf"), *cuts, float("inf")]
    stage = Bucketizer(splits=splits, inputCol=order, outputCol="coarse", handleInvalid="keep")
    return stage.transform(lines).withColumn("coarse", F.when(F.col(order).isNotNull(), F.col("coarse").cast("int")))


def in_blocks(lines: DataFrame, order: str, blocks: int) -> DataFrame:
    """Adds ``block``: the lines cut into about equal ranges of the numeric column ``order``,
    numbered in its order; ``order`` is null before all numbers.

    The cut points have two levels, each with about the root of ``blocks``: the coarse ones
    come to the driver, the fine ones are taken of every coarse range by the executors.  So
    uneven or sparse keys do not make uneven blocks, and the driver does not hold a number for
    each block.
    Lines without a key are spread by ``tie``, the hash that orders them.
    """
    parts = math.ceil(math.sqrt(blocks))
    cut = _cut(lines, order, parts)
    spread = (F.shiftrightunsigned("tie", 33) * F.lit(blocks) / F.lit(1 << 31)).cast("bigint")
    if parts == 1:
        fine = F.lit(0)
    else:
        shares = [i / parts for i in range(1, parts)]
        fine_cuts = (
            cut.where("coarse IS NOT NULL")
            .groupBy("coarse")
            .agg(F.percentile_approx(order, shares, 20 * parts).alias("fine_cuts"))
        )
        cut = cut.join(fine_cuts, "coarse", "left")
        fine = F.size(F.filter("fine_cuts", lambda c: c < F.col(order)))
    block = F.when(F.col("coarse").isNull(), spread - blocks).otherwise(F.col("coarse") * parts + fine)
    return cut.withColumn("block", block.cast("bigint")).drop("coarse", "fine_cuts")


def running_word_count(
    lines: DataFrame,
    order: str = "doc_id",
    text: str = "text",
    blocks: int | None = None,
    words_per_block: int = WORDS_PER_BLOCK,
) -> DataFrame:
    """For every word occurrence, how often the word has occurred up to and including it, in
    the order of the numeric column ``order`` (unique per line) and the position in the line.
    Lines without a key come before all others, in the order of a hash of their text.

    A window over all occurrences of a word would put a frequent word into one task.  The
    count is put together from the word's total in the earlier blocks of lines (a window over
    at most one row per block and word) and its place within the block.  The result does not
    depend on ``blocks``, only the size of the largest group does; by default there are as many
    blocks as the words, counted first, need at ``words_per_block``.
    """
    lines = lines.select(F.col(order), F.col(text), F.xxhash64(text).alias("tie"))
    if blocks is None:
        total = lines.agg(F.sum(F.size(words_of(text)).cast("bigint"))).first()[0] or 0
        blocks = max(1, math.ceil(total / words_per_block))
    occurrences = in_blocks(lines, order, blocks).select(
        order, "tie", "block", F.posexplode(words_of(text)).alias("pos", "word")
    )
    earlier = Window.partitionBy("word").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = (
        occurrences.groupBy("word", "block")
        .agg(F.count("*").alias("n"))
        .select("word", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    )
    unsigned: Column = F.col("tie").bitwiseXOR(F.lit(-(1 << 63)))
    place = F.row_number().over(Window.partitionBy("word", "block").orderBy(order, unsigned, "pos"))
    return (
        occurrences.withColumn("place", place)
        .join(before, ["word", "block"])
        .select(order, "pos", "word", (F.col("before") + F.col("place")).alias("running_count"))
    )
