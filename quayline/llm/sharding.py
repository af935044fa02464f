"""Weighted rendezvous hashing of record keys.

Every shard draws a number from the key and its own name; the record goes where the weighted draw
is best.  A further shard changes no other draw, so records move only into it, about its share of
the total weight; a removed shard's records spread over the others.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from quayline.llm.common import ranked, stored_in_blocks

SHARDS = 8
LAW = "key"


def even(shards: int) -> dict[int, float]:
    return {shard: 1.0 for shard in range(shards)}


def shard_of(key: str | Column, weights: Mapping[int, float]) -> Column:
    """The shard of a key.  A null key is a key like any other; shards without weight get nothing.

    A draw is uniform in (0, 1); -ln(draw) / weight is smallest at each shard with a probability
    in proportion to its weight.  Equal draws go to the lower shard."""
    if not any(w > 0 for w in weights.values()):
        raise ValueError("some shard needs a weight above 0")
    key = F.col(key) if isinstance(key, str) else key

    def cost(shard: int, weight: float) -> Column:
        draw = (F.shiftrightunsigned(F.xxhash64(key, F.lit(shard)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
        return F.struct((-F.log(draw) / F.lit(float(weight))).alias("cost"), F.lit(shard).alias("shard"))

    costs = [cost(shard, weight) for shard, weight in sorted(weights.items()) if weight > 0]
    return F.array_min(F.array(*costs))["shard"]


def sharded(docs: DataFrame, weights: Mapping[int, float] | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, law, shard, slot, grown_shard`` of every row.

    ``size`` is the text's UTF-8 bytes plus 1 and ``grown_shard`` the shard once one more shard,
    as heavy as the heaviest, has joined.  A null text has no bytes and the checksum of nothing.
    Rows with one ``doc_id``, null included, share a shard; every row has a slot of its own."""
    weights = dict(weights or even(SHARDS))
    grown = {**weights, max(weights) + 1: max(weights.values())}
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + F.lit(1)).cast("bigint").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        shard_of("doc_id", weights).alias("shard"),
        shard_of("doc_id", grown).alias("grown_shard"),
    )
    numbered = ranked(stored_in_blocks(rows, "shards"), "shard")
    return numbered.select("doc_id", "size", "text_crc32", "law", "shard", F.col("_rank").alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, path: str, key: str = "doc_id", weights: Mapping[int, float] | None = None) -> None:
    """All rows below ``path/shard=<n>``.  Within a shard, rows spread over as many files as the
    tasks that read them: no shard is gathered in one task."""
    docs.withColumn("shard", shard_of(key, weights or even(SHARDS))).write.partitionBy("shard").parquet(path)
