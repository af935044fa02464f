"""Threshold-scaled sketches: all shingle hashes below a fixed fraction of the hash range.

Whether a hash is kept depends on the hash alone, so sketches of parts unite to the sketch of the
whole, and the kept hashes of a short text inside a very long one are among those of the long one:
their share estimates containment at any ratio of lengths.

Texts of few shingles are below the scale: chance decides whether the sketch has any of them.  Such a text keeps
all its hashes in a side list, and it is compared by whole sets of hashes, which is exact.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quayline.llm.common import arrow_function, as_bytes, map_batches, plain_strings, slices

SHINGLE_WORDS = 5
# one in so many hashes is kept; a power of two
SCALE = 8
# a text of fewer different shingles is below the scale
FEW = 64
# ranges of neighbouring documents: rows in one, as long as that makes no more than so many; beyond, ranges grow,
# which makes tasks longer but no larger, since a range is sorted by Spark and read two texts at a time
ROWS_PER_RANGE = 1024
MOST_RANGES = 50_000

_KEPT_BELOW = np.uint64((1 << 64) // SCALE)


class Sketch(NamedTuple):
    """The ``kept`` hashes of a text, sorted, and ``every`` hash, which a task has while it holds the text."""

    kept: np.ndarray
    every: np.ndarray

    @property
    def few(self) -> bool:
        """Whether the text is below the scale, so that its side list is part of the fingerprint."""
        return len(self.every) < FEW


def sketch(text: bytes, width: int = SHINGLE_WORDS) -> Sketch:
    """The sketch of a UTF-8 text.

    Words are split at ASCII white space and A-Z lower-cased; fewer than ``width`` words are one
    shingle, none have no hash."""
    import xxhash

    words = text.lower().split()
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    starts = [0, *ends[:-1]]
    digest = xxhash.xxh64_intdigest
    found = {digest(joined[s : e - 1]) for s, e in zip(starts, ends[width - 1 :] or ends[-1:])}
    every = np.sort(np.fromiter(found, np.uint64, len(found)))
    return Sketch(every[: np.searchsorted(every, _KEPT_BELOW)], every)


def containment(a: Sketch, b: Sketch) -> float:
    """Share of the smaller text's shingles that the other has: estimated from the kept hashes, exact where
    one of the texts is below the scale; 1 for two texts without words, 0 if only one has none."""
    if a.few or b.few or not len(a.kept) or not len(b.kept):
        one, other = a.every, b.every
    else:
        one, other = a.kept, b.kept
    if not len(one) or not len(other):
        return float(len(one) == len(other))
    return len(np.intersect1d(one, other, assume_unique=True)) / min(len(one), len(other))


def as_string(own: Sketch) -> str:
    """Eight characters per kept hash: its upper 48 bits below the scale's leading zeros.  Below the scale a
    ``*`` and the upper 48 bits of every hash."""
    low = own.every >> np.uint64(16) if own.few else own.kept >> np.uint64(64 - 48 - SCALE.bit_length() + 1)
    wide = low.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:]
    return "*" * own.few + base64.b64encode(wide.tobytes()).decode()


def merged(sketches: DataFrame, key: str) -> DataFrame:
    """The sketch of all texts of a key together: ``key, hash, side``, one row per hash, so that
    no group meets in one row however many texts it has.

    ``sketches`` has ``hashes`` and ``side`` as ``sketched`` gives them.  Rows that are not ``side`` are the kept
    hashes; a key whose texts are all below the scale, and together too, also has its other hashes."""
    all_hashes = F.coalesce("side", "hashes")
    rows = sketches.select(F.col(key).alias("key"), F.explode(all_hashes).alias("hash")).distinct()
    low = F.shiftrightunsigned("hash", 64 - (SCALE.bit_length() - 1)) == 0
    whole = sketches.groupBy(F.col(key).alias("of")).agg(F.bool_and(F.col("side").isNotNull()).alias("small"))
    counts = rows.groupBy(F.col("key").alias("of")).agg(F.count(F.lit(1)).alias("n"))
    few = whole.where("small").join(counts.where(F.col("n") < FEW), "of").select("of")
    sides = rows.where(~low).join(few, rows["key"].eqNullSafe(few["of"]), "left_semi").withColumn("side", F.lit(True))
    return rows.where(low).withColumn("side", F.lit(False)).unionByName(sides).withColumnRenamed("key", key)


def sketched(docs: DataFrame, width: int = SHINGLE_WORDS) -> DataFrame:
    """``docs`` with ``hashes``, the kept hashes of the text as signed 64-bit numbers, and ``side``, all its hashes
    where it is below the scale, else null; columns of these names are replaced.  Null and empty texts have
    no hashes."""

    @arrow_function("struct<hashes:array<bigint>,side:array<bigint>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [sketch(t, width) for t in as_bytes(batch)]
            kept = pa.array([r.kept.view(np.int64) for r in rows], pa.list_(pa.int64()))
            side = pa.array([r.every.view(np.int64) if r.few else None for r in rows], pa.list_(pa.int64()))
            yield pa.StructArray.from_arrays([kept, side], names=["hashes", "side"])

    found = run(F.col("text"))
    return docs.withColumn("hashes", found).withColumn("side", F.col("hashes.side")).withColumn("hashes", F.col("hashes.hashes"))


class Ranges:
    """Cuts of the ids into ranges of about equal size, in descending order of range numbers from
    the top: a crowded id has several equal cuts, between which its rows are spread by ``tie``."""

    def __init__(self, docs: DataFrame):
        rows = docs.agg(F.count("doc_id").alias("n")).first().n
        count = int(min(MOST_RANGES, max(1, -(-rows // ROWS_PER_RANGE))))
        shares = [i / count for i in range(1, count)]
        found = docs.agg(F.percentile_approx("doc_id", shares, 10 * count).alias("cuts")).first().cuts if shares else []
        self.cuts = np.array(found or [], np.int64)

    def number(self, ids: pa.Array, ties: pa.Array) -> np.ndarray:
        """Range 0 has the largest ids; null ids come last."""
        tie = ties.to_numpy(zero_copy_only=False).view(np.uint64).astype(np.float64) / 2.0**64
        known = ids.is_valid().to_numpy(zero_copy_only=False)
        values = ids.fill_null(0).to_numpy(zero_copy_only=False)
        low = np.searchsorted(self.cuts, values, side="left")
        high = np.searchsorted(self.cuts, values, side="right")
        at = low + np.minimum((tie * (high - low + 1)).astype(np.int64), high - low)
        return np.where(known, len(self.cuts) - at, len(self.cuts) + 1).astype(np.int32)


def compared(docs: DataFrame) -> DataFrame:
    """Every document beside an edited copy and beside the next document.

    The next document is the next one by descending ``doc_id`` (the first one for the last; null
    ids come last, rows with one id follow their text's hash).  The edited copy has its last half
    replaced by as much of the next document's beginning.  Null text counts as empty; a single
    document is its own next one; an empty table gives no rows.

    Neighbours meet in ranges of ids: each range is read in order by one task that holds two
    texts at a time, and also gets the first document of the range below."""
    ranges = Ranges(docs)
    shipped = docs.sparkSession.sparkContext.broadcast(ranges)

    @arrow_function("int")
    def number(ids: pa.Array, ties: pa.Array) -> pa.Array:
        return pa.array(shipped.value.number(ids, ties))

    # as an unsigned number, for the order inside a range to follow the spread over ranges
    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), tie.alias("tie"))
    rows = rows.withColumn("range", number("doc_id", "tie"))
    order = F.struct("doc_id", F.col("tie").bitwiseXOR(F.lit(-(1 << 63))).alias("tie"))
    # at most MOST_RANGES + 1 rows: the first document of each range that has any
    firsts = sorted(rows.groupBy("range").agg(F.max(order).alias("o")).collect())
    above = {b.range: a.range for a, b in zip([firsts[-1], *firsts], firsts)} if firsts else {}
    heads = [(above[f.range], f.range, f.o.doc_id, f.o.tie ^ -(1 << 63)) for f in firsts]
    spark = docs.sparkSession
    wanted = F.broadcast(spark.createDataFrame(heads, "above int, own int, id bigint, hash bigint"))
    same = (rows["range"] == wanted["own"]) & rows["doc_id"].eqNullSafe(wanted["id"]) & (rows["tie"] == wanted["hash"])
    borders = rows.join(wanted, same).dropDuplicates(["range"])
    borders = borders.select("doc_id", "text", "tie", F.col("above").alias("range"), F.lit(True).alias("border"))
    placed = rows.select("doc_id", "text", "tie", "range", F.lit(False).alias("border")).unionByName(borders)
    ordered = placed.repartition("range").sortWithinPartitions(
        "range", "border", F.desc_nulls_last("doc_id"), F.desc(F.col("tie").bitwiseXOR(F.lit(-(1 << 63))))
    )
    return map_batches(ordered.select("range", "border", "doc_id", "text"), _neighbours, COMPARED)


COMPARED = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)
_COMPARED = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    before = None
    for batch in batches:
        found = []
        row = 0
        for part in slices(plain_strings(batch.column("text"))):
            own = batch.slice(row, len(part))
            row += len(part)
            keys = zip(own.column("range").to_pylist(), own.column("border").to_pylist(), own.column("doc_id").to_pylist())
            for (number, border, doc_id), text in zip(keys, part.to_pylist()):
                here = (number, doc_id, text, sketch(text.encode()))
                if before and before[0] == number:
                    found.append(_compared(*before[1:], *here[2:]))
                before = None if border else here
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), _COMPARED)], schema=_COMPARED)


def _compared(doc_id, text: str, own: Sketch, following: str, next_sketch: Sketch) -> tuple:
    half = len(text) // 2
    edited = (text[: len(text) - half] + following[:half]).encode()
    edited_sketch = sketch(edited)
    return (
        doc_id, len(text), hashlib.sha256(edited).hexdigest(), as_string(own), as_string(edited_sketch),
        containment(own, edited_sketch), containment(own, next_sketch),
    )
