"""Near duplicates by SimHash fingerprints within a few differing bits.

Equal fingerprints are one row from the start.  Two fingerprints that differ in at most
``MAX_BITS`` bits agree in all but that many of their ``BLOCKS`` blocks, so every choice of the
blocks that agree is a bucket; a bucket cannot hold more than 2**16 fingerprints, since only two bytes
are free in it.  Inside a bucket, pivot tables do the work: the Hamming distances of each
fingerprint to many reference fingerprints are computed once, pairs are dropped whose distances to
any reference differ by more than ``MAX_BITS`` (the triangle inequality), and the survivors are
verified bit by bit.  A bucket passes on a spanning forest of its links, not the links.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quayline.llm.common import arrow_function, as_bytes, map_batches, stored

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
BLOCKS = 8
PIVOTS = 32
# candidate rows of a pivot table compared at a time
ROWS_AT_ONCE = 256


def _pivots(count: int) -> np.ndarray:
    """Reference fingerprints: fixed pseudo-random numbers (a Weyl sequence, mixed)."""
    x = np.arange(1, count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: bytes, width: int = SHINGLE_WORDS) -> int:
    """64 bits, each set if it is set in more than half of the shingles' hashes.

    Words are split at ASCII white space, A-Z lower-cased; fewer than ``width`` words are one
    shingle, none give 0."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = list(accumulate(len(w) + 1 for w in words))
    digest = xxhash.xxh64_intdigest
    spans = zip([0, *ends[:-1]], ends[width - 1 :] or ends[-1:])
    hashes = np.fromiter((digest(joined[s : e - 1], SEED) for s, e in spans), np.uint64)
    ones = np.zeros(64, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(text: str | Column, width: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed 64-bit number; null text counts as empty."""

    @arrow_function("bigint")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = np.fromiter((fingerprint(t, width) for t in as_bytes(batch)), np.uint64, len(batch))
            yield pa.array(found.view(np.int64))

    return run(text)


def as_hex(signed: Column) -> Column:
    return F.lower(F.lpad(F.hex(signed), 16, "0"))


def buckets(distinct: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """The fingerprints (column ``fp``) that agree in all but ``max_bits`` blocks, where there is
    more than one: ``members``."""
    size = 64 // BLOCKS
    full, block = (1 << 64) - 1, (1 << size) - 1
    keys = []
    for table, free in enumerate(combinations(range(BLOCKS), max_bits)):
        mask = full & ~sum(block << size * b for b in free)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(table).cast("byte").alias("table"), F.col("fp").bitwiseAND(F.lit(signed)).alias("agreed")))
    rows = distinct.select("fp", F.explode(F.array(*keys)).alias("key"))
    return rows.groupBy("key").agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")


def near_pairs(members: np.ndarray, references: np.ndarray, max_bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs within ``max_bits``, the first before the second in order of the first pivot."""
    table = np.bitwise_count(members[:, None] ^ references[None, :]).astype(np.int8)
    order = np.argsort(table[:, 0], kind="stable")
    members, table = members[order], table[order]
    for first in range(0, len(members), ROWS_AT_ONCE):
        last = min(first + ROWS_AT_ONCE, len(members))
        stop = int(np.searchsorted(table[:, 0], table[last - 1, 0] + max_bits, side="right"))
        left, right = np.nonzero(np.abs(table[first:last, None, 0] - table[None, first:stop, 0]) <= max_bits)
        later = right > left
        left, right = left[later] + first, right[later] + first
        for pivot in range(1, table.shape[1]):
            if not len(left):
                break
            close = np.abs(table[left, pivot] - table[right, pivot]) <= max_bits
            left, right = left[close], right[close]
        true = np.bitwise_count(members[left] ^ members[right]) <= max_bits
        yield order[left[true]], order[right[true]]


def spanning(members: np.ndarray, references: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that join what all links inside a bucket join, one fewer than its members at most."""
    parent = list(range(len(members)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    kept = []
    for left, right in near_pairs(members, references, max_bits):
        for a, b in zip(left.tolist(), right.tolist()):
            x, y = root(a), root(b)
            if x != y:
                parent[x] = y
                kept.append((a, b))
    return kept


def links(distinct: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that connect every two fingerprints
    within ``max_bits`` bits, directly or through others that are linked as closely."""
    references = _pivots(pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.column("members"):
                members = row.values.to_numpy(zero_copy_only=False).view(np.uint64)
                signed = members.view(np.int64)
                found += [(signed[i], signed[j]) for i, j in spanning(members, references, max_bits)]
            a, b = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return map_batches(buckets(distinct, max_bits), run, "a bigint, b bigint").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``edges`` (``a, b``): the smallest node that it reaches.

    Alternating star contraction: in turn every node links its larger neighbours, then its smaller
    ones, to its smallest neighbour, until all edges point to roots.  Each round is written to the
    shared folder; nothing but a count and a checksum comes to the driver."""
    now = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    before = None
    while True:
        sign = now.agg(F.count("a"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if sign == before or not sign[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before = sign
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(
            F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")
        )
        now = stored(small.where("a <> b").distinct(), "links")


def classes(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """``fp, root, component_id`` for each distinct fingerprint of ``prints`` (``doc_id, fp``):
    the smallest fingerprint and the smallest ``doc_id`` that it reaches.  ``component_id`` is null
    where all ids are."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "fingerprints")
    roots = components(links(distinct.select("fp"), max_bits))
    placed = distinct.join(roots, distinct["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")
    )
    smallest = placed.groupBy("root").agg(F.min("first_id").alias("component_id"))
    return placed.select("fp", "root").join(smallest, "root")


def grouped(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Null and empty texts have fingerprint 0 and link like any other; repeated rows are repeated in
    the result; an empty table gives no rows."""
    prints = stored(docs.select("doc_id", fingerprints("text", width).alias("fp")), "simhash")
    found = prints.join(classes(prints, max_bits), "fp")
    return found.select("doc_id", as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """One row of each component, with all its columns, whatever they are called: that with the smallest
    ``doc_id``; of several such rows any one.

    Every text is fingerprinted once.  Which rows stay is decided on ids and digests of texts, and the
    documents are read once more for them alone."""
    digest = F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    prints = stored(docs.select("doc_id", digest.alias("digest"), fingerprints("text", width).alias("fp")), "simhash")
    found = prints.join(classes(prints.select("doc_id", "fp"), max_bits), "fp").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    # rows of the smallest id may have several texts, and a text several rows
    rows = found.groupBy("root", "doc_id", "digest").agg(F.count(F.lit(1)).alias("rows"))
    first = rows.groupBy("root", "doc_id").agg(F.min(F.struct("digest", "rows")).alias("first"))
    wanted = stored(first.select(F.col("doc_id").alias("wanted"), "first.digest", (F.col("first.rows") > 1).alias("repeated")), "simhash-kept")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col("doc_id").alias("id"), digest.alias("own"))
    kept = whole.join(wanted, F.col("id").eqNullSafe(F.col("wanted")) & (F.col("own") == F.col("digest")))
    once = kept.where("NOT repeated").select("doc")
    if wanted.where("repeated").limit(1).count():
        once = once.unionByName(kept.where("repeated").dropDuplicates(["wanted", "digest"]).select("doc"))
    return once.select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns])
