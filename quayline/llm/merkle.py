"""Merkle manifest of a dataset with a witness for every row, built by incremental appends.

Each row is a leaf; the leaves of a group (the source) stand in order of their keys and every 16
neighbours are hashed to their parent until one node, the group's subtree root, remains; the
subtree roots are the leaves of one more such tree.

An ``Appender`` takes nodes one after the other.  A run of 16 stays open until its last sibling
comes; then it closes into a parent, which is appended one level higher, and the witnesses of all
leaves below are extended by the siblings that they lacked.  Leaves are cut into aligned blocks of
``16**BLOCK_LEVELS``, so that a block is a subtree and its root a node of the tree above: blocks are
appended to independently, and their roots are the appends of the next round, until every group has one node.
On the way back the witness of a block's root completes those of the block's leaves.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from quayline.llm.common import map_batches, stored, stored_in_blocks

FANOUT = 16
# a block holds the leaves of a subtree of so many levels
BLOCK_LEVELS = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# leaves in one Arrow batch of witnesses, which are a few kilobytes each
LEAVES_AT_ONCE = 2048
WITNESS = "array<struct<place:int,siblings:string>>"
_STEP = pa.struct([("place", pa.int32()), ("siblings", pa.string())])


def leaf_digest(fields: list[Column]) -> Column:
    """SHA-256 of the fields, each as its UTF-8 byte count, ``:`` and its value, ``-`` if null."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


class Appender:
    """One block's tree, grown node by node; ``levels`` are closed above its leaves."""

    def __init__(self, levels: int):
        # by level: the open run, each node with the range of leaves below it
        self.runs: list[list[tuple[str, int, int]]] = [[] for _ in range(levels + 1)]
        self.witnesses: list[list[tuple[int, str]]] = []

    def append(self, digest: str) -> None:
        at = len(self.witnesses)
        self.witnesses.append([])
        self._add(0, (digest, at, at + 1))

    def _add(self, level: int, node: tuple[str, int, int]) -> None:
        self.runs[level].append(node)
        if len(self.runs[level]) == FANOUT and level + 1 < len(self.runs):
            self._close(level)

    def _close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        digests = [digest for digest, _, _ in run]
        for place, (_, first, last) in enumerate(run):
            step = (place, "".join(digests[:place] + digests[place + 1 :]))
            for leaf in range(first, last):
                self.witnesses[leaf].append(step)
        self._add(level + 1, (sha256("".join(digests).encode()).hexdigest(), run[0][1], run[-1][2]))

    def finish(self) -> str:
        """Closes what is open and returns the root."""
        for level in range(len(self.runs) - 1):
            if self.runs[level]:
                self._close(level)
        return self.runs[-1][0][0]


def levels_of(nodes: int) -> int:
    """Levels that a block of a group with ``nodes`` nodes closes: to the group's root if the block
    is the whole group, else those of an aligned block."""
    levels = 0
    while FANOUT**levels < nodes and levels < BLOCK_LEVELS:
        levels += 1
    return levels


def grown(digests: list[str], nodes: int) -> Appender:
    tree = Appender(levels_of(nodes))
    for digest in digests:
        tree.append(digest)
    return tree


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """``rows`` (with a group ``g``) with ``at``, gapless from 0 within each group in the given order,
    and ``n``, the group's rows.

    Rows are sorted by range; a range's share of a group is counted, and only the rows of one range and
    one group are numbered together.  Rows that agree in all of ``order`` are spread as well."""
    sorted_rows = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange("g", *order, "tie")
    blocks = stored_in_blocks(sorted_rows.sortWithinPartitions("g", *order, "tie").drop("tie"), "merkle-order")
    counts = blocks.groupBy("g", "_block").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy("g")
    earlier = group.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(
        F.col("g").alias("_g"), F.col("_block").alias("_in"),
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"), F.sum("_n").over(group).alias("n"),
    )
    place = F.row_number().over(Window.partitionBy("g", "_block").orderBy("_row"))
    placed = blocks.withColumn("_place", place)
    same = placed["g"].eqNullSafe(bases["_g"]) & (placed["_block"] == bases["_in"])
    return placed.join(bases, same).select(*rows.columns, (F.col("_base") + F.col("_place") - 1).alias("at"), "n")


def as_blocks(nodes: DataFrame) -> DataFrame:
    """One row per aligned block: ``g, block, n`` and its ``nodes`` in order."""
    size = FANOUT**BLOCK_LEVELS
    members = F.sort_array(F.collect_list(F.struct("at", "digest", "load")))
    return nodes.groupBy("g", F.expr(f"at DIV {size}").alias("block")).agg(F.first("n").alias("n"), members.alias("nodes"))


def _digests(batch: pa.RecordBatch) -> Iterator[list[str]]:
    for block in batch.column("nodes"):
        yield block.values.field("digest").to_pylist()


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = batch.column("n").to_pylist()
        roots = [grown(digests, n).finish() for digests, n in zip(_digests(batch), counts)]
        above = [-(-n // FANOUT**BLOCK_LEVELS) for n in counts]
        columns = [batch.column("g"), batch.column("block"), pa.array(roots, pa.string()), pa.array(above, pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["g", "at", "digest", "n"])


def climb(nodes: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """From nodes (``g, at, n, digest, load``) to one root per group (``g, digest``), and the blocks of
    every round, lowest first.  Every round has 256 times fewer nodes."""
    rounds = []
    while True:
        rounds.append(stored(as_blocks(nodes), "merkle-blocks"))
        roots = stored(map_batches(rounds[-1], _roots, "g string, at bigint, digest string, n bigint"), "merkle-roots")
        if (roots.agg(F.max("n")).first()[0] or 1) == 1:
            return roots.select("g", "digest"), rounds
        nodes = roots.withColumn("load", F.lit(None).cast("boolean"))


def _repeat(column: pa.Array, row: int, times: int) -> pa.Array:
    return column.take(pa.array([row] * times, pa.int64()))


def _completed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of the blocks with its witness: grown inside the block, completed by the block's."""
    for batch in batches:
        counts = batch.column("n").to_pylist()
        for row, (digests, n) in enumerate(zip(_digests(batch), counts)):
            tree = grown(digests, n)
            tree.finish()
            above = [(step["place"], step["siblings"]) for step in batch.column("above")[row].as_py()]
            nodes = batch.column("nodes")[row].values
            for first in range(0, len(digests), LEAVES_AT_ONCE):
                witnesses = [own + above for own in tree.witnesses[first : first + LEAVES_AT_ONCE]]
                steps = [step for witness in witnesses for step in witness]
                offsets = [0]
                for witness in witnesses:
                    offsets.append(offsets[-1] + len(witness))
                flat = pa.StructArray.from_arrays(
                    [pa.array([s[0] for s in steps], pa.int32()), pa.array([s[1] for s in steps], pa.string())], fields=list(_STEP)
                )
                own = nodes.slice(first, len(witnesses))
                columns = [
                    _repeat(batch.column("g"), row, len(own)), own.field("at"), own.field("digest"), own.field("load"),
                    _repeat(batch.column("subroot"), row, len(own)), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=["g", "at", "digest", "load", "subroot", "witness"])


def descend(blocks: DataFrame, above: DataFrame) -> DataFrame:
    """``g, at, digest, load, subroot, witness`` of every node of a round, from the witnesses of the
    blocks' roots (``g, at, subroot, witness``)."""
    load = blocks.schema["nodes"].dataType.elementType["load"].dataType.simpleString()
    known = above.select(F.col("g").alias("_g"), F.col("at").alias("_at"), "subroot", F.col("witness").alias("above"))
    joined = blocks.join(known, F.col("g").eqNullSafe(F.col("_g")) & (F.col("block") == F.col("_at")))
    schema = f"g string, at bigint, digest string, load {load}, subroot string, witness {WITNESS}"
    return map_batches(joined.select("g", "n", "nodes", "above", "subroot"), _completed, schema)


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "source", key: str = "doc_id", **also: Column) -> DataFrame:
    """One row per document: ``<key>, <group>, leaf, subroot, root, witness`` and the columns ``also``.

    ``witness`` has a step for each level up to the root: the node's ``place`` among its run and its
    ``siblings``, digests end to end from left to right.  Null fields have a form of their own, null
    groups are one group and come first, null keys come first; rows with the same key stand in order
    of their digests and each repeated row is a leaf of its own.  Groups and keys are compared as
    strings of bytes and as they are.  An empty table gives no rows."""
    leaves = stored(
        docs.select(
            F.col(group).cast("string").alias("g"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("digest"),
            F.struct(F.col(key).alias("key"), *[c.alias(n) for n, c in also.items()]).alias("load"),
        ),
        "merkle-leaves",
    )
    subroots, rounds = climb(numbered(leaves, "key", "digest"))
    groups = subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), "digest", F.struct(F.col("g").alias("name")).alias("load"))
    top, top_rounds = climb(numbered(groups, "name"))
    root = top.first()
    nothing = F.lit([]).cast(WITNESS)
    above = top.select("g", F.lit(0).cast("bigint").alias("at"), F.lit("").alias("subroot"), nothing.alias("witness"))
    for blocks in reversed(top_rounds):
        above = descend(blocks, above)
    above = stored(above.select(F.col("load.name").alias("g"), F.lit(0).cast("bigint").alias("at"), F.col("digest").alias("subroot"), "witness"), "merkle-witnesses")
    for blocks in reversed(rounds):
        above = descend(blocks, above)
    return above.select(
        F.col("load.key").alias(key), F.col("g").alias(group), F.col("digest").alias("leaf"), "subroot",
        F.lit(root["digest"] if root else None).cast("string").alias("root"), "witness", *[f"load.{n}" for n in also],
    )


def proof(witness: str = "witness") -> Column:
    """SHA-256 of all siblings, level by level."""
    return F.sha2(F.array_join(F.transform(witness, lambda step: step["siblings"]), ""), 256)


def folded(leaf: Column, witness: str = "witness") -> Column:
    """The root that a leaf and a witness give."""

    def parent(digest: Column, step: Column) -> Column:
        left = step["place"] * 64
        return F.sha2(F.concat(step["siblings"].substr(F.lit(1), left), digest, step["siblings"].substr(left + 1, F.lit(64 * FANOUT))), 256)

    return F.aggregate(witness, leaf, parent)


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row.

    ``folded_root`` is recomputed from the witness and the leaf; where 5 divides the CRC-32 of the
    decimal ``doc_id`` from the leaf of a text whose A-Z are lower-cased."""
    tampered = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0) & F.col("text").isNotNull()
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    altered = F.when(tampered, leaf_digest([lower if f == "text" else F.col(f) for f in FIELDS]))
    rows = manifest(docs, altered=altered)
    back = folded(F.coalesce("altered", "leaf"))
    out = rows.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), back.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
