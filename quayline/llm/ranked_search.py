"""Ranked lexical search: the best documents for each of many items, by a dual-tree search.

Items and documents are vectors over terms: an item has a term's weight, a document the term's
saturated frequency, and a pair's score is their inner product, in whole numbers.  Both sides are
put into hierarchies whose nodes hold the maximum of every coordinate below them, so that the inner product of two
nodes is an upper bound of all scores between them.  A pair of nodes is left, with
everything below, when its bound is less than the weakest k-th score of the items below the item
node; what remains at the leaves is scored exactly.  No pair that could be among an item's best is lost.

Items pass in blocks of a bounded number of terms, each against all documents.  Documents are
indexed by the block's terms once; every task builds trees over batches of its part of the index
and returns k documents for each item, and the best of those are taken per item.  A first round
over a fixed share of the documents gives each item a score that its k-th best cannot be below,
which is where the pruning of all tasks starts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from quayline.llm.common import arrow_function, importable, map_batches, plain_strings, slices, stored

BEST = 10
# a block of items: so many of them, and so many different terms unless one item has more
BLOCK_ITEMS, BLOCK_TERMS = 512, 8192
# documents under one tree, documents and items in a leaf, children of a node
DOCS_AT_ONCE, DOCS_IN_LEAF, ITEMS_IN_LEAF, CHILDREN = 2048, 4, 1, 4
# one document in so many takes part in the first round
FIRST_ROUND = 32
# bounds are doubles: more than the rounding of a bound can be
SLACK = 1 + 1e-9
INDEX = "struct<n:bigint,terms:array<int>,counts:array<int>>"


def _byte_table() -> np.ndarray:
    """What each byte of a text becomes: ASCII letters lower-cased, digits and all of other
    characters' bytes kept, the rest a space."""
    table = np.arange(256, dtype=np.uint8)
    for byte in range(128):
        character = chr(byte)
        table[byte] = ord(character.lower()) if character.isalnum() else ord(" ")
    return table


_BYTES = _byte_table()


def terms_of(text: str | None) -> list[str]:
    """The terms of a text in order."""
    plain = (text or "").encode().translate(_BYTES.tobytes()).decode()
    return [term for term in plain.split(" ") if term]


class Block(NamedTuple):
    """Items with their terms, numbered by the block's vocabulary."""

    keys: list
    vocabulary: list[str]
    terms: list[np.ndarray]


def _similar_order(vectors: np.ndarray) -> list[int]:
    """Rows so that similar ones stand together: halved again and again along the direction in
    which they differ most."""

    def halve(rows: np.ndarray) -> list[int]:
        if len(rows) <= ITEMS_IN_LEAF:
            return rows.tolist()
        centred = vectors[rows] - vectors[rows].mean(axis=0)
        direction = np.linalg.eigh(centred @ centred.T)[1][:, -1]
        order = rows[np.argsort(direction, kind="stable")]
        middle = len(rows) // 2
        return halve(order[:middle]) + halve(order[middle:])

    return halve(np.arange(len(vectors)))


def _block(keys: list, texts: list[list[str]]) -> Block:
    """Items and terms are numbered so that similar items, and the terms of similar items, are neighbours."""
    number: dict[str, int] = {}
    for text in texts:
        for term in text:
            number.setdefault(term, len(number))
    vectors = np.zeros((len(texts), len(number)), np.float32)
    for row, text in enumerate(texts):
        vectors[row, [number[t] for t in text]] = 1
    vectors *= np.log1p(len(texts) / vectors.sum(axis=0))
    order = _similar_order(vectors)
    number = {}
    for row in order:
        for term in texts[row]:
            number.setdefault(term, len(number))
    terms = [np.array(sorted(number[t] for t in texts[row]), np.int32) for row in order]
    return Block([keys[row] for row in order], list(number), terms)


def item_blocks(items: DataFrame, key: str, text: str) -> Iterator[Block]:
    """The items that have terms, in blocks; the driver holds one block and one partition's items."""
    keys, texts, seen = [], [], set()
    for row in items.select(F.col(key).alias("key"), F.col(text).alias("text")).toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if not terms:
            continue
        if keys and (len(keys) == BLOCK_ITEMS or len(seen.union(terms)) > BLOCK_TERMS):
            yield _block(keys, texts)
            keys, texts, seen = [], [], set()
        keys.append(row["key"])
        texts.append(terms)
        seen.update(terms)
    if keys:
        yield _block(keys, texts)


def _counted(texts: pa.Array, vocabulary: pa.Array) -> pa.Array:
    """``n, terms, counts`` of every text: all its terms, and the block's terms in it."""
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    plain = np.ascontiguousarray(_BYTES[data[offsets[0] : offsets[-1]]])
    cleaned = pa.LargeStringArray.from_buffers(len(texts), pa.py_buffer(offsets - offsets[0]), pa.py_buffer(plain))
    words = pc.ascii_split_whitespace(cleaned)
    ends = words.offsets.to_numpy().astype(np.int64)
    coded = words.flatten().dictionary_encode()
    known = pc.fill_null(pc.index_in(coded.dictionary, vocabulary), -1).to_numpy().astype(np.int64)
    empty = pc.equal(coded.dictionary, "").to_numpy(zero_copy_only=False)
    indices = coded.indices.to_numpy().astype(np.int64)
    row = np.repeat(np.arange(len(texts)), np.diff(ends))
    n = np.bincount(row[~empty[indices]], minlength=len(texts)) if len(row) else np.zeros(len(texts), np.int64)
    term = known[indices]
    keys, counts = np.unique(row[term >= 0] * len(vocabulary) + term[term >= 0], return_counts=True)
    starts = np.searchsorted(keys, np.arange(len(texts) + 1) * len(vocabulary)).astype(np.int32)
    lists = [pa.ListArray.from_arrays(pa.array(starts), pa.array(v.astype(np.int32))) for v in (keys % len(vocabulary), counts)]
    return pa.StructArray.from_arrays([pa.array(n, pa.int64()), *lists], names=["n", "terms", "counts"])


def indexed(docs: DataFrame, vocabulary: list[str], key: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc, n, terms, counts`` of every row, written once."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    importable(docs.sparkSession)

    @arrow_function(INDEX)
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = pa.array(shipped.value, pa.large_string())
        for batch in batches:
            parts = [_counted(part, known) for part in slices(plain_strings(batch))]
            yield pa.concat_arrays(parts) if parts else _counted(plain_strings(batch), known)

    rows = docs.select(F.col(key).cast("bigint").alias("doc"), count(F.col(text)).alias("i"))
    return stored(rows.select("doc", "i.*"), "search-index")


class Statistics(NamedTuple):
    documents: int
    length: int
    weights: np.ndarray


def statistics(index: DataFrame, terms: int) -> Statistics:
    """Of all documents: how many have terms, how many terms they have, and each term's weight."""
    documents, length = index.where("n > 0").agg(F.count("n"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = index.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    frequency = {r["term"]: r["count"] for r in held}
    weights = [math.floor(1000 * math.log((2 * documents + 2) / (2 * frequency.get(t, 0) + 1))) for t in range(terms)]
    return Statistics(documents, length, np.array(weights, np.int64))


class Tree:
    """Rows of non-negative coordinates under nodes with the maxima of all coordinates."""

    def __init__(self, rows: list[tuple[np.ndarray, np.ndarray]], width: int, in_leaf: int):
        self.size, self.in_leaf = len(rows), in_leaf
        self.terms, self.values = (np.concatenate(parts) for parts in zip(*rows))
        self.starts = np.cumsum([0, *(len(terms) for terms, _ in rows)])
        maxima = np.zeros((-(-len(rows) // in_leaf), width))
        for at, (terms, values) in enumerate(rows):
            node = maxima[at // in_leaf]
            node[terms] = np.maximum(node[terms], values)
        self.levels = [maxima]
        while len(self.levels[-1]) > 1:
            self.levels.append(np.maximum.reduceat(self.levels[-1], np.arange(0, len(self.levels[-1]), CHILDREN)))

    def children(self, level: int, node: int) -> range:
        return range(node * CHILDREN, min((node + 1) * CHILDREN, len(self.levels[level - 1])))

    def below(self, level: int, node: int) -> slice:
        """The rows below a node."""
        size = self.in_leaf * CHILDREN**level
        return slice(node * size, min((node + 1) * size, self.size))

    def products(self, vectors: np.ndarray, rows: slice) -> np.ndarray:
        """Inner products of whole vectors and rows, in whole numbers."""
        starts = self.starts[rows.start : rows.stop + 1]
        flat = slice(starts[0], starts[-1])
        return np.add.reduceat(vectors[:, self.terms[flat]] * self.values[flat], starts[:-1] - starts[0], axis=1)


class Search:
    """The best documents of the block's items among the batches seen so far."""

    def __init__(self, terms: list[np.ndarray], weights: np.ndarray, floors: np.ndarray, best: int):
        self.items = Tree([(t, weights[t]) for t in terms], len(weights), ITEMS_IN_LEAF)
        self.vectors = np.zeros((len(terms), len(weights)), np.int64)
        for row, own in enumerate(terms):
            self.vectors[row, own] = weights[own]
        self.weights, self.best = weights, best
        self.kth = floors.astype(np.int64)
        none = np.empty(0, np.int64)
        self.found = [(none, none, np.empty(0, bool)) for _ in terms]
        self.bounded = self.scored = 0

    def add(self, ids: np.ndarray, missing: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """A batch of documents with terms: ids, whether null, terms and their shares of a score."""
        order = self._similar(rows)
        self.ids, self.missing = ids[order], missing[order]
        self.docs = Tree([rows[i] for i in order], len(self.weights), DOCS_IN_LEAF)
        self._pair(len(self.items.levels) - 1, 0, len(self.docs.levels) - 1, 0)

    def _similar(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> list[int]:
        """Documents by the terms that weigh most in them."""

        def heaviest(row: int) -> list[int]:
            terms, values = rows[row]
            return terms[np.argsort(-self.weights[terms] * values, kind="stable")[:3]].tolist()

        return sorted(range(len(rows)), key=heaviest)

    def _pair(self, item_level: int, item: int, doc_level: int, doc: int) -> None:
        """What is below two nodes: their children's pairs that may matter, the most promising first
        so that the k-th scores rise early."""
        if item_level == 0 and doc_level == 0:
            self._score(self.items.below(0, item), self.docs.below(0, doc))
            return
        items = self.items.children(item_level, item) if item_level else range(item, item + 1)
        docs = self.docs.children(doc_level, doc) if doc_level else range(doc, doc + 1)
        item_level, doc_level = max(item_level - 1, 0), max(doc_level - 1, 0)
        bounds = self.items.levels[item_level][items.start : items.stop] @ self.docs.levels[doc_level][docs.start : docs.stop].T
        self.bounded += bounds.size
        for place in np.argsort(-bounds, axis=None, kind="stable").tolist():
            i, d = divmod(place, len(docs))
            weakest = self.kth[self.items.below(item_level, items[i])].min()
            if bounds[i, d] * SLACK >= weakest:
                self._pair(item_level, items[i], doc_level, docs[d])

    def _score(self, items: slice, docs: slice) -> None:
        scores = self.docs.products(self.vectors[items], docs)
        self.scored += scores.size
        for item, row in enumerate(scores, items.start):
            picked = np.flatnonzero(row >= self.kth[item])
            if len(picked):
                self._keep(item, row[picked], self.ids[docs][picked], self.missing[docs][picked])

    def _keep(self, item: int, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        scores, ids, missing = (np.concatenate(pair) for pair in zip(self.found[item], (scores, ids, missing)))
        order = np.lexsort((ids, missing, -scores))[: self.best]
        self.found[item] = scores[order], ids[order], missing[order]
        if len(order) == self.best:
            self.kth[item] = max(self.kth[item], scores[order[-1]])

    def rows(self, keys: pa.Array) -> pa.RecordBatch:
        lengths = [len(scores) for scores, _, _ in self.found]
        number = np.repeat(np.arange(len(lengths)), lengths)
        scores, ids, missing = (np.concatenate(parts) for parts in zip(*self.found))
        columns = [pa.array(number, pa.int32()), keys.take(pa.array(number)), pa.array(ids, pa.int64(), mask=missing), pa.array(scores, pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names=["item", "key", "doc", "score"])


def saturated(counts: np.ndarray, n: int, documents: int, length: int) -> np.ndarray:
    """A term's share of the score before its weight."""
    counts = counts.astype(np.int64)
    return 1_000_000_000 * counts // (1000 * counts + 8 * (10 + 90 * n * documents // length))


def best_documents(index: DataFrame, block: Block, facts: Statistics, floors: np.ndarray, kind: DataType, best: int = BEST) -> DataFrame:
    """``item, key, doc, score`` of the best documents of each item (its number in the block, its key),
    none of which scores less than the item's ``floors``, 1 at least."""
    key_type = to_arrow_type(kind)
    shipped = index.sparkSession.sparkContext.broadcast((block.keys, block.terms, facts, floors))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, terms, facts, floors = shipped.value
        search = Search(terms, facts.weights, floors, best)
        for batch in batches:
            for first in range(0, len(batch), DOCS_AT_ONCE):
                part = batch.slice(first, DOCS_AT_ONCE)
                ids = part.column("doc")
                rows = []
                ends = part.column("terms").offsets.to_numpy()
                all_terms, all_counts = (part.column(c).values.to_numpy() for c in ("terms", "counts"))
                for n, start, stop in zip(part.column("n").to_pylist(), ends, ends[1:]):
                    rows.append((all_terms[start:stop], saturated(all_counts[start:stop], n, facts.documents, facts.length)))
                search.add(pc.fill_null(ids, 0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False), rows)
        yield search.rows(pa.array(keys, key_type))

    held = index.where(F.size("terms") > 0).select("doc", "n", "terms", "counts")
    found = map_batches(held, run, f"item int, key {kind.simpleString()}, doc bigint, score bigint")
    return top(found, best)


def top(found: DataFrame, best: int) -> DataFrame:
    """The best rows of each item with their ``rank``; every task passes on its own best only."""
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def ranked(items: DataFrame, docs: DataFrame, best: int = BEST, item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``best`` documents with a score above 0.

    Equal scores are ranked by ascending ``doc_id``, null last.  Null and empty texts have no terms:
    such documents count for nothing, such items have no rows.  Repeated items are ranked each for itself, repeated
    documents stand for themselves.  Without items or documents there are no rows."""
    kind = items.schema[item_key].dataType
    parts = []
    for block in item_blocks(items, item_key, item_text):
        index = indexed(docs, block.vocabulary)
        facts = statistics(index, len(block.vocabulary))
        floors = np.ones(len(block.keys), np.int64)
        few = index.where(F.pmod(F.xxhash64("doc"), F.lit(FIRST_ROUND)) == 0)
        for row in best_documents(few, block, facts, floors, kind, best).where(F.col("rank") == best).collect():
            floors[row["item"]] = max(1, row["score"])
        found = stored(best_documents(index, block, facts, floors, kind, best), "search")
        parts.append(found.select(F.col("key").alias(item_key), "rank", F.col("doc").alias("doc_id"), "score"))
    if not parts:
        return items.sparkSession.createDataFrame([], f"{item_key} {kind.simpleString()}, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, parts)
