"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Best-fit decreasing: the longest piece first, each into the open sequence that it fills most
tightly.  Pieces of equal length are interchangeable, so the plan is made from the number of
pieces of each length, a table of at most ``capacity`` rows however large the corpus is: a
segment tree over the remaining capacities finds the tightest open sequences in logarithmic time,
and a whole run of equal pieces is placed at once.  The runs are at most a few for each length and
open group, whatever the number of documents.  Every piece then looks its place up by its length
and its gapless rank among the pieces of that length.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quayline.llm.common import arrow_function, gather, plain_strings, ranked, slices, stored_in_blocks

CAPACITY = 2048
END_OF_DOCUMENT = 0
# words encoded at a time: what the tokenizer returns is many times as large as the ids in it
WORDS_AT_ONCE = 32_768
PIECES = "array<struct<piece:int,start:bigint,length:bigint,ids_crc32:bigint>>"
PIECES_WITH_IDS = PIECES.replace("ids_crc32:bigint", "ids_crc32:bigint,ids:array<int>")


class Run(NamedTuple):
    """Pieces ``first_rank ...`` of one length: ``per_sequence`` in each of ``sequences``
    sequences from ``sequence`` on, the first at ``offset``."""

    length: int
    first_rank: int
    per_sequence: int
    sequence: int
    offset: int
    sequences: int


class OpenSequences:
    """Open sequences by remaining capacity, under a segment tree that knows which remaining
    capacities occur."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.occurs = [False] * (2 * self.leaves)
        self.ranges: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]

    def _mark(self, remaining: int) -> None:
        node = self.leaves + remaining
        self.occurs[node] = bool(self.ranges[remaining])
        while node > 1:
            node //= 2
            self.occurs[node] = self.occurs[2 * node] or self.occurs[2 * node + 1]

    def add(self, remaining: int, first: int, count: int) -> None:
        if remaining and count:
            self.ranges[remaining].append((first, count))
            self._mark(remaining)

    def take(self, remaining: int) -> tuple[int, int]:
        found = self.ranges[remaining].pop()
        self._mark(remaining)
        return found

    def tightest(self, length: int) -> int | None:
        """The smallest remaining capacity of at least ``length`` that occurs."""
        node = self.leaves + length
        if not self.occurs[node]:
            while node > 1 and (node % 2 or not self.occurs[node + 1]):
                node //= 2
            if node <= 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.occurs[2 * node] else 2 * node + 1
        return node - self.leaves


def plan(counts: dict[int, int], capacity: int) -> list[Run]:
    """Best-fit decreasing of ``counts[length]`` pieces of each length."""
    open_sequences, runs, opened = OpenSequences(capacity), [], 0
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            remaining = open_sequences.tightest(length)
            if remaining is None:
                new = -(-left // (capacity // length))
                open_sequences.add(capacity, opened, new)
                opened += new
                continue
            first, count = open_sequences.take(remaining)
            # after one piece the same sequence is the tightest, until it takes no further one
            each = min(remaining // length, left)
            filled = min(count, left // each)
            runs.append(Run(length, rank, each, first, capacity - remaining, filled))
            open_sequences.add(remaining, first + filled, count - filled)
            open_sequences.add(remaining - each * length, first, filled)
            rank, left = rank + filled * each, left - filled * each
    return runs


# fixed values: the settings under which plain words can be encoded together (see Words)
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# letters that stay letters in lower case, and punctuation
_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ÿ]+", "[.,;:!?]+"


class Words:
    """Token ids of words, as the tokenizer gives them.

    Most words are letters, with at most some punctuation behind.  The tokenizer lower-cases them and takes
    the letters as one part and the punctuation as another, so such words can be encoded together as one
    text, parted at spaces without the tokenizer's regular expressions, and told apart by the ids that end a part.
    All others, and all where the vocabulary has other settings, are encoded one by one by the tokenizer as
    it is: names of special tokens in a text, such as ``<|endoftext|>``, become their ids."""

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(vocabulary)
        settings = json.loads(vocabulary)
        suffix = settings["model"].get("end_of_word_suffix")
        split, *rest = (settings.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
        known = (settings.get("normalizer") or {}).get("normalizers") == NORMALIZERS and split.get("pattern") == {"Regex": SPLIT}
        self.plain = None
        if known and suffix:
            settings |= {"normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, *rest]}}
            self.plain = Tokenizer.from_str(json.dumps(settings))
            self.ends_part = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends_part[[n for token, n in self.tokenizer.get_vocab(False).items() if token.endswith(suffix)]] = True

    def _parts(self, words: pa.Array) -> np.ndarray:
        """How many parts each plain word has, 0 for the others."""
        if self.plain is None:
            return np.zeros(len(words), np.int64)
        one, two = (pc.match_substring_regex(words, f"^{p}$") for p in (_LETTERS, _LETTERS + _MARKS))
        return np.where(one, 1, np.where(two, 2, 0))

    def ids(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words end to end, and how many each has."""
        parts = self._parts(words)
        together, single = np.flatnonzero(parts), np.flatnonzero(parts == 0)
        flat, lengths = [np.empty(0, "<u4")], np.zeros(len(words), np.int64)
        plain = pc.replace_substring_regex(pc.utf8_lower(words.take(pa.array(together))), f"({_MARKS})$", " \\1")
        for first in range(0, len(together), WORDS_AT_ONCE):
            own = together[first : first + WORDS_AT_ONCE]
            text = " ".join(plain.slice(first, len(own)).to_pylist())
            flat.append(np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4"))
            # a word ends where its last part does
            ends = np.flatnonzero(self.ends_part[flat[-1]])[np.cumsum(parts[own]) - 1] + 1
            lengths[own] = np.diff(ends, prepend=0)
        for first in range(0, len(single), WORDS_AT_ONCE):
            own = single[first : first + WORDS_AT_ONCE]
            found = self.tokenizer.encode_batch_fast(words.take(pa.array(own)).to_pylist(), add_special_tokens=False)
            found = [np.array(e.ids, "<u4") for e in found]
            lengths[own] = [len(ids) for ids in found]
            flat += found
        # from the order of encoding to that of the words
        encoded = np.concatenate([together, single])
        order = np.empty(len(words), np.int64)
        order[encoded] = np.arange(len(words))
        return gather(np.concatenate(flat), lengths[encoded], order)[0], lengths


@lru_cache(maxsize=1)
def _words(vocabulary: str) -> Words:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Words(vocabulary)


def token_ids(texts: pa.Array, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts end to end, each with its end mark, and where each text ends.

    The vocabulary drops white space and never joins across it, so that the ids of a text are
    those of its words; every distinct word of a slice is encoded once."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    ids, lengths = words.ids(coded.dictionary)
    known, lengths = np.append(ids, np.uint32(END_OF_DOCUMENT)), np.append(lengths, 1)
    offsets = lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    picks = np.insert(coded.indices.to_numpy().astype(np.int64), offsets[1:], len(lengths) - 1)
    flat, ends = gather(known, lengths, picks)
    return flat, ends[offsets[1:] + np.arange(len(texts))]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, piece, start, length, ids_crc32`` and, if wanted, ``ids``.

    A document is its ids and one end mark; only documents longer than ``capacity`` are cut.
    A null or empty text is the end mark alone.  Repeated rows are packed each for itself, and a
    null ``doc_id`` stays null.  ``vocabulary`` is the tokenizer file's content."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)
    kind = PIECES_WITH_IDS if ids else PIECES

    @arrow_function(kind)
    def cut(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        words = _words(shipped.value)
        for batch in batches:
            rows = []
            for texts in slices(plain_strings(batch)):
                flat, ends = token_ids(texts, words)
                begin = 0
                for end in ends.tolist():
                    row = []
                    for number, start in enumerate(range(begin, end, capacity)):
                        own = flat[start : min(start + capacity, end)]
                        row.append((number, start - begin, len(own), zlib.crc32(own.tobytes())))
                        if ids:
                            row[-1] += (own.astype(np.int32),)
                    rows.append(row)
                    begin = end
            yield _piece_lists(rows, ids)

    cut_up = docs.select("doc_id", F.explode(cut(F.col("text"))).alias("p"))
    return cut_up.select("doc_id", "p.*")


def _piece_lists(rows: list[list[tuple]], ids: bool) -> pa.Array:
    offsets = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = [piece for row in rows for piece in row]
    columns = [pa.array([p[i] for p in flat], kind) for i, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
    names = ["piece", "start", "length", "ids_crc32"]
    if ids:
        columns.append(pa.array([p[4] for p in flat], pa.list_(pa.int32())))
        names.append("ids")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, names=names))


def pack(parts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``parts`` (any rows with a ``length`` from 1 to ``capacity``) with ``sequence_id`` and
    ``offset``.

    The lengths' counts, at most ``capacity`` rows, come to the driver; the runs made from them
    go to the executors.  Their number is bounded by the capacity alone, since a length splits at
    most one group of sequences and every other run moves a whole group."""
    blocks = stored_in_blocks(parts, "packing")
    counts = {r.length: r.n for r in blocks.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = sorted(plan(counts, capacity))
    table = np.array(runs or np.empty((0, 6)), np.int64).reshape(-1, 6)
    shipped = parts.sparkSession.sparkContext.broadcast(table)

    @arrow_function("struct<sequence_id:bigint,offset:bigint>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        lengths, ranks = length.to_numpy(zero_copy_only=False), rank.to_numpy(zero_copy_only=False)
        runs = shipped.value
        at = np.searchsorted(runs[:, 0] << 44 | runs[:, 1], lengths << 44 | ranks, side="right") - 1
        inside = ranks - runs[at, 1]
        sequence = runs[at, 3] + inside // runs[at, 2]
        offset = runs[at, 4] + inside % runs[at, 2] * lengths
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    placed = ranked(blocks, "length").withColumn("_at", place("length", "_rank"))
    return placed.select(*parts.columns, "_at.sequence_id", "_at.offset")


def packed(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Documents as packed pieces."""
    return pack(pieces(docs, vocabulary, capacity), capacity)
