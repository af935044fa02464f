"""Byte-level BPE by recursive queries: every partition asks an in-process database of its own.

Text is cut by the vocabulary's pattern.  A distinct match is encoded once: its bytes are rows
of (word, position, token); a recursive query joins neighbours with the merge table and contracts
the leftmost pair of minimum rank of every word until no word has one.  Decoding joins ids with
their bytes and aggregates them in order.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from quayline.llm.common import arrow_function, gather, plain_strings, slices

# rows of a recursion are its words' bytes times its steps: words per query, and the longest word
# that goes through it; a longer one (a run without white space) is merged with a heap instead
WORDS_PER_QUERY = 30_000
LONGEST_WORD = 128
CACHED_WORDS = 200_000
SLICE_BYTES = 4 << 20
DATABASE = {"threads": 1, "memory_limit": "300MB", "temp_directory": ""}
# two white-space characters in a row, or one at an end: such texts are cut as a whole
SPACED = r"^[\s\v\x{85}\pZ]|[\s\v\x{85}\pZ]$|[\s\v\x{85}\pZ]{2}"

# a place is the word's number times 256 and the position in it; the rank of a merge is the id of
# its token, so that the smallest (id, position) of a word is its leftmost pair of minimum rank
ENCODE = """
    WITH RECURSIVE state(place, id, live) AS (
        SELECT place, id, true FROM bytes
        UNION ALL (
            WITH neighbour AS (
                SELECT place, id, lead(id) OVER near AS next_id, lead(place) OVER near AS next_place
                FROM state WHERE live WINDOW near AS (ORDER BY place)
            ),
            best AS (
                SELECT place // 256 AS word, min(m.id * 256 + place % 256) AS chosen,
                       arg_min(next_place, m.id * 256 + place % 256) AS gone
                FROM neighbour n JOIN merges m ON m.left_id = n.id AND m.right_id = n.next_id
                WHERE place // 256 = next_place // 256 GROUP BY place // 256
            )
            SELECT place, CASE WHEN place % 256 = chosen % 256 THEN chosen // 256 ELSE id END, chosen IS NOT NULL
            FROM neighbour LEFT JOIN best ON best.word = place // 256
            WHERE gone IS NULL OR place <> gone
        )
    )
    SELECT list(id ORDER BY place) AS ids FROM state WHERE NOT live GROUP BY place // 256 ORDER BY place // 256
"""
DECODE = """
    SELECT unhex(coalesce(string_agg(hex, '' ORDER BY pos), '')) AS bytes
    FROM ids LEFT JOIN tokens USING (id) GROUP BY row ORDER BY row
"""


def read_ranks(content: bytes) -> dict[bytes, int]:
    """The lines of a rank file: token in base64, rank."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, content.splitlines())}


class Vocabulary:
    """The merge and token tables in a database of this worker, and what it has encoded."""

    def __init__(self, content: bytes, pattern: str):
        import duckdb
        import regex

        self.ranks = read_ranks(content)
        self.pattern = regex.compile(pattern)
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int32)
        merges = [
            (self.ranks[token[:i]], self.ranks[token[i:]], rank)
            for token, rank in self.ranks.items()
            for i in range(1, len(token))
            if token[:i] in self.ranks and token[i:] in self.ranks
        ]
        self.database = duckdb.connect(config=DATABASE)
        self._table("merges", dict(zip(("left_id", "right_id", "id"), np.array(merges, np.int32).reshape(-1, 3).T)))
        self._table("tokens", {"id": list(self.ranks.values()), "hex": [token.hex() for token in self.ranks]})
        # of whole words, and of the pattern's matches inside them
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.matches: dict[str, tuple[bytes, bytes]] = {}

    def _table(self, name: str, columns: dict) -> None:
        given = pa.table({k: pa.array(v) for k, v in columns.items()})
        self.database.register("given", given)
        self.database.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.database.unregister("given")

    def _ask(self, query: str, name: str, table: pa.Table) -> list:
        self.database.register(name, table)
        try:
            return [row[0] for row in self.database.execute(query).fetchall()]
        finally:
            self.database.unregister(name)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word.  A word that is a token is that token."""
        ids = [[self.ranks[w]] if w in self.ranks else None for w in words]
        asked = [i for i, w in enumerate(words) if ids[i] is None and 0 < len(w) <= LONGEST_WORD]
        for first in range(0, len(asked), WORDS_PER_QUERY):
            part = asked[first : first + WORDS_PER_QUERY]
            lengths = np.array([len(words[i]) for i in part])
            flat = np.frombuffer(b"".join(words[i] for i in part), np.uint8)
            start = np.repeat(np.cumsum(lengths) - lengths, lengths)
            places = np.repeat(np.arange(len(part)) * 256, lengths) + np.arange(len(flat)) - start
            rows = pa.table({"place": places.astype(np.int32), "id": self.byte_ids[flat]})
            for i, found in zip(part, self._ask(ENCODE, "bytes", rows)):
                ids[i] = found
        return [self.merged(w) if found is None else found for w, found in zip(words, ids)]

    def merged(self, word: bytes) -> list[int]:
        """Ids of one long word: the pairs wait in a heap by rank and position."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(word) + 1)), list(range(-1, len(word) - 1))

        def pair(i: int) -> tuple[int, int, int, int] | None:
            j = after[i]
            rank = self.ranks.get(parts[i] + parts[j]) if j < len(parts) else None
            return None if rank is None else (rank, i, len(parts[i]), len(parts[j]))

        waiting = [p for p in map(pair, range(len(word))) if p]
        heapq.heapify(waiting)
        while waiting:
            rank, i, left, right = heapq.heappop(waiting)
            j = after[i]
            if len(parts[i]) != left or j >= len(parts) or len(parts[j]) != right or not parts[i]:
                continue  # one of the two has been merged since
            parts[i], parts[j], ids[i] = parts[i] + parts[j], b"", rank
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            waiting_again = [p for p in (pair(i), pair(before[i]) if before[i] >= 0 else None) if p]
            for p in waiting_again:
                heapq.heappush(waiting, p)
        return [token for token, part in zip(ids, parts) if part]

    def decode(self, sequences: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids; unknown ids have none."""
        lengths = np.fromiter(map(len, sequences), np.int64, len(sequences))
        padded = np.maximum(lengths, 1)  # an empty sequence is one row with an unknown id
        start = np.repeat(np.cumsum(padded) - padded, padded)
        ids = np.full(int(padded.sum()), -1, np.int64)
        where = np.arange(len(ids)) - start
        ids[where < np.repeat(lengths, padded)] = np.fromiter((i for s in sequences for i in s), np.int64, int(lengths.sum()))
        rows = pa.table({"row": np.repeat(np.arange(len(sequences)), padded), "pos": where, "id": ids})
        return self._ask(DECODE, "ids", rows)

    def words(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids (little-endian, 32 bits each) and the bytes they decode to."""
        for cache in (self.known, self.matches):
            if len(cache) > CACHED_WORDS:
                cache.clear()
        new = [t for t in dict.fromkeys(texts) if t not in self.known]
        found = [self.pattern.findall(t) for t in new]
        distinct = [m for m in dict.fromkeys(m for own in found for m in own) if m not in self.matches]
        ids = self.encode([m.encode() for m in distinct])
        plain = self.decode(ids) if ids else []
        self.matches.update(zip(distinct, zip((np.array(i, "<u4").tobytes() for i in ids), plain)))
        for text, own in zip(new, found):
            if len(own) == 1:
                self.known[text] = self.matches[own[0]]
            else:
                self.known[text] = b"".join(self.matches[m][0] for m in own), b"".join(self.matches[m][1] for m in own)
        return [self.known[t] for t in texts]


@lru_cache(maxsize=1)
def _vocabulary(content: bytes, pattern: str) -> Vocabulary:
    return Vocabulary(content, pattern)


def _encoded(texts: pa.Array, vocabulary: Vocabulary) -> Iterator[tuple[bytes, bytes]]:
    """For each text its ids and the bytes they decode to.

    A single space between two other characters always starts a match, so that a text falls into
    words with the space in front, most of which repeat.  A text with other white space than
    single ones inside is cut by the pattern as a whole."""
    spaced = pc.match_substring_regex(texts, SPACED).to_numpy(zero_copy_only=False)
    single = texts.filter(pa.array(~spaced))
    lists = pc.split_pattern(single, " ")
    coded = lists.flatten().dictionary_encode()
    offsets = lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    words = [" " + w for w in coded.dictionary.to_pylist()]
    picks = coded.indices.to_numpy().astype(np.int64)
    firsts = pc.take(coded.dictionary, pa.array(picks[offsets[:-1]])).to_pylist()
    picks[offsets[:-1]] = len(words) + np.arange(len(single))
    found = vocabulary.words(words + firsts)
    parts = []
    for side, kind in ((0, "<u4"), (1, np.uint8)):
        flat = np.frombuffer(b"".join(f[side] for f in found), kind)
        lengths = np.fromiter((len(f[side]) for f in found), np.int64, len(found)) // flat.itemsize
        out, ends = gather(flat, lengths, picks)
        bounds = [0, *ends[offsets[1:] - 1].tolist()]
        parts.append((out, bounds))
    (ids, id_bounds), (plain, plain_bounds) = parts
    row = 0
    for text, whole in zip(texts, spaced):
        if whole:
            matches = vocabulary.pattern.findall(text.as_py())
            own = vocabulary.words(matches)
            yield b"".join(o[0] for o in own), b"".join(o[1] for o in own)
        else:
            yield ids[id_bounds[row] : id_bounds[row + 1]].tobytes(), plain[plain_bounds[row] : plain_bounds[row + 1]].tobytes()
            row += 1


def _per_text(docs: DataFrame, content: bytes, pattern: str, kind: str, result) -> DataFrame:
    shipped = docs.sparkSession.sparkContext.broadcast((content, pattern))

    @arrow_function(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(*shipped.value)
        for batch in batches:
            yield result(e for texts in slices(plain_strings(batch), SLICE_BYTES) for e in _encoded(texts, vocabulary))
        for cache in (vocabulary.known, vocabulary.matches):
            cache.clear()  # the worker lives on, for tasks of other kinds too

    return run(F.col("text"))


def encode(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """``docs`` with ``ids``.  ``content`` is the rank file's.  A null or empty text has no ids."""

    def result(found) -> pa.Array:
        return pa.array([np.frombuffer(ids, "<i4") for ids, _ in found], pa.list_(pa.int32()))

    return docs.withColumn("ids", _per_text(docs, content, pattern, "array<int>", result))


def decode(rows: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """``rows`` with ``bytes``, the binary that their ``ids`` stand for; null ids give none."""
    shipped = rows.sparkSession.sparkContext.broadcast((content, pattern))

    @arrow_function("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        vocabulary = _vocabulary(*shipped.value)
        for batch in batches:
            sequences = [ids or [] for ids in batch.to_pylist()]
            parts = [vocabulary.decode(sequences[i : i + 1000]) for i in range(0, len(sequences), 1000)]
            yield pa.array([b for part in parts for b in part], pa.binary())

    return rows.withColumn("bytes", run(F.col("ids")))


def digests(docs: DataFrame, content: bytes, pattern: str) -> DataFrame:
    """``doc_id, n_tokens`` and the SHA-256 of the ids and of the bytes that they decode to.

    Null and empty texts have no ids and the digest of nothing; repeated rows give repeated
    results."""

    def result(found) -> pa.Array:
        rows = [(len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(plain).hexdigest()) for ids, plain in found]
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
        return pa.StructArray.from_arrays(columns, names=["n_tokens", "ids_sha256", "decoded_sha256"])

    kind = "struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>"
    return docs.select("doc_id", _per_text(docs, content, pattern, kind, result).alias("d")).select("doc_id", "d.*")
