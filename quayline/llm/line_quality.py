"""Quality rules by cross-document line frequency.

A line that many different texts of one host carry is boilerplate: its normalised form is hashed,
the different texts of each host that contain it are counted, lines above the limits are removed,
and documents of which too little remains are rejected.  Exact copies count as one text.

A text that consists of shared lines nearly whole is either a page of a template or a near copy
of another text, whose lines are no boilerplate.  What tells them apart is what else they hold.  A near copy
has other lines *in the place* of lines that its siblings have; a page of a template has all of
the template, and lines of its own beside it.  Near copies do not count, and pages with little of their own
count less than other texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from hashlib import md5

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from quayline.llm.common import arrow_function, as_bytes, stored


@dataclass(frozen=True)
class Limits:
    """A line is boilerplate on a host with at least ``texts`` different texts that have it; one of
    fewer than ``long`` words, which texts may share by chance, only if they are more than ``share``
    of the host's.  A document is depleted when less than ``remaining`` of its words stay.  ``words``
    and ``repeated`` are the limits of the base rules.

    A text is alike others when lines that it shares hold ``alike`` of its words.  It is an edited copy when
    at least half of the words of its other lines are in lines that took the place of one that its siblings
    have: the line usual after the same line, or before the same line, is missing.  Texts that are alike count
    one for ``texts`` in all if most that have the line are no copies, else nothing."""

    texts: int = 5
    share: float = 0.1
    remaining: float = 0.5
    words: int = 50
    repeated: float = 0.5
    long: int = 8
    alike: float = 0.8


LIMITS = Limits()
SYMBOLS = b"#*$%&|<>"
_DIGITS = re.compile(rb"[0-9]+")

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
LINE = ["line", "words", "size", "before", "after"]
MEASURED = f"struct<{','.join(f'{c}:bigint' for c in COUNTS)},lines:array<struct<{','.join(f'{c}:bigint' for c in LINE)}>>>"


def normalised(line: bytes) -> bytes:
    """A-Z lower-cased, each run of white space one space, each number 0."""
    return _DIGITS.sub(b"0", b" ".join(line.lower().split()))


def line_hash(line: bytes) -> int:
    """The first 64 bits of the normalised line's MD5, in the order of their hexadecimal digits."""
    return int.from_bytes(md5(normalised(line), usedforsecurity=False).digest()[:8], "big") - (1 << 63)


def repeated_words(words: list[bytes]) -> int:
    """Words inside windows of three that occur twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts = Counter(windows)
    covered = bytearray(len(words))
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered[i : i + 3] = b"\1\1\1"
    return sum(covered)


class Measures:
    """The counts of texts, and their different lines that have a word: hash, words in all its places, words in
    one, and the lines before and after its first place.  Kept as flat columns."""

    def __init__(self) -> None:
        self.counts: list[list[int]] = [[] for _ in COUNTS]
        self.lines: list[list[int | None]] = [[] for _ in LINE]
        self.ends = [0]

    def add(self, text: bytes) -> None:
        words = text.split()
        spaces = len(text) - sum(map(len, words))
        seen, repeats, first, keys = set(), 0, {}, []
        for line in text.split(b"\n"):
            size = len(line.split())
            if size:
                repeats += line in seen
                seen.add(line)
                key = line_hash(line)
                held = first.setdefault(key, [len(keys), size, 0])
                held[2] += size
                keys.append(key)
        for column, value in zip(
            self.counts, (len(words), len(text.decode()) - spaces, len(text) - len(text.translate(None, SYMBOLS)), repeats, repeated_words(words))
        ):
            column.append(value)
        for key, (at, size, total) in first.items():
            after = keys[at + 1] if at + 1 < len(keys) else None
            for column, value in zip(self.lines, (key, total, size, keys[at - 1] if at else None, after)):
                column.append(value)
        self.ends.append(len(self.lines[0]))

    def column(self) -> pa.StructArray:
        lines = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in self.lines], names=LINE)
        counts = [pa.array(c, pa.int64()) for c in self.counts]
        return pa.StructArray.from_arrays([*counts, pa.ListArray.from_arrays(pa.array(self.ends, pa.int32()), lines)], names=[*COUNTS, "lines"])


def _measured(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        measures = Measures()
        for text in as_bytes(batch):
            measures.add(text)
        yield measures.column()


def text_key(text: str = "text") -> Column:
    """Equal for equal texts only; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))


def measured(docs: DataFrame, host: str = "source") -> DataFrame:
    """``doc_id, host, text_key``, the counts and the lines of every row."""
    rows = docs.select("doc_id", F.col(host).alias("host"), text_key().alias("text_key"), arrow_function(MEASURED)(_measured)("text").alias("m"))
    return rows.select("doc_id", "host", "text_key", "m.*")


def _on(left: DataFrame, right: DataFrame, *columns: str, how: str = "inner") -> DataFrame:
    """Joined on equal columns, of which the host may be null; the right side's are dropped."""
    names = {c: f"{c}_right" for c in columns}
    other = right.withColumnsRenamed(names)
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(n)) if c == "host" else F.col(c) == F.col(n) for c, n in names.items()])
    return left.join(other, same, how).drop(*names.values())


def shared_lines(texts: DataFrame, least: int = 2) -> DataFrame:
    """``host, line, texts, size`` of the lines that at least so many texts of a host have, from one row per
    host and text."""
    lines = texts.select("host", F.inline("lines"))
    return lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("texts"), F.first("size").alias("size")).where(F.col("texts") >= least)


def _copies(texts: DataFrame, shared: DataFrame, alike: DataFrame) -> DataFrame:
    """``host, text_key`` of those of the ``alike`` texts that are edited copies of others."""
    members = _on(texts.select("host", "text_key", "lines"), alike.select("host", "text_key"), "host", "text_key")
    lines = members.select("host", "text_key", F.inline("lines"))
    lines = _on(lines, shared.select("host", "line", F.lit(True).alias("common")), "host", "line", how="left")
    places = F.array(
        F.struct(F.lit(False).alias("follows"), F.col("after").alias("beside")), F.struct(F.lit(True).alias("follows"), F.col("before").alias("beside"))
    )
    placed = stored(lines.select("host", "text_key", "line", "words", "common", F.inline(places)).where("beside IS NOT NULL"), "line-places")
    counted = placed.where("common").groupBy("host", "follows", "beside", "line").agg(F.count(F.lit(1)).alias("n"))
    usual = counted.groupBy("host", "follows", "beside").agg(F.max(F.struct("n", "line")).alias("most"))
    usual = usual.where("most.n > 1").select("host", "follows", "beside", F.col("most.line").alias("usual"))
    other = _on(placed.where("common IS NULL"), usual, "host", "follows", "beside", how="left")
    has = placed.where("common").select("host", "text_key", F.col("line").alias("usual"), F.lit(True).alias("has")).distinct()
    other = _on(other, has, "host", "text_key", "usual", how="left")
    missing = F.col("usual").isNotNull() & F.col("has").isNull()
    by_line = other.groupBy("host", "text_key", "line").agg(F.first("words").alias("words"), F.bool_or(missing).alias("instead"))
    by_text = by_line.groupBy("host", "text_key").agg(F.sum("words").alias("words"), F.sum(F.when(F.col("instead"), F.col("words"))).alias("instead"))
    edited = by_text.where(2 * F.col("instead") >= F.col("words")).select("host", "text_key")
    # without any other line a text is a part of its siblings
    return edited.unionByName(_on(alike.select("host", "text_key"), by_text.select("host", "text_key"), "host", "text_key", how="left_anti"))


def boilerplate(texts: DataFrame, limits: Limits = LIMITS) -> tuple[DataFrame, DataFrame]:
    """``host, line`` above the limits, from one row per host and text; and the places of shared
    lines (``host, text_key, line, words``)."""
    shared = stored(shared_lines(texts, min(2, limits.texts)), "shared-lines")
    lines = texts.select("host", "text_key", "n_words", F.inline("lines")).select("host", "text_key", "n_words", "line", "words")
    places = stored(_on(lines, shared, "host", "line"), "shared-places")
    by_text = places.where("texts > 1").groupBy("host", "text_key").agg(F.sum("words").alias("held"), F.first("n_words").alias("n_words"))
    alike = stored(by_text.where(F.col("held") >= F.lit(limits.alike) * F.col("n_words")).select("host", "text_key"), "alike-texts")
    copies = _copies(texts, shared.where("texts > 1"), alike)
    kinds = _on(alike, copies.withColumn("copy", F.lit(True)), "host", "text_key", how="left")
    kinds = kinds.select("host", "text_key", F.coalesce("copy", F.lit(False)).alias("copy"))
    often = _on(places.where(F.col("texts") >= limits.texts), kinds, "host", "text_key", how="left")
    own = F.count(F.when(F.col("copy") == F.lit(False), 1))
    weighed = often.groupBy("host", "line").agg(
        F.first("texts").alias("texts"), F.first("size").alias("size"), F.count(F.when(F.col("copy").isNull(), 1)).alias("full"),
        own.alias("own"), F.count("copy").alias("alike"),
    )
    units = limits.texts * F.col("full") + F.when(2 * F.col("own") >= F.col("alike"), F.col("own")).otherwise(0)
    sizes = texts.groupBy("host").agg(F.count(F.lit(1)).alias("host_texts"))
    above = _on(weighed.where(units >= limits.texts**2), sizes, "host")
    common = (F.col("size") >= limits.long) | (F.col("texts") > F.lit(limits.share) * F.col("host_texts"))
    return above.where(common).select("host", "line"), places


def depletion(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """For each host and text that has boilerplate: its ``removed_words`` and ``removed_lines``."""
    texts = rows.groupBy("host", "text_key").agg(F.first("n_words").alias("n_words"), F.first("lines").alias("lines"))
    found, places = boilerplate(texts, limits)
    hit = _on(places, found, "host", "line")
    return hit.groupBy("host", "text_key").agg(F.sum("words").alias("removed_words"), F.collect_list("line").alias("removed_lines"))


def verdicts(rows: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """``measured`` rows with ``base_failed``, ``kept``, ``removed_words`` and ``removed_lines``."""
    base = (F.col("n_words") < limits.words) | (F.col("n_repeat_words") > F.lit(limits.repeated) * F.col("n_words"))
    joined = _on(rows, depletion(rows, limits), "host", "text_key", how="left")
    left = F.col("n_words") - F.coalesce("removed_words", F.lit(0))
    return joined.withColumn("base_failed", base).withColumn(
        "kept", ~F.col("base_failed") & (left >= F.lit(limits.remaining) * F.col("n_words"))
    )


def judged(docs: DataFrame, limits: Limits = LIMITS, host: str = "source") -> DataFrame:
    """``doc_id``, the counts, ``base_failed`` and ``kept`` of every row.

    A null text counts as empty and fails the base rules; null hosts are one host; repeated rows
    are judged alike; an empty table gives no rows."""
    rows = stored(measured(docs, host), "lines")
    return verdicts(rows, limits).select("doc_id", *COUNTS, "base_failed", "kept")


def _without_lines(texts: pa.Array, removed: pa.Array) -> pa.Array:
    def cleaned(text: bytes, lines: list[int]) -> str:
        gone = set(lines)
        return b"\n".join(x for x in text.split(b"\n") if not x.split() or line_hash(x) not in gone).decode()

    given = zip(texts, as_bytes(texts), removed)
    return pa.array([cleaned(text, lines.as_py()) if lines.is_valid else plain.as_py() for plain, text, lines in given], pa.string())


def cleaned(docs: DataFrame, limits: Limits = LIMITS, host: str = "source") -> DataFrame:
    """The kept rows, with all their columns, whatever they are called; boilerplate lines are removed from
    ``text`` and ``n_chars``, if there is one, is counted anew for those rows."""
    rows = stored(measured(docs, host), "lines")
    decided = verdicts(rows, limits).where("NOT kept OR removed_lines IS NOT NULL")
    decided = decided.groupBy("host", "text_key").agg(F.first("kept").alias("kept"), F.first("removed_lines").alias("removed"))
    # the rows are one column beside the operator's own
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(host).alias("host"), text_key().alias("text_key"))
    kept = _on(whole, decided, "host", "text_key", how="left").where("kept IS NULL OR kept")
    text = F.when(F.col("removed").isNotNull(), arrow_function("string")(_without_lines)(F.col("doc.text"), "removed")).otherwise(F.col("doc.text"))
    out = kept.select("doc", "removed", text.alias("text"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        counted = F.when(F.col("removed").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))
        changed["n_chars"] = counted.otherwise(F.col("doc.n_chars"))
    return out.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
