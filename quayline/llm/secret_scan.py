"""Secret scans: fixed patterns and sliding-window entropy, in column expressions only.

A candidate is a run of characters that occur in encoded secrets.  Its character class is the
narrowest of hexadecimal digits, letters and digits, and base64 characters that holds it; a window slides over
it, one character enters and one leaves the counts at each step, and the sum of c*log2(c) is
updated by the two counts that change.  The candidate is a secret if any window's Shannon entropy
reaches its class's threshold and no allow-list rule covers it.  Candidates swallow paths and names in
front of a key, so each part between separators is judged by its own class too, and what an allow-list
rule covers does not clear the rest.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from quayline.llm.spans import SPANS, Stretches, apart_from, joined, match_spans, running

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]+"
HEX = "[0-9a-f]+"
KINDS = ["assign", "access", "hex", "entropy"]
SHORTEST = {"assign": 6, "access": 20, "hex": 24}

WINDOW = 24
CANDIDATE = "[A-Za-z0-9+/_=-]{%d,}" % WINDOW
# sums that are updated step by step may miss an exact threshold by so much
ROUNDING = 1e-9
MASK = "[REDACTED]"


class CharacterClass(NamedTuple):
    """Characters in order of their counts, and the bits per character from which a window of
    them looks random."""

    alphabet: str
    bits: float


_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
CLASSES = [
    CharacterClass(_DIGITS + "abcdefABCDEF", 3.0),
    CharacterClass(_DIGITS + _LOWER + _LOWER.upper(), 3.9),
    CharacterClass(_DIGITS + _LOWER + _LOWER.upper() + "+/_=-", 3.9),
]
# candidates that are not secrets however even their characters are
ALLOWED = [
    "[A-Za-z]+([+/_=-]+[A-Za-z]+)*[+/_=-]*",  # words, identifiers and paths of letters alone
    "[0-9]+([+/_=-]+[0-9]+)*",  # numbers, dates, telephone numbers
    "[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}",  # UUIDs
    "sha(1|256|384|512)[-_=].*",  # published digests
    ".*(EXAMPLE|example|PLACEHOLDER|placeholder|xxxxxxxx|XXXXXXXX|00000000|12345678).*",  # samples
]
# a part of a candidate stands between separators; letters of one case have thresholds that most
# random keys of 24 characters reach in base 32 and in base 36, lower-case ones a higher one, since
# names and strings of few letters come nearer to it
SEPARATORS = "+/_=-"
PART_CLASSES = [
    CLASSES[0],
    CharacterClass(_DIGITS + _LOWER, 3.7),
    CharacterClass(_DIGITS + _LOWER.upper(), 3.6),
    CLASSES[1],
]
# what of a candidate the allow-list covers when more follows: a digest is as long as its kind in
# hexadecimal digits at most, a sample word clears the part that it is in
COVERED = (
    "^sha(1[-_=].{0,40}|256[-_=].{0,64}|384[-_=].{0,96}|512[-_=].{0,128})|"
    "[A-Za-z0-9]*(EXAMPLE|example|PLACEHOLDER|placeholder|xxxxxxxx|XXXXXXXX|00000000|12345678)[A-Za-z0-9]*"
)


def _none() -> Column:
    return F.array().cast(SPANS)


def _as_kind(spans: Column, kind: str) -> Column:
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def _long_enough(text: Column, pattern: str, kind: str) -> Column:
    """Spans of the matches, or of those whose second group, is long enough for the kind."""
    spans = match_spans(text, F.lit(pattern))
    shortest = SHORTEST[kind]
    if kind == "assign":
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        both = F.zip_with(spans, values, lambda s, v: F.struct(s.alias("s"), F.length(v).alias("n")))
        kept = F.transform(F.filter(both, lambda b: b["n"] >= shortest), lambda b: b["s"])
    else:
        kept = F.filter(spans, lambda s: s["end"] - s["start"] >= shortest)
    return _as_kind(kept, kind)


def base_spans(text: Column) -> dict[str, Column]:
    """Spans of each base kind.  Most texts leave at a cheap test: the pattern with its length
    built in, a literal part, or the pattern itself."""
    tests = {
        "assign": text.rlike(ASSIGN),
        "access": F.contains(text, F.lit("AKIA")),
        "hex": text.rlike("[0-9a-f]{%d}" % SHORTEST["hex"]),
    }
    # a run of hexadecimal digits is matched whole, so that its least length may be in the pattern
    patterns = {"assign": ASSIGN, "access": ACCESS, "hex": "[0-9a-f]{%d,}" % SHORTEST["hex"]}
    return {kind: F.when(tests[kind], _long_enough(text, patterns[kind], kind)).otherwise(_none()) for kind in patterns}


def window_entropy(characters: Column, alphabet: str, window: int = WINDOW) -> Column:
    """The highest Shannon entropy, in bits per character, of any window over an array of
    ``alphabet``'s characters that is at least one window long."""

    def weight(count: Column) -> Column:
        return F.when(count > 1, count * F.log2(count.cast("double"))).otherwise(F.lit(0.0))

    def number(i: Column) -> Column:
        return F.instr(F.lit(alphabet), F.element_at(characters, i))

    start = F.struct(
        F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("weights"), F.lit(-1.0).alias("best")
    )

    def step(state: Column, i: Column) -> Column:
        # an array of one element, so that each later step can name what the one before has found
        leaving = F.when(i > window, number(F.greatest(i - window, F.lit(1)))).otherwise(F.lit(0))
        moved = F.array(F.struct(number(i).alias("in"), leaving.alias("out"), state.alias("was")))
        return F.element_at(F.transform(F.transform(moved, change), lambda s: seen(s, i)), 1)

    def change(m: Column) -> Column:
        """Two counts change, and the sum of c*log2(c) by what they contribute."""
        was, entering, leaving = m["was"], m["in"], m["out"]
        more = F.element_at(was["counts"], entering)
        less = F.element_at(was["counts"], F.greatest(leaving, F.lit(1)))
        lost = F.when(leaving > 0, weight(less - 1) - weight(less)).otherwise(F.lit(0.0))
        difference = F.when(entering == leaving, F.lit(0.0)).otherwise(weight(more + 1) - weight(more) + lost)
        counts = F.transform(
            was["counts"],
            lambda c, k: c + F.when(k + 1 == entering, 1).otherwise(0) - F.when(k + 1 == leaving, 1).otherwise(0),
        )
        return F.struct(counts.alias("counts"), (was["weights"] + difference).alias("weights"), was["best"].alias("best"))

    def seen(s: Column, i: Column) -> Column:
        bits = F.lit(math.log2(window)) - s["weights"] / F.lit(float(window))
        best = F.when(i >= window, F.greatest(s["best"], bits)).otherwise(s["best"])
        return F.struct(s["counts"].alias("counts"), s["weights"].alias("weights"), best.alias("best"))

    return F.aggregate(F.sequence(F.lit(1), F.size(characters)), start, step, lambda s: s["best"])


def looks_random(candidate: Column, classes: list[CharacterClass] = CLASSES) -> Column:
    """Whether a window of the candidate reaches the threshold of its character class."""
    characters = F.split(candidate, "")
    found = F.lit(False)
    for kind in reversed(classes):
        fits = F.length(F.translate(candidate, kind.alphabet, "")) == 0
        found = F.when(fits, window_entropy(characters, kind.alphabet) >= kind.bits - ROUNDING).otherwise(found)
    return found


def is_secret(candidate: Column) -> Column:
    """Whether the candidate, what the allow-list leaves of it or a part of that looks random."""
    allowed = "^(" + "|".join(f"({rule})" for rule in ALLOWED) + ")$"
    long = lambda pieces: F.filter(pieces, lambda x: (F.length(x) >= WINDOW) & ~x.rlike(allowed))
    left = F.split(F.regexp_replace(candidate, COVERED, " "), f"[{SEPARATORS}]* [{SEPARATORS}]*")
    whole = F.when(candidate.rlike(allowed), long(left)).otherwise(F.array(candidate))
    parts = long(F.flatten(F.transform(left, lambda x: F.split(x, f"[{SEPARATORS}]+"))))
    return F.exists(whole, lambda x: looks_random(x)) | F.exists(parts, lambda x: looks_random(x, PART_CLASSES))


def entropy_spans(text: Column, base: Column) -> Column:
    """Spans of the candidates that look random, that the allow-list does not cover and that touch no
    ``base`` span."""
    spans, found = match_spans(text, F.lit(CANDIDATE)), F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    both = F.zip_with(spans, found, lambda s, c: F.struct(s["start"].alias("start"), s["end"].alias("end"), c.alias("c")))
    free = apart_from(both, base, "struct<start:int,end:int,c:string>")
    kept = F.filter(free, lambda b: is_secret(b["c"]))
    return F.when(text.rlike(CANDIDATE), _as_kind(F.transform(kept, lambda b: F.struct(b["start"], b["end"])), "entropy")).otherwise(_none())


def _columns(docs: DataFrame) -> DataFrame:
    """``docs`` as the column ``doc`` beside ``text``, ``base`` and ``spans``: arrays of ``start, order, end, kind``
    by start, then kind."""
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    found = whole.withColumn("base", F.array_sort(F.flatten(F.array(*base_spans(F.col("text")).values()))))
    return found.withColumn("spans", F.array_sort(F.concat("base", entropy_spans(F.col("text"), F.col("base")))))


def scanned(docs: DataFrame) -> DataFrame:
    """``docs`` with ``secret_base`` and ``secret_spans``: arrays of ``start, order, end, kind`` by
    start, then kind.  Candidates that touch a base span add nothing.

    A null or empty text has none.  Columns of these names are replaced."""
    rest = [c for c in docs.columns if c not in ("secret_base", "secret_spans")]
    own = [F.col(f"doc.`{c}`").alias(c) for c in rest]
    return _columns(docs).select(*own, F.col("base").alias("secret_base"), F.col("spans").alias("secret_spans"))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` of every row; repeated rows give
    repeated results."""
    count = lambda kind: F.size(F.filter("secret_base", lambda s: s["kind"] == kind)).cast("bigint")
    return scanned(docs.select("doc_id", "text")).select(
        "doc_id",
        *[count(kind).alias(f"n_{kind}") for kind in KINDS[:3]],
        F.sha2(joined(F.col("secret_base")), 256).alias("base_sha256"),
        joined(F.col("secret_spans")).alias("spans"),
    )


def redacted(docs: DataFrame, mask: str = MASK) -> DataFrame:
    """All rows and columns, whatever they are called; in ``text`` each stretch of touching spans is ``mask``
    instead, and ``n_chars``, if there is one, is counted anew for those rows."""
    found = _columns(docs)
    stretches = Stretches(F.col("text"))
    found = found.withColumn("stretches", F.when(F.size("spans") > 0, stretches.whole))

    def between(at: Column, s: Column) -> Column:
        # what stands before the span and the mask, or nothing where it touches the one before
        parts = F.concat(stretches.piece(F.col("stretches"), at, s["start"]), F.lit(mask))
        return F.when((s["start"] > at) | (at == 0), parts).otherwise(F.when(s["start"] < at, "").otherwise(F.lit(mask)))

    end = lambda at, s: F.greatest(at, s["end"])
    parts = running(F.col("spans"), F.lit(0), end, between, "int", "string")
    last = F.array_max(F.transform("spans", lambda s: s["end"]))
    masked = F.concat(F.array_join(parts, ""), stretches.piece(F.col("stretches"), last, F.length("text")))
    out = found.withColumn("masked", F.when(F.size("spans") > 0, masked))
    changed = {"text": F.coalesce("masked", F.col("doc.text"))}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.coalesce(F.length("masked").cast(docs.schema["n_chars"].dataType), F.col("doc.n_chars"))
    return out.select(*[changed.get(c, F.col(f"doc.`{c}`")).alias(c) for c in docs.columns])
