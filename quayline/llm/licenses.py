"""License scans by ordered signature rules, in column expressions only.

A text without any of a few keywords is passed over.  Of the others the words are joined by single
spaces; each rule whose own keyword occurs is matched, and detections that overlap by containment
are resolved: the rule of better priority stands, of two alike the longer one.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from quayline.llm.license_rules import ANCHORS, CONFIDENCE, RULES, Rule
from quayline.llm.spans import match_spans, running

BASE = [("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license")]
# all but the ASCII characters that are no letters or digits; as ranges, several times the speed of
# the complement
WORD = r"[0-9A-Za-z\x80-\x{10FFFF}]+"
RULE_TABLE = "array<struct<rule:int,priority:int,label:string,keywords:array<string>,also:string,pattern:string>>"
SCRATCH = ["license_text", "license_words", "license_line", "license_keywords"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
DETECTIONS = "array<struct<start:int,end:int,priority:int,rule:int,label:string>>"


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(WORD), F.lit(0))


def line_of(words: Column) -> Column:
    """The words with one space before, between and after them."""
    return F.concat(F.lit(" "), F.array_join(words, " "), F.lit(" "))


def _spaces(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def places(words: Column, line: Column, phrase: str) -> Column:
    """Where the phrase's words stand one after the other."""
    wanted = phrase.split(" ")
    starts = F.sequence(F.lit(0), F.size(words) - len(wanted))

    def stands(i: Column) -> Column:
        # the last word first: it is the rarer one
        hits = [F.element_at(words, i + j + 1) == w for j, w in reversed(list(enumerate(wanted)))]
        found = hits[0]
        for hit in hits[1:]:
            found = found & hit
        return found

    some = F.contains(line, F.lit(f" {phrase} "))
    return F.when(some, F.filter(starts, stands)).otherwise(F.array().cast("array<int>"))


def _labelled(starts: Column, label: str) -> Column:
    return F.transform(starts, lambda i: F.struct(i.alias("start"), F.lit(label).alias("label")))


def _constant(value: list, kind: str) -> Column:
    """A table as one literal, which the optimizer turns into its value once: hundreds of nested
    expressions would cost the planner more than the scan of a small corpus."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _rule_table(rules: Sequence[Rule]) -> Column:
    """Word-bounded patterns: a match starts behind a space and ends before one."""
    rows = [
        {**rule._asdict(), "rule": i, "pattern": f"(?<= )({rule.pattern})(?= )"} for i, rule in enumerate(rules)
    ]
    return _constant(rows, RULE_TABLE)


def keywords_in(line: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The rules' keywords that begin a word of the line."""
    keywords = sorted({k for r in rules for k in (*r.keywords, r.also)})
    return F.filter(_constant(keywords, "array<string>"), lambda k: F.contains(line, F.concat(F.lit(" "), k)))


def detections(line: Column, present: Column, rules: Sequence[Rule] = RULES) -> Column:
    """All matches of the rules whose keywords are ``present``; ``start`` and ``end`` count words."""
    tried = F.filter(
        F.filter(_rule_table(rules), lambda r: F.arrays_overlap(r["keywords"], present) & F.array_contains(present, r["also"])),
        lambda r: F.rlike(line, r["pattern"]),
    )

    def found(r: Column) -> Column:
        # in spaces: the first word has one in front, and a match has one less than words
        spans = match_spans(line, r["pattern"], _spaces)
        return F.zip_with(
            spans,
            F.array_repeat(r, F.size(spans)),
            lambda s, rule: F.struct(
                (s["start"] - 1).alias("start"), s["end"].alias("end"), rule["priority"].alias("priority"),
                rule["rule"].alias("rule"), rule["label"].alias("label"),
            ),
        )

    return F.flatten(F.transform(tried, found))


def standing(found: Column) -> Column:
    """Detections that no other one suppresses.  Of two of which one contains the other, the better
    priority stands, then the longer one, then the earlier rule.

    Two passes over the detections in order, containers first.  Forward, the furthest ends by priority tell
    whether an earlier detection of the same or a better priority reaches over this one; backward, the nearest ends
    tell whether one of a better priority lies inside."""
    entry = "struct<start:int,back:int,priority:int,rule:int,end:int,label:string>"
    levels = F.lit(len(CONFIDENCE))

    def ordered(d: Column) -> Column:
        names = ("start", "back", "priority", "rule", "end", "label")
        values = (d["start"], -d["end"], d["priority"], d["rule"], d["end"], d["label"])
        return F.struct(*[v.alias(n) for n, v in zip(names, values)])

    def marked(suppressed: Column, d: Column) -> Column:
        return F.struct(d.alias("d"), suppressed.alias("gone"))

    pair = f"struct<d:{entry},gone:boolean>"
    keep = lambda ends, d, best: F.transform(ends, lambda v, k: F.when(k + 1 == d["priority"], best(v, d["end"])).otherwise(v))
    forward = running(
        F.array_sort(F.transform(found, ordered)), F.array_repeat(F.lit(-1), levels), lambda ends, d: keep(ends, d, F.greatest),
        lambda ends, d: marked(F.exists(F.slice(ends, F.lit(1), d["priority"]), lambda v: v >= d["end"]), d), "array<int>", pair,
    )
    backward = running(
        F.reverse(forward), F.array_repeat(F.lit((1 << 31) - 1), levels), lambda ends, p: keep(ends, p["d"], F.least),
        lambda ends, p: marked(p["gone"] | F.exists(F.slice(ends, F.lit(1), p["d"]["priority"] - 1), lambda v: v <= p["d"]["end"]), p["d"]),
        "array<int>", pair,
    )
    names = ("start", "end", "priority", "rule", "label")
    return F.transform(F.filter(backward, lambda p: ~p["gone"]), lambda p: F.struct(*[p["d"][n].alias(n) for n in names]))


def scanned(docs: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """``docs`` with ``license_places`` (base phrases: ``start, label``) and ``license_found``, the
    standing detections.  A null or empty text has none.  Columns of these names are replaced."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.withColumn("license_text", F.lower(text))
    some = reduce(or_, [F.contains(F.col("license_text"), F.lit(anchor)) for anchor in ANCHORS])
    read = read.withColumn("license_words", F.when(some, words_of(text)).otherwise(F.array().cast("array<string>")))
    words, line = F.col("license_words"), F.col("license_line")
    # a column of its own: the rules read it hundreds of times
    read = read.withColumn("license_line", F.when(F.size(words) > 0, line_of(words)))
    base = F.concat(*[_labelled(places(words, line, phrase), label) for label, phrase in BASE])
    read = read.withColumn("license_places", F.array_sort(base))
    read = read.withColumn("license_keywords", F.when(line.isNotNull(), keywords_in(line, rules)))
    found = detections(line, F.col("license_keywords"), rules)
    read = read.withColumn("license_found", F.when(line.isNotNull(), found).otherwise(F.array().cast(DETECTIONS)))
    return read.withColumn("license_found", F.array_sort(F.when(F.size("license_found") > 1, standing(F.col("license_found"))).otherwise(F.col("license_found")))).drop(*SCRATCH)


def labels(found: Column) -> Column:
    return F.array_distinct(F.transform(found, lambda d: d["label"]))


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every row;
    repeated rows give repeated results.  ``score`` is the confidence of the surest detection."""
    read = scanned(docs.select("doc_id", "text"))
    base, found = F.col("license_places"), F.col("license_found")
    joined = lambda names: F.array_join(F.array_sort(names), ",")
    confidence = F.create_map(*[F.lit(x) for pair in CONFIDENCE.items() for x in pair])
    surest = F.array_max(F.transform(found, lambda d: F.element_at(confidence, d["priority"])))
    phrase = F.when(F.size(base) > 0, F.lit(0.5)).otherwise(F.lit(0.0))
    return read.select(
        "doc_id",
        F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("bigint").alias("n_words"),
        F.size(base).cast("bigint").alias("n_base"),
        F.array_min(base)["start"].cast("bigint").alias("first_word"),
        F.array_max(base)["start"].cast("bigint").alias("last_word"),
        joined(labels(base)).alias("base_labels"),
        joined(F.array_union(labels(base), labels(found))).alias("labels"),
        F.greatest(phrase, F.coalesce(surest, F.lit(0.0))).alias("score"),
    )
