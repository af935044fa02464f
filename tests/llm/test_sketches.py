import base64
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.llm import sketches
from tests.llm import brute


def expected(rows):
    """(doc_id, n_chars, edited digest, near_edited, near_next), the text of the next row beside each."""
    found = []
    for (doc_id, text), (_, following) in zip(rows, rows[1:] + rows[:1]):
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        near = [brute.likeness(text, x, sketches.SCALE, sketches.SHINGLE_WORDS, sketches.FEW) for x in (edited, following)]
        found.append((doc_id, len(text), brute.sha(edited), *near))
    return found


def check(docs):
    rows = sorted(((r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()), reverse=True)
    found = sketches.compared(docs).collect()
    assert sorted((r.doc_id, r.n_chars, r.edited_sha256, r.near_edited, r.near_next) for r in found) == sorted(expected(rows))
    return found


@pytest.mark.parametrize("rows_per_range", [1024, 30, 1])
def test_against_brute_force(sample, odd, monkeypatch, rows_per_range):
    monkeypatch.setattr(sketches, "ROWS_PER_RANGE", rows_per_range)
    rows = check(sample)
    texts = {r.doc_id: r.text for r in sample.collect()}
    prints = {}
    for r in rows:
        assert prints.setdefault(texts[r.doc_id], r.fingerprint) == r.fingerprint
    check(odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]))
    check(sample.limit(1))


def test_repeated_and_null_ids(odd, empty, monkeypatch):
    monkeypatch.setattr(sketches, "ROWS_PER_RANGE", 2)
    found = sketches.compared(odd).collect()
    assert sorted(str(r.doc_id) for r in found) == sorted(str(r.doc_id) for r in odd.select("doc_id").collect())
    assert sketches.compared(empty).collect() == []


def test_crowded_id_is_spread(spark, monkeypatch):
    monkeypatch.setattr(sketches, "ROWS_PER_RANGE", 50)
    docs = spark.range(900).select(F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id")).alias("doc_id"), F.concat(F.lit("t "), F.col("id")).alias("text"))
    ranges = sketches.Ranges(docs)
    rows = docs.select("doc_id", F.xxhash64("text").alias("tie")).toArrow()
    numbers = ranges.number(rows["doc_id"].combine_chunks(), rows["tie"].combine_chunks())
    assert np.bincount(numbers).max() < 150
    found = sketches.compared(docs).collect()
    assert len(found) == 900 and sorted(r.doc_id for r in found) == sorted(r.doc_id for r in docs.collect())


def test_containment_of_unequal_texts():
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(40_000)]
    part = words[1000:3000]
    whole, inside, half = (sketches.sketch(" ".join(w).encode()) for w in (words, part, part[:1000] + [f"x{i}" for i in range(1000)]))
    assert sketches.containment(inside, whole) > 0.97 and abs(sketches.containment(half, whole) - 0.5) < 0.1
    assert len(base64.b64decode(sketches.as_string(whole))) == 6 * len(whole.kept)


def test_short_texts_inside_long_ones():
    """Texts of two shingles, each whole inside a text of a thousand words: contained, and no other is."""
    rng = random.Random(8)
    short = [" ".join(f"s{i}w{k}" for k in range(6)) for i in range(40)]
    filler = [f"f{rng.randrange(10**6)}" for _ in range(1000)]
    for i, text in enumerate(short):
        at = rng.randrange(1000)
        whole = sketches.sketch(" ".join([*filler[:at], text, *filler[at:]]).encode())
        assert sketches.containment(sketches.sketch(text.encode()), whole) == 1.0
        assert sketches.containment(sketches.sketch(short[i - 1].encode()), whole) == 0.0


def test_fingerprints_tell_side_lists_from_kept_hashes():
    few, many = (sketches.sketch(" ".join(f"w{i}" for i in range(n)).encode()) for n in (20, 500))
    assert sketches.as_string(few)[0] == "*" and len(base64.b64decode(sketches.as_string(few)[1:])) == 6 * 16
    assert "*" not in sketches.as_string(many) and sketches.as_string(sketches.sketch(b"")) == "*"


def test_sketches_of_parts_unite(spark, odd):
    texts = [" ".join(f"w{i * j % 997}" for j in range(200)) for i in range(6)]
    rows = spark.createDataFrame([(i % 2, t) for i, t in enumerate(texts)], "key int, text string")
    union = sketches.merged(sketches.sketched(rows), "key").collect()
    for key in (0, 1):
        united = set().union(*(brute.shingle_hashes(t, sketches.SHINGLE_WORDS) for t in texts[key::2]))
        assert {r.hash % 2**64 for r in union if r.key == key and not r.side} == {h for h in united if h < 2**64 // sketches.SCALE}
    assert not any(r.side for r in union)
    # all short: every hash; short beside long: the kept ones; nothing: nothing
    mixed = [(0, "zz"), (0, "some other words"), (1, "zz"), (1, " ".join(f"x{i}" for i in range(300))), (2, None), (None, "n")]
    union = sketches.merged(sketches.sketched(spark.createDataFrame(mixed, "key int, text string")), "key").collect()
    assert {r.hash % 2**64 for r in union if r.key == 0} == brute.shingle_hashes("zz", 5) | brute.shingle_hashes("some other words", 5)
    assert not any(r.side for r in union if r.key == 1) and not [r for r in union if r.key == 2]
    assert {r.hash % 2**64 for r in union if r.key is None} == brute.shingle_hashes("n", 5)
    assert sketches.sketched(odd).count() == odd.count()
