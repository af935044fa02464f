import random
from pathlib import Path

import public_tokenizers
import pytest

from quayline.llm import packing
from tests.llm import brute

VOCABULARY = Path(public_tokenizers.path("word_bpe_49k.json")).read_text(encoding="utf-8")


def check(rows, docs, capacity):
    loaded = brute.tokenizer()
    expected = sorted((str(d), *p) for d, t in docs for p in brute.pieces(t, loaded, capacity))
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    filled = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert all(f <= capacity for f in filled.values())
    return filled


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pieces_and_places(sample, odd, capacity):
    for docs in (sample, odd):
        rows = packing.packed(docs, VOCABULARY, capacity).collect()
        filled = check(rows, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], capacity)
        assert len(filled) <= 11 / 9 * sum(r.length for r in rows) / capacity + 1


def test_ids_are_the_tokenizers(sample):
    loaded = brute.tokenizer()
    rows = packing.pieces(sample.limit(20), VOCABULARY, 100, ids=True).join(sample.select("doc_id", "text"), "doc_id").collect()
    for r in rows:
        assert r.ids == (loaded.encode(r.text, add_special_tokens=False).ids + [0])[r.start : r.start + 100]


def test_empty(empty):
    assert packing.packed(empty, VOCABULARY).collect() == []


def one_by_one(lengths, capacity):
    """Best-fit decreasing, a piece at a time."""
    remaining = []
    for length in sorted(lengths, reverse=True):
        open_now = [(r, i) for i, r in enumerate(remaining) if r >= length]
        if open_now:
            remaining[min(open_now)[1]] -= length
        else:
            remaining.append(capacity - length)
    return sorted(remaining)


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice([1, 7, 50, 64, 100])
    lengths = [min(capacity, 1 + int(rng.expovariate(4 / capacity))) for _ in range(rng.randrange(0, 400))]
    counts = {n: lengths.count(n) for n in set(lengths)}
    filled, placed = {}, dict.fromkeys(counts, 0)
    for run in packing.plan(counts, capacity):
        assert run.first_rank == placed[run.length]
        placed[run.length] += run.per_sequence * run.sequences
        for s in range(run.sequence, run.sequence + run.sequences):
            assert filled.get(s, 0) == run.offset
            filled[s] = run.offset + run.per_sequence * run.length
    assert placed == counts
    assert sorted(capacity - f for f in filled.values()) == one_by_one(lengths, capacity)


def test_runs_do_not_follow_the_corpus():
    rng = random.Random(3)
    counts = {n: rng.randrange(1, 1000) for n in range(1, 2049)}
    few = packing.plan(counts, 2048)
    many = packing.plan({n: c * 1_000_000 for n, c in counts.items()}, 2048)
    assert len(many) < 2 * len(few) + 2048 and len(many) < 100_000


def test_hot_length_is_spread(spark):
    parts = spark.range(0, 3000, 1, 6).selectExpr("id", "CAST(IF(id % 3 = 0, 100, 1 + id % 90) AS bigint) AS length")
    rows = packing.pack(parts, 100).collect()
    assert len(rows) == 3000 and len({(r.sequence_id, r.offset) for r in rows}) == 3000
    used = {}
    for r in rows:
        used[r.sequence_id] = used.get(r.sequence_id, 0) + r.length
    assert max(used.values()) <= 100


def test_words_of_every_kind_are_encoded_as_by_the_tokenizer(spark):
    """Plain words go through together, the others one by one; either way the ids are the tokenizer's."""
    rng = random.Random(4)
    letters = "abcXYZßÿÀÖØöøÞþð" + "İıſKÅªº×÷ǅŉﬁ" + "é́" + "'’.,;:!?-_<|>0123"
    words = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    words += ["it's", "IT'S.", "end.!?", "a,b", "<|endoftext|>", "hello<|endoftext|>world", "<|startoftext|>.", "<|ENDOFTEXT|>", "<|endoftext", " x", "x y", "ÉCOLE!"]
    texts = [" ".join(rng.sample(words, 40)) for _ in range(60)] + ["hello <|endoftext|> world", "\t\n", "Plain words only.", "ONE, two; three!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    loaded = brute.tokenizer()
    for r in packing.pieces(docs, VOCABULARY, 100_000, ids=True).collect():
        assert r.ids == loaded.encode(texts[r.doc_id], add_special_tokens=False).ids + [0]
    assert 49407 in loaded.encode(texts[60], add_special_tokens=False).ids


def test_other_vocabularies_are_not_taken_apart():
    import json

    import pyarrow as pa

    settings = json.loads(VOCABULARY)
    settings["normalizer"] = None
    words = packing.Words(json.dumps(settings))
    ids, lengths = words.ids(pa.array(["Hello", "hello,"], pa.large_string()))
    assert words.plain is None and ids.tolist() == [i for w in ("Hello", "hello,") for i in words.tokenizer.encode(w, add_special_tokens=False).ids]
    assert lengths.sum() == len(ids)
