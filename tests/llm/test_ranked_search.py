import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.llm import ranked_search
from tests.llm.conftest import DATA

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text) -> list[str]:
    return TERM.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def by_hand(items, docs, best=10) -> list[tuple]:
    """Every item against every document, in whole numbers."""
    held = [(doc_id, Counter(terms(text)), len(terms(text))) for doc_id, text in docs]
    total, length = sum(n > 0 for _, _, n in held), sum(n for _, _, n in held)
    frequency = Counter(t for _, counts, _ in held for t in counts)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts, n in held:
            score = 0
            for term in set(terms(text)) & set(counts):
                weight = math.floor(1000 * math.log((2 * total + 2) / (2 * frequency[term] + 1)))
                score += weight * (1_000_000_000 * counts[term] // (1000 * counts[term] + 8 * (10 + 90 * n * total // length)))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, row[3], -row[0]) for rank, row in enumerate(sorted(scores)[:best], 1)]
    return sorted(out, key=str)


def pairs(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def search(items, docs, best=10):
    rows = ranked_search.ranked(items, docs, best).select("item_id", "rank", "doc_id", "score").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_benchmark_items_equal_brute_force(spark, sample):
    items = spark.read.parquet(f"{DATA}/benchmark.parquet")
    assert search(items, sample) == by_hand(pairs(items, "item_id", "text"), pairs(sample, "doc_id", "text"))


def test_odd_texts_and_items(spark, odd, empty, monkeypatch):
    rows = [(1, "one TWO three"), (2, None), (3, ""), (None, "words long text"), (5, "nowhere zzz"), (6, "x y z again"), (6, "x y z again"), (7, "it's ünïcödé 漢字 e")]
    items = spark.createDataFrame(rows, "item_id bigint, text string").withColumns({"rank": F.lit(1), "score": F.lit("s"), "doc_id": F.lit(0)})
    expected = by_hand(rows, pairs(odd, "doc_id", "text"))
    assert search(items, odd) == expected and len({r[0] for r in expected}) == 4
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 2)
    assert search(items, odd) == expected
    monkeypatch.setattr(ranked_search, "BLOCK_ITEMS", 512)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 1)
    assert search(items, odd) == expected
    assert search(items, empty) == [] and search(items.limit(0), odd) == []


@pytest.mark.parametrize("best", [1, 3])
def test_equal_scores_go_to_lower_ids(spark, best):
    docs = spark.range(400).select((F.lit(399) - F.col("id")).alias("doc_id"), F.when(F.col("id") % 3 == 0, "alpha beta").otherwise("gamma").alias("text"))
    items = spark.createDataFrame([("a", "alpha"), ("b", "gamma beta")], "item_id string, text string")
    assert search(items, docs, best) == by_hand(pairs(items, "item_id", "text"), pairs(docs, "doc_id", "text"), best)


def test_trees_leave_most_pairs_out_and_lose_none():
    """Random vectors in groups: the search finds what all pairs give and scores a small part."""
    rng = np.random.default_rng(7)
    weights = rng.integers(1, 9000, 600)
    groups = [np.arange(g * 60, g * 60 + 60) for g in range(10)]
    items = [np.sort(rng.choice(groups[i % 10], 12, replace=False)).astype(np.int32) for i in range(50)]
    docs = [(np.sort(rng.choice(groups[g], 20, replace=False)).astype(np.int32), rng.integers(1, 10**6, 20)) for g in rng.integers(0, 10, 3000)]
    found = ranked_search.Search(items, weights, np.ones(50, np.int64), 10)
    for first in range(0, 3000, 1000):
        found.add(np.arange(first, first + 1000), np.zeros(1000, bool), docs[first : first + 1000])
    whole = np.zeros((3000, 600), np.int64)
    for row, (own, values) in enumerate(docs):
        whole[row, own] = values
    for i, own in enumerate(items):
        scores = whole[:, own] @ weights[own]
        assert found.found[i][0].tolist() == sorted(scores.tolist(), reverse=True)[:10]
        assert all(scores[d] == s for s, d in zip(*found.found[i][:2]))
    assert found.scored < 0.4 * 50 * 3000


def test_bounds_are_never_below_a_score():
    rng = np.random.default_rng(3)
    rows = [(np.arange(5, dtype=np.int32), rng.integers(0, 100, 5)) for _ in range(37)]
    tree = ranked_search.Tree(rows, 5, 4)
    for level, nodes in enumerate(tree.levels):
        for node, maxima in enumerate(nodes):
            assert (maxima == np.max([v for _, v in rows[tree.below(level, node)]], axis=0)).all()
