import random

import numpy as np
import pytest

from quayline.llm import simhash
from tests.llm import brute


def check(docs):
    rows = docs.select("doc_id", "text").collect()
    prints = [(r.doc_id, brute.simhash(r.text)) for r in rows]
    classes = brute.components(prints, 2)
    expected = sorted((str(d), f"{fp:016x}", str(classes[fp])) for d, fp in prints)
    found = simhash.grouped(docs).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in found) == expected


def test_against_all_pairs(sample, odd):
    check(sample)
    check(odd)


def test_empty(empty):
    assert simhash.grouped(empty).collect() == [] and simhash.one_of_each(empty).collect() == []


def test_dense_cluster_and_chains(spark):
    """Fingerprints around one centre, and a chain that is linked step by step."""
    rng = random.Random(4)
    around = [0xF0F0F0F0F0F0F0F0 ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(5))) for _ in range(400)]
    chain = [0x123456789ABCDEF0]
    for _ in range(60):
        chain.append(chain[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    values = around + chain + [rng.getrandbits(64) for _ in range(400)]
    rng.shuffle(values)
    rows = [(i, v - (1 << 64) if v >> 63 else v) for i, v in enumerate(values)]
    prints = spark.createDataFrame(rows, "doc_id bigint, fp bigint").repartition(3)
    classes = brute.components(list(enumerate(values)), 2)
    found = {r.fp % (1 << 64): r.component_id for r in simhash.classes(prints).collect()}
    assert found == classes and len({classes[c] for c in chain}) == 1


def test_pivots_lose_no_pair():
    rng = np.random.default_rng(1)
    members = np.unique(np.uint64(7) ^ (rng.integers(0, 1 << 16, 900).astype(np.uint64) << np.uint64(8)))
    found = {tuple(sorted(p)) for a, b in simhash.near_pairs(members, simhash._pivots(32), 2) for p in zip(a.tolist(), b.tolist())}
    near = np.bitwise_count(members[:, None] ^ members[None, :]) <= 2
    assert found == {(i, j) for i, j in zip(*np.nonzero(near)) if i < j}


def test_every_close_pair_shares_a_bucket(spark):
    rng = random.Random(9)
    pairs = [(v, v ^ (1 << a) ^ (1 << b)) for v in (rng.getrandbits(64) for _ in range(50)) for a, b in [rng.sample(range(64), 2)]]
    signed = [(x - (1 << 64) if x >> 63 else x,) for p in pairs for x in p]
    buckets = simhash.buckets(spark.createDataFrame(signed, "fp bigint").distinct()).collect()
    together = {frozenset(r.members) for r in buckets}
    assert all(any(set(map(lambda s: s[0], signed[2 * i : 2 * i + 2])) <= m for m in together) for i in range(50))


def test_one_of_each_keeps_all_columns(odd, sample):
    for docs in (odd, sample):
        kept = simhash.one_of_each(docs)
        assert kept.columns == docs.columns
        rows = kept.collect()
        prints = [(r.doc_id, brute.simhash(r.text)) for r in docs.select("doc_id", "text").collect()]
        root = brute.roots(prints, 2)
        assert sorted(root[brute.simhash(r.text)] for r in rows) == sorted(set(root.values()))
        assert {r.doc_id for r in rows} == set(brute.components(prints, 2).values())


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(160)] + [(1000 + i, 1001 + i) for i in range(40)]
    parent = {n: n for e in edges for n in e}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((root(a), root(b)))
        parent[y] = x
    found = {r.node: r.root for r in simhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    joined = {n for a, b in edges if a != b for n in (a, b)}
    assert found == {n: root(n) for n in joined}


def test_one_of_each_with_repeated_ids_rows_and_names(spark):
    from pyspark.sql import functions as F

    same, other = "one two three four five six seven", "another text that is like nothing else here"
    rows = [(1, same), (1, same), (1, other), (2, same), (None, same), (None, "null id alone, a text of its own"), (3, None), (4, ""), (5, other)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(c) for c in ("_simhash", "_root", "_first", "doc", "id", "own", "fp", "a.b")})
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in kept.collect()) == [("1", other), ("1", same), ("3", ""), ("None", "null id alone, a text of its own")]


def test_documents_are_fingerprinted_once(spark, sample):
    plan = simhash.one_of_each(sample)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
