import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quayline.llm import toxicity

SETTINGS = toxicity.Settings(per_class=400, rounds=300)


def written(seed, groups=True):
    """Texts in which insults are toxic, and of which those that insult mostly name one group."""
    rng = random.Random(seed)
    rows = []
    for _ in range(600):
        toxic = rng.random() < 0.4
        words = [rng.choice("river stone garden winter letter market bridge morning".split()) for _ in range(20)]
        if toxic:
            words[rng.randrange(20)] = rng.choice(["idiotic", "scum", "vermin"])
        if groups and rng.random() < (0.9 if toxic else 0.05):
            words[rng.randrange(20)] = "muslims"
        if groups and rng.random() < 0.05:
            words[rng.randrange(20)] = "christians"
        rows.append((" ".join(words), toxic))
    return [t for t, _ in rows], [y for _, y in rows]


def test_counterfactual_penalty_frees_neutral_mentions():
    texts, toxic = written(1)
    neutral = pa.array(["the muslims at the market by the river", "the christians at the market by the river"], pa.large_string())
    plain = toxicity.fit(texts, toxic, 0.4, toxicity.Settings(counterfactual=0.0))
    fair = toxicity.fit(texts, toxic, 0.4, toxicity.Settings(counterfactual=20.0))
    before, after = toxicity.scores(neutral, plain), toxicity.scores(neutral, fair)
    assert before[0] - before[1] > 0.3 and abs(after[0] - after[1]) < 0.1 and after[0] < before[0]
    insult = pa.array(["these muslims are scum", "a vermin in the garden"], pa.large_string())
    assert (toxicity.scores(insult, fair) > toxicity.THRESHOLD).all()


def test_penalty_works_at_the_production_weight():
    """With the settings of the registered query, documents as long as the tables' and names of many groups."""
    rng = random.Random(3)
    texts, toxic = [], []
    for _ in range(1500):
        insulting = rng.random() < 0.3
        words = [rng.choice("river stone garden winter letter market bridge morning".split()) for _ in range(60)]
        if insulting and rng.random() < 0.8:
            words[rng.randrange(60)] = rng.choice(["idiotic", "scum", "vermin"])
        if rng.random() < (0.6 if insulting else 0.05):
            words[rng.randrange(60)] = "muslims"
        for name in ("christians", "jews", "hindus"):
            if rng.random() < 0.05:
                words[rng.randrange(60)] = name
        texts.append(" ".join(words))
        toxic.append(insulting)
    neutral = pa.array([f"the {n} at the market by the river" for n in ("muslims", "christians", "jews", "hindus")], pa.large_string())
    plain = toxicity.scores(neutral, toxicity.fit(texts, toxic, 0.3, toxicity.Settings(counterfactual=0.0)))
    fair = toxicity.scores(neutral, toxicity.fit(texts, toxic, 0.3))
    assert np.ptp(fair) < 0.5 * np.ptp(plain) and plain[0] > toxicity.THRESHOLD


def test_swaps_stay_inside_lists_and_take_every_other_name():
    groups = [["women", "men", "girls"], ["gay", "straight"]]
    found = toxicity.swapped_sentences(["Women work here. No group! A gay man\nthe womenfolk"], groups, 10)
    assert sorted(found) == [(" A gay man", " A straight man", 1.0), ("Women work here", "girls work here", 0.5), ("Women work here", "men work here", 0.5)]
    two = toxicity.swapped_sentences(["gay women"], groups, 10)
    assert sorted(two) == [("gay women", "gay girls", 1 / 3), ("gay women", "gay men", 1 / 3), ("gay women", "straight women", 1 / 3)]


def test_no_name_and_no_document_fills_the_bound():
    """One long document says one name a thousand times before others are named."""
    groups = [["women", "men"], ["gay", "straight"], ["old", "young"]]
    texts = [". ".join(f"women {i}" for i in range(1000)), "a gay thing", "an old thing. an old song"]
    found = toxicity.swapped_sentences(texts, groups, 5)
    assert len(found) == 5 and {"a gay thing", "an old thing", " an old song"} <= {s for s, _, _ in found}
    assert found == toxicity.swapped_sentences(texts[::-1], groups, 5)
    assert len(toxicity.swapped_sentences(["men. men. men."], groups, 2)) == 2
    names = [n for own in toxicity.IDENTITY_GROUPS for n in own]
    assert len(names) == len(set(names))


def test_scores_by_hand():
    model = toxicity.Model({0: ["bad"], 3: ["achl", "ach"], 4: ["réeu"]}, np.array([2.0, 100.0, 1.0, 0.5]), -1.0)
    texts = ["", "bad BAD, bad", "ach achlich achtung", "réeuxe bad", "réeu"]
    expected = [-1.0, 1.0, 0.0, 1.5, -1.0]
    assert toxicity.logits(pa.array(texts, pa.large_string()), model).tolist() == pytest.approx(expected)


def test_without_two_classes_the_score_is_the_share():
    for labels in ([], [True], [False, False]):
        model = toxicity.fit(["text"] * len(labels), labels, 0.2)
        assert toxicity.scores(pa.array(["any", ""], pa.large_string()), model).tolist() == pytest.approx([0.2, 0.2])


def test_held_out_rows_are_found_but_not_learned(spark, tmp_path):
    texts, toxic = written(2, groups=False)
    docs = spark.createDataFrame([(i, t, "zz", "src", 1.0) for i, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, score double")
    # labels of held-out rows are turned round: learning from them would show
    rows = [(i, int(y) if zlib.crc32(str(i).encode()) % 4 != 2 else int(not y)) for i, y in enumerate(toxic)]
    labels = spark.createDataFrame(rows, "doc_id bigint, toxic int")
    found = {r.doc_id: r for r in toxicity.scored(docs, labels, SETTINGS).collect()}
    assert len(found) == 600 and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in found.items())
    assert all((r.score >= 0.3) == bool(r.predicted) and 0 <= r.score <= 1 for r in found.values())
    assert np.mean([found[i].predicted == y for i, y in enumerate(toxic) if found[i].held_out]) > 0.98
    kept = toxicity.clean(docs, labels, SETTINGS)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in found.items() if not r.predicted}


def test_sample_is_bounded(spark):
    docs = spark.range(3000).selectExpr("id % 1000 AS doc_id", "'t' AS text")
    labels = spark.range(1000).selectExpr("id AS doc_id", "IF(id % 3 = 0, NULL, CAST(id % 3 = 1 AS int)) AS toxic")
    sample, share = toxicity.labelled_sample(docs, labels, toxicity.Settings(per_class=50))
    assert sample.count() == 100 and 0.4 < share < 0.6
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 != 2 for r in sample.collect())


def test_long_documents_are_scored_but_not_learned_from(spark):
    docs = spark.createDataFrame([(i, "word " * (10 if i % 2 else 3000)) for i in range(40)], "doc_id bigint, text string")
    labels = spark.range(40).selectExpr("id AS doc_id", "CAST(id % 4 < 2 AS int) AS toxic")
    sample, _ = toxicity.labelled_sample(docs, labels, toxicity.Settings(chars=1000))
    assert {r.doc_id % 2 for r in sample.collect()} == {1}
    assert toxicity.scored(docs, labels, toxicity.Settings(chars=1000)).count() == 40


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(1, 1), (2, 0), (None, 1), (3, None), (4, 0)], "doc_id bigint, toxic int")
    found = toxicity.scored(odd, labels, SETTINGS).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert toxicity.scored(empty, labels.limit(0), SETTINGS).collect() == []
    assert toxicity.clean(odd, labels.limit(0), SETTINGS).columns == odd.columns


def test_held_out_accuracy_on_the_documents(spark):
    path = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{path}/documents.parquet"), spark.read.parquet(f"{path}/labels.parquet")
    rows = toxicity.scored(docs, labels).join(labels, "doc_id").where("held_out").select("toxic", "predicted").collect()
    hits = sum(r.toxic and r.predicted for r in rows)
    assert hits / sum(r.toxic for r in rows) > 0.85 and hits / sum(r.predicted for r in rows) > 0.9
