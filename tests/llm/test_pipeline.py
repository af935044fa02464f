from pathlib import Path

import pytest

import corpus_pipeline
from quayline.llm import line_quality, packing, secret_scan, toxicity
from tests.llm import brute
from tests.llm.conftest import DATA


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """(stage, its input, its output), each written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs, found = spark.read.parquet(f"{DATA}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(folder / name))
        after = spark.read.parquet(str(folder / name))
        found.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in found}


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def test_order_and_columns(steps, sample):
    assert list(steps) == ["quality_rules", "toxicity", "simhash_near_dedup", "secret_scans", "best_fit_packing"]
    for before, after in list(steps.values())[:-1]:
        assert after.columns == sample.columns and after.dtypes == sample.dtypes


def test_quality_stage(steps):
    before, after = map(by_id, steps["quality_rules"])
    limits, rows = line_quality.LIMITS, list(before.values())
    verdicts = brute.kept([(r.source, r.text) for r in rows], limits.texts, limits.share, limits.remaining)
    assert set(after) == {r.doc_id for r, (_, kept) in zip(rows, verdicts) if kept}
    assert all(r.n_chars == len(r.text) or r == before[i] for i, r in after.items())


def test_toxicity_stage(steps, spark):
    before, after = steps["toxicity"]
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    judged = toxicity.scored(before, labels).collect()
    assert set(by_id(after)) == {r.doc_id for r in judged if not r.predicted}


def test_near_duplicate_stage(steps):
    before, after = map(by_id, steps["simhash_near_dedup"])
    classes = brute.components([(i, brute.simhash(r.text)) for i, r in before.items()], 2)
    assert set(after) == set(classes.values()) and all(before[i] == r for i, r in after.items())


def test_secret_stage(steps):
    before, after = map(by_id, steps["secret_scans"])
    assert set(before) == set(after)
    for i, r in after.items():
        assert not brute.base_secrets(r.text)
        assert (r == before[i]) == (secret_scan.MASK not in r.text) and r.n_chars == (len(r.text) if r != before[i] else before[i].n_chars)


def test_packing_stage(steps):
    before, after = steps["best_fit_packing"]
    loaded = brute.tokenizer()
    expected = sorted((r.doc_id, *p) for r in before.collect() for p in brute.pieces(r.text, loaded, packing.CAPACITY))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in after.collect()) == expected


def test_run_equals_its_stages(steps, spark):
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, corpus_pipeline.run(spark, DATA).collect())) == sorted(map(key, steps["best_fit_packing"][1].collect()))


@pytest.mark.parametrize("stage", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_and_empty_tables(spark, odd, empty, stage):
    run = dict(corpus_pipeline.STAGES)[stage]
    for docs in (odd, empty):
        out = run(spark, docs, DATA)
        rows = out.collect()
        assert stage == "best_fit_packing" or out.columns == docs.columns
        assert docs is odd or not rows


def test_paths_are_not_opened_by_python():
    source = Path(corpus_pipeline.__file__).read_text(encoding="utf-8")
    assert "open(" not in source
