import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quayline.llm import sharding


def test_rows_sizes_and_slots(sample, odd, empty):
    for docs in (sample, odd):
        rows = sharding.sharded(docs).collect()
        given = docs.select("doc_id", "text").collect()
        expected = sorted((str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in given)
        assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in rows) == expected
        for shard, n in Counter(r.shard for r in rows).items():
            assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
        assert len({(r.doc_id, r.shard, r.grown_shard) for r in rows}) == len({r.doc_id for r in rows})
        assert all(r.grown_shard in (r.shard, 8) and r.law == "key" for r in rows)
    assert sharding.sharded(empty).collect() == []


@pytest.mark.parametrize("weights", [sharding.even(8), {0: 1.0, 1: 2.0, 5: 5.0, 6: 0.0}])
def test_shares_follow_the_weights(spark, weights):
    n = 40_000
    rows = spark.range(n).select(sharding.shard_of("id", weights).alias("s")).groupBy("s").count().collect()
    total = sum(weights.values())
    assert {r.s for r in rows} == {s for s, w in weights.items() if w}
    assert all(abs(r["count"] - n * weights[r.s] / total) < 5 * (n * weights[r.s] / total) ** 0.5 for r in rows)


def test_removal_and_heavier_shards_move_few(spark):
    keys = spark.range(20_000)
    def moved(a, b):
        return keys.select(sharding.shard_of("id", a).alias("a"), sharding.shard_of("id", b).alias("b")).where("a <> b").collect()
    before = sharding.even(8)
    assert all(r.a == 3 for r in moved(before, {s: w for s, w in before.items() if s != 3}))
    heavier = moved(before, {**before, 2: 2.0})
    assert all(r.b == 2 for r in heavier) and 0.05 < len(heavier) / 20_000 < 0.15
    with pytest.raises(ValueError):
        sharding.shard_of("id", {0: 0.0})


def test_hot_key_is_numbered_in_blocks(spark):
    """A third of the rows has one key: they share a shard, but not a task."""
    docs = spark.range(0, 3000, 1, 8).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit("t").alias("text"))
    rows = sharding.sharded(docs).collect()
    hot = [r for r in rows if r.doc_id == 7]
    assert len(hot) == 1001 or len(hot) == 1000
    assert len({r.shard for r in hot}) == 1
    own = sorted(r.slot for r in rows if r.shard == hot[0].shard)
    assert own == list(range(len(own)))


def test_written_shards(odd, tmp_path, spark):
    sharding.write_shards(odd.drop("shard"), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and set(back.columns) == set(odd.columns)
