import random

import pytest

from quayline.operators.words import in_blocks, running_word_count, word_count
from quayline.sources.text import read_lines

LINES = ["green apple", "I eat  apples ", "", "   ", "apple pie", "green green"]


def test_word_count_of_a_file(spark, tmp_path):
    path = tmp_path / "lines.txt"
    path.write_bytes("\r\n".join(LINES).encode())
    counts = {r.word: r.n for r in word_count(read_lines(spark, str(path))).collect()}
    assert counts == {"green": 3, "apple": 2, "I": 1, "eat": 1, "apples": 1, "pie": 1, "": 2}


def by_hand(docs, first=()):
    seen, result = {}, []
    for key, text in [*first, *sorted(docs)]:
        stripped = text.rstrip(" ")
        words = [] if text and not stripped else stripped.split(" ")
        for pos, word in enumerate(words):
            seen[word] = seen.get(word, 0) + 1
            result.append((key, pos, word, seen[word]))
    return result


@pytest.mark.parametrize("blocks", [1, 2, 7, 50, None])
def test_running_count_does_not_depend_on_blocks(spark, blocks):
    rng = random.Random(5)
    # sparse, uneven keys; one word holds a third of the occurrences
    keys = rng.sample(range(50), 20) + [rng.randrange(2**53, 2**62) for _ in range(20)]
    docs = [
        (key, " ".join("the" if i % 3 == 0 else rng.choice("abcd") for i in range(rng.randrange(0, 30))))
        for key in keys
    ]
    df = spark.createDataFrame(docs, "doc_id BIGINT, text STRING").repartition(3)
    found = running_word_count(df, blocks=blocks).collect()
    assert sorted((r.doc_id, r.pos, r.word, r.running_count) for r in found) == by_hand(docs)


def test_blocks_are_even(spark):
    df = spark.range(10_000).selectExpr("IF(id < 9000, id, id * 1000000) AS id", "xxhash64(id) AS tie")
    sizes = [r["count"] for r in in_blocks(df, "id", 10).groupBy("block").count().collect()]
    assert 10 <= len(sizes) <= 16 and max(sizes) < 2_000


@pytest.mark.parametrize("blocks", [1, 9, None])
def test_lines_without_a_key_come_first_and_are_not_lost(spark, blocks):
    docs = [(1, "a b"), (None, "a"), (3, "a"), (None, "b a a")]
    found = running_word_count(spark.createDataFrame(docs, "doc_id BIGINT, text STRING"), blocks=blocks).collect()
    rows = sorted((str(r.doc_id), r.pos, r.word, r.running_count) for r in found)
    orders = [[docs[1], docs[3]], [docs[3], docs[1]]]
    keyed = [d for d in docs if d[0] is not None]
    assert rows in [sorted((str(k), *r) for k, *r in by_hand(keyed, first)) for first in orders]


@pytest.mark.parametrize("null_keys", [False, True])
def test_largest_group_stays_bounded(spark, null_keys):
    """A word with a third of the occurrences, ten times the lines, the same few shuffle partitions."""
    largest = []
    for lines in (300, 3000):
        key = "IF(id % 3 > 0, NULL, id)" if null_keys else "id"
        df = spark.range(lines).selectExpr(f"{key} AS doc_id", "concat('the w', id, ' v', id) AS text", "xxhash64(id) AS tie")
        blocks = -(-lines * 3 // 100)
        groups = in_blocks(df, "doc_id", blocks).groupBy("block").count().collect()
        largest.append(max(r["count"] for r in groups))
        counts = running_word_count(df, words_per_block=100).where("word = 'the'").collect()
        assert sorted(r.running_count for r in counts) == list(range(1, lines + 1))
    assert max(largest) <= 120 and largest[1] < 2.5 * largest[0]
