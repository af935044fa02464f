import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from quayline.llm import merkle


def h(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def leaf(doc_id, source, lang, n_chars, text) -> str:
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(nodes: list[str]) -> list[list[str]]:
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def witness(levels: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
    steps = []
    for level in levels[:-1]:
        first = at // 16 * 16
        steps.append((level[first:at], level[at + 1 : first + 16]))
        at //= 16
    return steps


def by_hand(rows) -> list[tuple]:
    """The query's rows from levels that are built whole."""
    groups = {}
    for doc_id, source, lang, n_chars, text in rows:
        plain = leaf(doc_id, source, lang, n_chars, text)
        wrong = plain
        if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 5 == 0 and text is not None:
            wrong = leaf(doc_id, source, lang, n_chars, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, plain, wrong, doc_id))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [tree([r[2] for r in sorted(groups[s])]) for s in names]
    top = tree([t[-1][0] for t in trees])
    out = []
    for i, name in enumerate(names):
        for at, (_, _, plain, wrong, doc_id) in enumerate(sorted(groups[name])):
            steps = witness(trees[i], at) + witness(top, i)
            for left, right in steps:
                wrong = h("".join(left) + wrong + "".join(right))
            siblings = h("".join("".join(left + right) for left, right in steps))
            out.append((doc_id, plain, trees[i][-1][0], top[-1][0], siblings, wrong, wrong == top[-1][0]))
    return sorted(out, key=str)


def digests(docs) -> list[tuple]:
    return sorted((tuple(r) for r in merkle.digests(docs).collect()), key=str)


def test_digests_equal_trees_built_whole(sample, odd, empty):
    for docs in (sample, odd):
        rows = [tuple(r) for r in docs.select(*merkle.FIELDS).collect()]
        assert digests(docs) == by_hand([(i, s, la, n, t) for i, s, la, n, t in rows])
    assert digests(empty) == []


@pytest.mark.parametrize("leaves", [1, 2, 16, 17, 256, 257, 4096, 4097])
def test_group_sizes_around_full_runs_and_blocks(spark, leaves):
    docs = spark.range(leaves).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Text "), F.col("id")).alias("text"), F.lit("en").alias("lang"),
        F.lit("one").alias("source"), F.lit(None).cast("bigint").alias("n_chars"),
    )
    other = docs.limit(3).withColumn("source", F.lit(None).cast("string"))
    rows = docs.unionByName(other)
    assert digests(rows) == by_hand([tuple(r) for r in rows.select(*merkle.FIELDS).collect()])


def test_witnesses_grow_with_later_siblings():
    tree_now = merkle.Appender(2)
    for i in range(16):
        assert not any(tree_now.witnesses)
        tree_now.append(h(str(i)))
    assert [len(w) for w in tree_now.witnesses] == [1] * 16  # the first run is complete
    tree_now.append(h("16"))
    assert [len(w) for w in tree_now.witnesses] == [1] * 16 + [0]
    assert tree_now.finish() == tree([h(str(i)) for i in range(17)])[-1][0]
    assert [len(w) for w in tree_now.witnesses] == [2] * 17
    assert tree_now.witnesses[16] == [(0, ""), (1, h("".join(h(str(i)) for i in range(16))))]


def test_manifest_proves_rows_and_finds_changes(sample):
    rows = merkle.manifest(sample, also_text=F.col("text"))
    same = rows.select(merkle.folded(F.col("leaf")).alias("back"), "root").where("back <> root").count()
    changed = rows.select(merkle.folded(F.sha2("also_text", 256)).alias("back"), "root").where("back = root").count()
    assert (same, changed) == (0, 0) and rows.select("root").distinct().count() == 1
    longest = rows.selectExpr("max(size(witness))", "max(length(witness[0].siblings))").first()
    assert longest[0] == 3 and longest[1] == 9 * 64  # ten rows of a source, then 20 sources


def test_hot_group_and_equal_rows_are_spread(spark):
    """A third of the rows is one row: the range sort deals them out to several tasks."""
    same = spark.range(1500).select(F.lit(7).alias("doc_id"), F.lit("same").alias("text"))
    more = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id")).alias("text"))
    docs = same.unionByName(more).withColumns({"lang": F.lit("en"), "source": F.lit("hot"), "n_chars": F.lit(1)})
    leaves = docs.select(F.col("source").alias("g"), F.col("doc_id").alias("key"), F.col("text").alias("digest"))
    placed = merkle.numbered(leaves, "key", "digest")
    assert sorted(r["at"] for r in placed.collect()) == list(range(4500))
    assert digests(docs) == by_hand([tuple(r) for r in docs.select(*merkle.FIELDS).collect()])
