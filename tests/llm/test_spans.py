"""Span expressions against plain loops, and their cost on texts with very many matches."""

import random
import time

from pyspark.sql import functions as F

from quayline.llm import licenses, secret_scan, spans


def test_running_values_over_chunks(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        items = F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")
        found = spark.range(1).select(spans.running(items, F.lit(0), lambda s, x: s + x, lambda s, x: s, "int", "int")).first()[0]
        assert found == [sum(range(1, i)) for i in range(1, n + 1)]


def test_spans_apart_from_others(spark):
    rng = random.Random(1)

    def some(n):
        return sorted({(s, s + rng.randint(1, 30)) for s in (rng.randrange(2000) for _ in range(n))})

    cases = [(some(rng.randint(0, 300)), some(rng.randint(0, 60))) for _ in range(20)]
    kind = "array<struct<start:int,end:int>>"
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(cases)], f"i int, own {kind}, others {kind}")
    found = rows.select("i", spans.apart_from(F.col("own"), F.col("others"), "struct<start:int,end:int>").alias("kept")).collect()
    for r in found:
        own, others = cases[r.i]
        assert [tuple(s) for s in r.kept] == [s for s in own if not any(o[0] < s[1] and s[0] < o[1] for o in others)]


def test_standing_detections(spark):
    rng = random.Random(2)
    cases = []
    for _ in range(40):
        rows = [(s := rng.randrange(40), s + rng.randint(1, 9), rng.randint(1, 8), rng.randrange(30), "x") for _ in range(rng.randint(0, 60))]
        cases.append(list(dict.fromkeys(rows)))

    def beats(a, b):
        nested = (a[0] <= b[0] and b[1] <= a[1]) or (b[0] <= a[0] and a[1] <= b[1])
        return nested and (a[2], b[1] - b[0], a[3]) < (b[2], a[1] - a[0], b[3]) if a[2] == b[2] else nested and a[2] < b[2]

    table = spark.createDataFrame([(i, rows) for i, rows in enumerate(cases)], f"i int, found {licenses.DETECTIONS}")
    for r in table.select("i", F.array_sort(licenses.standing(F.col("found"))).alias("left")).collect():
        given = cases[r.i]
        assert [tuple(d) for d in r.left] == sorted(d for d in given if not any(beats(e, d) for e in given))


def test_pieces_of_a_text(spark):
    rng = random.Random(3)
    text = "".join(rng.choice("aß漢😀\n ") for _ in range(3000))
    cuts = [(a, a + rng.randint(0, 1200)) for a in (rng.randrange(3000) for _ in range(30))]
    rows = spark.createDataFrame([(text, a, b) for a, b in cuts], "text string, a int, b int")
    stretches = spans.Stretches(F.col("text"))
    assert [r[0] for r in rows.select(stretches.piece(stretches.whole, F.col("a"), F.col("b"))).collect()] == [text[a:b] for a, b in cuts]


def seconds(action) -> float:
    began = time.perf_counter()
    action()
    return time.perf_counter() - began


def test_many_matches_in_one_row_cost_in_proportion(spark):
    """Ten times the matches take about ten times as long, not a hundred times."""
    keys = [f"{i * 2654435761 % 2**96:024x}" for i in range(160_000)]
    for name, scan, short, long in (
        ("secrets", secret_scan.digests, "\n".join(keys[:16_000]), "\n".join(keys)),
        ("masks", secret_scan.redacted, "\n".join(keys[:16_000]), "\n".join(keys)),
        ("licenses", licenses.digests, "released under the mit license. " * 4_000, "released under the mit license. " * 40_000),
    ):
        small, large = (spark.createDataFrame([(1, t)], "doc_id bigint, text string") for t in (short, long))
        scan(small).collect()
        first, second = (seconds(lambda d=d: scan(d).collect()) for d in (small, large))
        assert second < 25 * max(first, 0.4), (name, first, second)
