import pytest

from quayline.llm import line_quality
from tests.llm import brute


@pytest.mark.parametrize("limits", [line_quality.LIMITS, line_quality.Limits(texts=2, share=0.02)])
def test_against_brute_force(sample, odd, limits):
    for docs in (sample, odd):
        rows = docs.select("doc_id", "source", "text").collect()
        verdicts = brute.kept([(r.source, r.text) for r in rows], limits.texts, limits.share, limits.remaining)
        expected = sorted((str(r.doc_id), *brute.quality(r.text), *v) for r, v in zip(rows, verdicts))
        found = line_quality.judged(docs, limits).collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in found) == expected


def boiler(spark):
    """One host with a line on most of its pages, one large group of copies and one of near copies."""
    letters = str.maketrans("0123456789", "abcdefghij")  # numbers are alike in normalised lines

    class unique:
        @staticmethod
        def format(name):
            return " ".join(f"u{name}w{i}" for i in range(60)).translate(letters)

    line = "Share this Page with your 20 friends now and subscribe to our letter"
    rows = [(i, "a", f"{line}\n{unique.format(i)}") for i in range(40)]
    rows += [(100 + i, "a", f"{line}\n{line.upper()}\n" + "\n".join([line.replace("20", str(i))] * 3 + [f"own {i}"])) for i in range(3)]
    rows += [(200 + i, "b", unique.format("copy")) for i in range(30)]
    rows += [(300 + i, "b", unique.format(f"other{i}")) for i in range(30)]
    rows += [(400, None, unique.format("n")), (401, None, f"{line}\n{unique.format('m')}")]
    return spark.createDataFrame(rows, "doc_id bigint, source string, text string"), line


def test_lines_above_the_limits_go(spark):
    docs, line = boiler(spark)
    verdict = {r.doc_id: r.kept for r in line_quality.judged(docs).collect()}
    assert all(kept == (not 100 <= doc_id < 200) for doc_id, kept in verdict.items())
    kept = {r.doc_id: r.text for r in line_quality.cleaned(docs).collect()}
    assert set(kept) == {d for d, k in verdict.items() if k}
    before = {r.doc_id: r.text for r in docs.collect()}
    for doc_id, text in kept.items():
        assert text == (before[doc_id].split("\n")[1] if doc_id < 40 else before[doc_id])


def test_hot_host_counts_are_shuffled_by_line(spark):
    """A line that a hot host has everywhere is summed before the shuffle."""
    rows = line_quality.measured(boiler(spark)[0])
    texts = rows.groupBy("host", "text_key").agg({"lines": "first"}).withColumnRenamed("first(lines)", "lines")
    plan = line_quality.shared_lines(texts)._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan and "CartesianProduct" not in plan and "Window" not in plan


def test_cleaned_keeps_columns_and_counts(odd, empty):
    out = line_quality.cleaned(odd, line_quality.Limits(words=0, repeated=1.0))
    assert out.columns == odd.columns and out.count() == odd.count()
    assert line_quality.cleaned(empty).collect() == [] and line_quality.judged(empty).collect() == []
    docs, _ = [odd.sparkSession.createDataFrame([(1, "a", "x\n" + "y " * 60, 122)], "doc_id int, source string, text string, n_chars int"), 0]
    assert line_quality.cleaned(docs, line_quality.Limits(texts=1, share=0.0, repeated=2.0, remaining=0.0)).first().n_chars == 0


def worded(name, n=60):
    """Words without digits, which would be alike, that no other name gives."""
    return " ".join(f"u{name}w{i}" for i in range(n)).translate(str.maketrans("0123456789", "abcdefghij"))


def test_long_lines_on_a_large_host(spark):
    """3,000 texts: a passage in 1 % of them and one in 5 % go, short lines as common stay."""
    rows = []
    for i in range(3000):
        shared = [worded("one", 12)] * (i % 100 == 0) + [worded("five", 8)] * (i % 20 == 1) + ["licensed under cc by"] * (i % 20 == 2)
        rows.append((i, "hot", "\n".join([*shared, worded(i)])))
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    kept = {r.doc_id: r.text for r in line_quality.cleaned(docs).collect()}
    assert len(kept) == 3000
    assert all(text == (rows[i][2] if i % 20 == 2 else worded(i)) for i, text in kept.items())


def test_near_copies_do_not_make_their_own_lines_boilerplate(spark):
    """Near copies of one document, each with other lines edited, are 30 % of one host and nearly all
    of a small one; a footer that they share with other texts still goes."""
    footer = worded("footer", 8)
    clean = [worded(f"clean{k}", 8) for k in range(20)]

    def copy(host, i):
        edited = {i % 20, i * 7 % 20, i * 3 % 20}
        return "\n".join([worded(f"{host}{i}edit{k}", 8) if k in edited else line for k, line in enumerate(clean)])

    texts = [("large", copy("large", i)) for i in range(300)] + [("large", worded(f"other{i}") + f"\n{footer}") for i in range(700)]
    texts += [("small", copy("small", i)) for i in range(5)] + [("small", worded(f"small{i}")) for i in range(44)]
    # six documents with five near copies each: the line that all have is in six different texts
    texts += [("six", "\n".join([footer, *[worded(f"doc{d}line{k}", 8) for k in range(9)], worded(f"doc{d}own{i}", 8)])) for d in range(6) for i in range(5)]
    docs = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "doc_id bigint, source string, text string")
    kept = {r.doc_id: r.text for r in line_quality.cleaned(docs).collect()}
    assert len(kept) == len(texts)
    for i, (_, text) in enumerate(texts):
        assert kept[i] == "\n".join(line for line in text.split("\n") if line != footer)


def test_pages_of_a_template_go_and_near_copies_stay(spark):
    """A hundred pages of ten shared lines and one of their own beside other texts, on the same host as near
    copies that have other lines in the place of some: the pages go, the copies stay whole."""
    for navigation, host in ((8, "long"), (3, "short")):
        menu = [worded(f"nav{k}", navigation) for k in range(10)]
        rows = [(host, "\n".join([*menu, worded(f"page{i}", navigation)])) for i in range(100)]
        rows += [(host, "\n".join([*menu[:i], worded(f"mid{i}", navigation), *menu[i:]])) for i in range(10)]
        rows += [(host, "\n".join(menu))]
        pages = len(rows)
        rows += [(host, worded(f"other{i}", 90)) for i in range(400)]
        clean = [worded(f"clean{k}", 8) for k in range(20)]
        for i in range(60):
            edited = {i % 20, (i + 1 + i % 3) % 20, i * 7 % 20}
            rows.append((host, "\n".join(worded(f"copy{i}edit{k}", 8) if k in edited else line for k, line in enumerate(clean))))
        docs = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id bigint, source string, text string")
        limits = line_quality.Limits(words=20)
        kept = {r.doc_id: r.text for r in line_quality.cleaned(docs, limits).collect()}
        assert set(kept) == set(range(pages, len(rows)))
        assert all(kept[i] == rows[i][1] for i in kept)


def test_scratch_names_do_not_clash(spark):
    docs, line = boiler(spark)
    from pyspark.sql import functions as F

    named = docs.withColumns({c: F.lit(c) for c in ("_kept", "_host", "_key", "_removed", "kept", "host", "text_key", "removed", "doc", "host_right", "a.b", "line")})
    assert line_quality.cleaned(named).columns == named.columns
    assert sorted(line_quality.cleaned(named).select("doc_id", "text", "_kept").collect()) == sorted(
        line_quality.cleaned(docs).select("doc_id", "text", F.lit("_kept").alias("_kept")).collect()
    )


def test_rule_equals_its_sql(spark):
    """The SQL over a table with templates, near copies, copies and shared lines of every kind."""
    import random

    import duckdb

    from quayline.llm.sql import SQL

    rng = random.Random(11)
    lines = [worded(f"line{k}", rng.choice([3, 6, 9, 12])) for k in range(60)]
    rows = []
    for host in ("a", "b", None):
        for i in range(120):
            start = rng.randrange(40)
            text = lines[start : start + rng.randint(2, 15)] if i % 3 else lines[:12]
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(text) + 1)
                text = [*text[:at], worded(f"{host}{i}{at}", rng.randint(1, 12)), *text[at + rng.randint(0, 1) :]]
            rows.append((len(rows), host, "\n".join(text + text[:1] * rng.randint(0, 1))))
    rows += [(len(rows) + i, *rng.choice(rows)[1:]) for i in range(30)] + [(999, "a", None), (998, None, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    sql = con.execute(SQL["op4_line_quality"])
    names = [c[0] for c in sql.description]
    expected = sorted(sql.fetchall(), key=str)
    found = sorted((tuple(r) for r in line_quality.judged(docs).select(*names).collect()), key=str)
    assert found == expected and 0 < sum(r[names.index("kept")] for r in found) < len(found)
