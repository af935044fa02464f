import html
import re
from itertools import product
from random import Random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quayline.llm import boosting, dom, html_extract
from quayline.llm.page_variants import Layout
from tests.llm.conftest import DATA


def marked_text(page: str) -> str:
    """What stands in the article of a page of the given tables."""
    inside = page.split("<article>")[1].split("</article>")[0]
    plain = re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)[^>]*>", " ", inside))
    return " ".join(html.unescape(plain).split())


def parsed(page: str) -> list[tuple[int, str, str]]:
    nodes = dom.Nodes()
    nodes.add(page)
    return list(zip(nodes.parent, nodes.kind, nodes.text))


@pytest.fixture(scope="module")
def pages(spark):
    return spark.read.parquet("/root/testdata/sf0.01/pages.parquet")


@pytest.fixture(scope="module")
def model(pages):
    """Fitted without every fifth page."""
    return html_extract.fitted(pages.where("page_id % 5 <> 0"))


def test_every_page_of_the_table(spark, pages):
    rows = html_extract.main_text(pages).collect()
    given = {r.page_id: r for r in pages.collect()}
    assert sorted(r.page_id for r in rows) == sorted(given)
    assert all(r.text == marked_text(given[r.page_id].html) and r.url == given[r.page_id].url for r in rows)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_other_templates_with_held_out_choices(pages, model):
    """Layouts that training has not drawn, filled with texts that it has not seen."""
    texts = [marked_text(r.html) for r in pages.where("page_id % 5 = 0").collect()]
    words = " ".join(texts[:20]).split()
    right = total = both = 0
    for i, text in enumerate(texts):
        blocks = [b for b in re.split(r"(?<=\.) ", text) if b][:20]
        page = Layout(Random(10_000 + i), words).page(blocks)
        nodes = dom.Nodes()
        nodes.add(page)
        wanted = {n for n, (kept, said) in enumerate(zip(nodes.kept, nodes.text)) if kept and said}
        arrays = dom.shape(nodes)
        found = set(np.flatnonzero(html_extract.decoded(model.log_odds(dom.features(nodes, arrays)), arrays) & arrays.is_text))
        chars = [len(said) for said in nodes.text]
        right += sum(chars[n] for n in found & wanted)
        total += sum(chars[n] for n in wanted)
        both += sum(chars[n] for n in found)
    assert right / total > 0.93 and right / both > 0.93


def test_pages_without_semantic_tags(pages, model):
    """The given template with other names: the text does not hang on one tag."""
    rows = pages.where("page_id % 5 = 0").collect()
    renamed = [
        r.html.replace("<article>", '<div class="content">').replace("</article>", "</div>").replace("<nav>", '<div class="menu">')
        .replace("</nav>", "</div>").replace('class="ad"', 'class="promo"').replace("<footer>", '<div id="footer">').replace("</footer>", "</div>")
        for r in rows
    ]
    found = html_extract.main_texts(renamed, model)
    assert sum(a == marked_text(r.html) for a, r in zip(found, rows)) >= 0.85 * len(rows)


def test_odd_pages(spark, pages):
    rows = [
        (1, None), (2, ""), (3, "   "), (4, "<script>var t = '</p>';</script><style>p{}</style><!-- <p>hidden</p> -->"),
        (5, "<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav></body></html>"), (6, "<<<>>> & &bogus; &#0; <"), (None, "<p>x"),
        (8, "<div>" * 3000 + "deep" + "</div>" * 3000), (9, '<div class="' * 5000), (10, "<a " * 20000), (10, "<a " * 20000), (11, "</p></div></html>"),
        (12, "<article><p>" + "very long text of one block. " * 20000 + "</p></article>"),
    ]
    rows = [(None if i is None else -i, page) for i, page in rows]
    odd = spark.createDataFrame(rows, "page_id bigint, html string").withColumns({"url": F.lit(None).cast("string"), "text": F.lit("t"), "n_chars": F.lit("n")})
    found = html_extract.main_text(odd.unionByName(pages.select("page_id", "html", "url").withColumns({"text": F.lit(""), "n_chars": F.lit("")})))
    by_id = {r.page_id: r for r in found.collect()}
    assert found.count() == len(rows) + pages.count()
    for number in (1, 2, 3, 4, 5, 11):
        assert by_id[-number].text == "" and by_id[-number].n_chars == 0
    assert by_id[-12].text == " ".join(["very long text of one block."] * 20000)
    assert html_extract.main_text(pages.limit(0)).collect() == []
    assert [r.n_chars for r in html_extract.main_text(odd.limit(3)).collect()] == [0, 0, 0]


def test_references_and_white_space(spark, pages):
    body = "<article><h1> A\n title </h1><p>caf&eacute; &#8217;x&#x2019; &amp;amp; 1 &lt; 2&nbsp;&copy 2020 &am</p><p>in <b>b</b>old<br>next\t line</article>"
    one = spark.createDataFrame([(-1, "u", f"<html><body><nav><a href='/'>Home</a></nav>{body}<footer>&copy; us</footer></body></html>")], "page_id bigint, url string, html string")
    rows = html_extract.main_text(pages.select("page_id", "url", "html").unionByName(one)).where("page_id = -1").collect()
    assert rows[0].text == "A title café ’x’ &amp; 1 < 2 © 2020 &am in bold next line"


@pytest.mark.parametrize("page, expected", [
    ("<p>a<p>b <b>c</b>d", [(-1, "html", ""), (0, "p", ""), (1, "#text", "a"), (0, "p", ""), (3, "#text", "b cd")]),
    ("<ul><li>1<li>2</ul>x", [(-1, "html", ""), (0, "ul", ""), (1, "li", ""), (2, "#text", "1"), (1, "li", ""), (4, "#text", "2"), (0, "#text", "x")]),
    ('<div title="x>y">k</div>', [(-1, "html", ""), (0, "div", ""), (1, "#text", "k")]),
    ("<head><title>t</title></head><body>a < b</body>", [(-1, "html", ""), (0, "body", ""), (1, "#text", "a < b")]),
])
def test_nodes(page, expected):
    assert parsed(page) == expected


def test_decoding_equals_the_best_of_all_consistent_choices():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n = int(rng.integers(1, 11))
        nodes = dom.Nodes()
        nodes.parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        nodes.flags = [0] * n
        arrays = dom.shape(nodes)
        odds = rng.normal(size=n)
        best = max(
            (sum(o for o, c in zip(odds, choice) if c), choice)
            for choice in product([False, True], repeat=n)
            if all(p < 0 or not c or choice[p] for c, p in zip(choice, nodes.parent))
        )
        assert html_extract.decoded(odds, arrays).tolist() == list(best[1])


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(2)
    rows = rng.normal(size=(4000, 6)).astype(np.float32)
    rows[:, 5] = 1.0
    labels = ((rows[:, 0] > 0) ^ (rows[:, 3] > 0.5)).astype(float)
    model = boosting.fit(rows[:3000], labels[:3000])
    assert ((model.log_odds(rows[3000:]) > 0) == labels[3000:]).mean() > 0.95
    assert boosting.fit(rows[:50], np.ones(50)).log_odds(rows[:3]).min() > 0


def test_sample_is_bounded(pages):
    few = html_extract.Settings(pages=7, page_chars=2000)
    rows = html_extract.sampled(pages, "html", few).collect()
    assert len(rows) == 7 and all(len(r.html) <= 2000 for r in rows)
