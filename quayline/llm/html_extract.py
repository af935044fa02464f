"""Main text of web pages by gradient-boosted trees over DOM nodes and a hierarchical decoding.

Every block element and every run of text of a page gets the log-odds of holding main text, from
features of its subtree, its names, its depth and its neighbours (``dom``).  A run of text is taken
only with all elements above it: the decoding finds the consistent choice with the highest sum of log-odds, bottom up
what the best choice below each node adds, top down whom the chosen parents let through.  No page keeps a paragraph
of a rejected container, and a doubtful container stands for what is good below it.

The trees are fitted on a bounded sample of pages.  Pages that mark their article (``article``,
``main``) label their own nodes, and their texts are laid out again in other templates
(``page_variants``), so that names and tags are evidence among others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from random import Random

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quayline.llm import boosting, dom
from quayline.llm.common import arrow_function, as_bytes, map_batches
from quayline.llm.page_variants import Layout


@dataclass(frozen=True)
class Settings:
    """The sample's bounds: ``pages`` of at most ``page_chars`` characters each, laid out ``variants``
    times with at most ``blocks`` of their blocks; other parts are made of ``words`` words."""

    pages: int = 200
    page_chars: int = 50_000
    variants: int = 4
    blocks: int = 30
    words: int = 20_000
    trees: boosting.Settings = boosting.Settings()


SETTINGS = Settings()
# what of a page is parsed and classified at a time, in bytes of pages
PAGES_AT_ONCE = 2 << 20
FILLER = "one text of a page without any other".split()
_MODEL = "feature array<bigint>, threshold array<float>, value array<double>"


def _flag(*names: str) -> int:
    return sum(1 << dom.FLAGS.index(n) for n in names)


ARTICLE = _flag("tag_article", "tag_main")
OTHER = _flag("tag_nav", "tag_aside", "tag_footer", "tag_form", "name_comment", "name_advert", "name_notice", "name_navigation", "name_side")


def _above(nodes: dom.Nodes, arrays: dom.Arrays) -> np.ndarray:
    own = np.array(nodes.flags, np.int64)
    above = np.zeros(len(own), np.int64)
    for level in arrays.levels[1:]:
        above[level] = above[arrays.parent[level]] | own[arrays.parent[level]]
    return above


def _labels(kept: np.ndarray, arrays: dom.Arrays) -> np.ndarray:
    """A node is positive when there is main text below it."""
    return (dom.below((kept & arrays.is_text).astype(float), arrays) > 0).astype(float)


def training_rows(pages: list[str], settings: Settings = SETTINGS) -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the nodes of marked pages and of the pages made from them."""
    given = dom.Nodes()
    for page in pages:
        given.add(page)
    arrays = dom.shape(given)
    above = _above(given, arrays)
    marked = (above & ARTICLE != 0) & (above & OTHER == 0) & arrays.is_text
    rows, labels, articles = [], [], []
    texts = np.array(given.text, dtype=object)
    whole = dom.features(given, arrays) if len(pages) else None
    for first, last in zip(given.pages, given.pages[1:]):
        own = slice(first, last)
        blocks = texts[own][marked[own]].tolist()
        if blocks:
            rows.append(whole[own])
            labels.append(_labels(marked, arrays)[own])
        articles.append(blocks or [t for t in texts[own].tolist() if t.count(" ") >= 4])
    articles = [a for a in articles if a] or [[" ".join(FILLER * 4)] * 4]
    words = [w for text in texts.tolist() for w in text.split(" ") if w][: settings.words] or FILLER
    made = dom.Nodes()
    for number, blocks in enumerate(articles):
        rng = Random(number)
        for _ in range(settings.variants):
            at = rng.randrange(len(blocks))
            made.add(Layout(rng, words).page((blocks[at:] + blocks[:at])[: rng.randint(1, settings.blocks)]))
    arrays = dom.shape(made)
    rows.append(dom.features(made, arrays))
    labels.append(_labels(np.array(made.kept, bool), arrays))
    return np.concatenate(rows), np.concatenate(labels)


def sampled(pages: DataFrame, html: str, settings: Settings = SETTINGS) -> DataFrame:
    """The pages with the lowest hashes among those that are not too long: ``html``."""
    short = pages.where(F.length(html) <= settings.page_chars).select(F.col(html).alias("html"), F.xxhash64(html).alias("h"))
    return short.orderBy("h", "html").limit(settings.pages).select("html")


def fitted(pages: DataFrame, html: str = "html", settings: Settings = SETTINGS) -> boosting.Trees:
    """The trees, fitted by one task on the bounded sample."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = sorted(text for batch in batches for text in batch.column("html").to_pylist())
        model = boosting.fit(*training_rows(given, settings), settings.trees)
        columns = [pa.array(list(model.feature)), pa.array(list(model.threshold)), pa.array(list(model.value))]
        yield pa.RecordBatch.from_arrays(columns, names=["feature", "threshold", "value"])

    rows = map_batches(sampled(pages, html, settings).coalesce(1), run, _MODEL).collect()
    return boosting.Trees(
        0.0, np.array([r["feature"] for r in rows], np.int64), np.array([r["threshold"] for r in rows], np.float32),
        np.array([r["value"] for r in rows], np.float64),
    )


def decoded(log_odds: np.ndarray, arrays: dom.Arrays) -> np.ndarray:
    """The choice of nodes, each with its parent, whose log-odds add up to the most."""
    gain = log_odds.astype(float).copy()
    for level in reversed(arrays.levels[1:]):
        np.add.at(gain, arrays.parent[level], np.maximum(gain[level], 0))
    chosen = gain > 0
    for level in arrays.levels[1:]:
        chosen[level] &= chosen[arrays.parent[level]]
    return chosen


def main_texts(pages: list[str], model: boosting.Trees) -> list[str]:
    """The main text of each page: its chosen runs of text in page order, joined by a space."""
    nodes = dom.Nodes()
    for page in pages:
        nodes.add(page)
    arrays = dom.shape(nodes)
    chosen = decoded(model.log_odds(dom.features(nodes, arrays)), arrays) & arrays.is_text
    out = []
    for first, last in zip(nodes.pages, nodes.pages[1:]):
        out.append(" ".join(nodes.text[i] for i in np.flatnonzero(chosen[first:last]) + first))
    return out


def _groups(pages: Iterator[bytes]) -> Iterator[list[str]]:
    held, size = [], 0
    for page in pages:
        held.append(page.decode())
        size += len(page)
        if size >= PAGES_AT_ONCE:
            yield held
            held, size = [], 0
    if held:
        yield held


def extracted(pages: DataFrame, html: str = "html", settings: Settings = SETTINGS) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``, its characters; columns of these names are
    replaced.

    Null and empty pages have the empty text; equal pages have equal texts; an empty table gives no rows.
    Character references are decoded, white space inside a block becomes one space."""
    model = pages.sparkSession.sparkContext.broadcast(fitted(pages, html, settings))

    @arrow_function("string")
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = [text for group in _groups(as_bytes(batch)) for text in main_texts(group, model.value)]
            yield pa.array(texts, pa.string())

    return pages.withColumn("text", extract(F.col(html))).withColumn("n_chars", F.length("text").cast("bigint"))


def main_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    return extracted(pages.select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
