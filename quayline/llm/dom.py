"""Pages as flat arrays of nodes: block elements and the runs of text between them.

Nodes are numbered in page order, parents first, so that everything below a node is a range of
numbers: sums over subtrees are differences of running sums, and what ancestors hand down goes
level by level.  Inline elements are no nodes; their text belongs to the run around them.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable
from dataclasses import dataclass

import numpy as np

# a quoted value ends before the next '<', so that an open quote costs no more than its tag; the rest of a tag
# that is not well formed ends at the next '>' or with the page
_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?:[^>"'<]|"[^"<]*"|'[^'<]*')*+)>|<[a-zA-Z/!?](?:[^>]{0,4096}>|[^<>]*\Z)|[^<]+|<""", re.S
)
_NAMES = re.compile(r"""(?<![\w-])(class|id|role|itemprop|data-keep)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_PART = re.compile(r"[a-z]+")

# fixed values: element kinds of HTML
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
# not displayed or a control; the first kind runs to the end of the page where it is not closed
RAW = {n: re.compile(rf"</{n}\s*>", re.I) for n in "script style title textarea iframe xmp noembed noframes".split()}
HIDDEN = {n: re.compile(rf"</{n}\s*>", re.I) for n in "template noscript object svg math select canvas audio video".split()}
BLOCK = set(
    """html body main article section div nav aside header footer form fieldset p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd
    table caption thead tbody tfoot tr td th blockquote pre figure figcaption address details summary dialog center menu hr
    label button legend""".split()
)
# an opening element of the first kind closes an open one of the second, inside the third
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}

# groups of tags, each a feature of a node and of what is below it
TAGS: dict[str, str] = {
    "article": "article", "main": "main", "nav": "nav menu", "aside": "aside", "header": "header", "footer": "footer",
    "form": "form fieldset label button legend dialog", "section": "section div center details", "paragraph": "p blockquote pre",
    "heading": "h1 h2 h3 h4 h5 h6 summary caption figcaption", "list": "ul ol dl", "item": "li dt dd",
    "table": "table tr td th thead tbody tfoot", "page": "html body", "text": "#text",
}
# words in names of classes, ids and roles, by what they say
NAMES: dict[str, str] = {
    "content": "article articles content post entry main story body text page blog news copy read single hentry prose lede",
    "navigation": "nav navigation navbar menu breadcrumb breadcrumbs crumbs pager pagination tabs toolbar toc skip links",
    "head": "header head masthead banner logo brand branding top topbar hero title",
    "foot": "footer foot copyright legal bottom colophon contentinfo imprint credits",
    "side": "sidebar side aside widget widgets rail complementary column related recommended more popular trending",
    "advert": "ad ads advert adverts advertisement sponsor sponsored promo promotion banner dfp outbrain taboola",
    "notice": "cookie cookies consent notice alert popup modal overlay gdpr warning message newsletter subscribe toast",
    "comment": "comment comments commentlist reply replies respond response disqus discussion thread feedback reader",
    "form": "form search login signin signup register input field contact",
    "share": "share sharing social follow tags meta byline author date rating tools print",
}

FLAGS = [f"tag_{n}" for n in TAGS] + [f"name_{n}" for n in NAMES]
_TAG_FLAG = {tag: 1 << i for i, tags in enumerate(TAGS.values()) for tag in tags.split()}
_NAME_FLAG: dict[str, int] = {}
for _i, _words in enumerate(NAMES.values(), len(TAGS)):
    for _word in _words.split():
        _NAME_FLAG[_word] = _NAME_FLAG.get(_word, 0) | 1 << _i
TEXT_FLAG = _TAG_FLAG["#text"]


class Nodes:
    """Nodes of pages parsed one after the other, as lists."""

    def __init__(self) -> None:
        self.parent: list[int] = []
        self.flags: list[int] = []
        self.kind: list[str] = []
        self.kept: list[bool] = []
        self.text: list[str] = []
        self.link_chars: list[int] = []
        self.marks: list[int] = []  # inline tags of a run of text
        self.pages: list[int] = [0]

    def _node(self, parent: int, kind: str, flags: int, kept: bool, text: str = "", links: int = 0, marks: int = 0) -> int:
        self.parent.append(parent)
        self.flags.append(flags)
        self.kind.append(kind)
        self.kept.append(kept)
        self.text.append(text)
        self.link_chars.append(links)
        self.marks.append(marks)
        return len(self.parent) - 1

    def add(self, page: str) -> None:
        """Parses a page.  Unknown, unclosed and unopened elements are taken as browsers would, more
        or less; what is not displayed is left out."""
        stack = [(self._node(-1, "html", _TAG_FLAG["html"], False), "html")]
        open_kinds = {"html": 1}
        pieces: list[str] = []
        links = marks = 0
        link = False
        unclosed: set[str] = set()
        at, end = 0, len(page)

        def flush() -> None:
            nonlocal links, marks
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1][0]
                self._node(top, "#text", TEXT_FLAG, self.kept[top], text, min(links, len(text)), marks)
            pieces.clear()
            links = marks = 0

        def close(kinds: set[str], within: set[str]) -> None:
            """Closes the nearest open element of these kinds, unless one of ``within`` is nearer."""
            if any(open_kinds.get(k) for k in kinds):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i][1] in kinds:
                        for _, kind in stack[i:]:
                            open_kinds[kind] -= 1
                        del stack[i:]
                        return
                    if stack[i][1] in within:
                        return

        while at < end:
            token = _TOKEN.match(page, at)
            at = token.end()
            name = token[2]
            if name is None:
                piece = token[0]
                if piece[0] == "<" and len(piece) > 1:
                    continue  # comments, declarations and broken tags
                if "&" in piece:
                    piece = html.unescape(piece)
                pieces.append(piece)
                if link:
                    links += len(piece)
                continue
            name = name.lower()
            if token[1]:
                if name in BLOCK:
                    flush()
                    link = False
                    if open_kinds.get(name) and name != "html":
                        close({name}, set())
                elif name == "a":
                    link = False
                continue
            if name in RAW or name in HIDDEN:
                if name in RAW or not token[3].endswith("/"):
                    stop = (RAW.get(name) or HIDDEN[name]).search(page, at) if name not in unclosed else None
                    if stop:
                        at = stop.end()
                    elif name in RAW:
                        at = end
                    else:
                        unclosed.add(name)
                pieces.append(" ")
                continue
            if name not in BLOCK:
                if name in VOID:
                    pieces.append(" ")
                elif name == "a":
                    link = True
                marks += 1
                continue
            flush()
            flags = _TAG_FLAG.get(name, 0)
            kept = self.kept[stack[-1][0]]
            if token[3]:
                for key, value in _NAMES.findall(token[3]):
                    if key.lower() == "data-keep":
                        kept = value.strip("\"'") == "1"
                        continue
                    for word in _PART.findall(value.lower()):
                        flags |= _NAME_FLAG.get(word, 0)
            if name in ("html", "body") and open_kinds.get(name):
                self.flags[stack[0][0]] |= flags
                continue
            if name in _CLOSES:
                close(*_CLOSES[name])
            elif name not in ("label", "button", "legend"):
                close({"p"}, {"td", "th", "table", "button"})
            node = self._node(stack[-1][0], name, flags, kept)
            if name not in VOID:
                stack.append((node, name))
                open_kinds[name] = open_kinds.get(name, 0) + 1
        flush()
        self.pages.append(len(self.parent))


@dataclass(frozen=True)
class Arrays:
    """The nodes' shape: parents, depths, the number after each subtree, and which runs of text there are."""

    parent: np.ndarray
    depth: np.ndarray
    levels: list[np.ndarray]
    end: np.ndarray
    is_text: np.ndarray


def shape(nodes: Nodes) -> Arrays:
    parent = np.array(nodes.parent, np.int64)
    depths: list[int] = []
    for p in nodes.parent:
        depths.append(depths[p] + 1 if p >= 0 else 0)
    depth = np.array(depths, np.int64)
    order = np.argsort(depth, kind="stable")
    levels = np.split(order, np.cumsum(np.bincount(depth))[:-1]) if len(depth) else []
    end = np.arange(1, len(parent) + 1)
    for level in reversed(levels[1:]):
        np.maximum.at(end, parent[level], end[level])
    is_text = np.array(nodes.flags, np.int64) & TEXT_FLAG != 0 if len(parent) else np.empty(0, bool)
    return Arrays(parent, depth, levels, end, is_text)


def below(values: np.ndarray, arrays: Arrays) -> np.ndarray:
    """Sums over each node and everything below it."""
    running = np.concatenate([[0], np.cumsum(values)])
    return running[arrays.end] - running[np.arange(len(values))]


NUMBERS = [
    "depth", "chars", "words", "word_length", "link_share", "marks", "tags", "density", "stops", "digits", "capitals", "texts",
    "chars_per_text", "page_share", "from_start", "children", "place", "place_from_end", "alike", "before_chars", "after_chars",
    "before_links", "after_links", "parent_chars", "parent_links", "share_of_parent", "parent_density", "largest", "copyright", "bars",
]
FEATURES = NUMBERS + FLAGS + [f"above_{f}" for f in FLAGS]
_COUNTS = [re.compile(p) for p in (r"[.,;:!?]", r"[0-9]", r"[A-Z]", r"[©®™]", r"[|»›·•/]")]


def _counted(texts: Iterable[str]) -> np.ndarray:
    rows = [(len(t), t.count(" ") + 1 if t else 0, *(len(p.findall(t)) for p in _COUNTS)) if t else (0,) * 7 for t in texts]
    return np.array(rows, np.float64).reshape(-1, 7)


def features(nodes: Nodes, arrays: Arrays) -> np.ndarray:
    """One row per node in the order of ``FEATURES``: the subtree's density and links, the names of the node and
    of those above it, depth, and the neighbours under the same parent."""
    n = len(arrays.parent)
    chars, words, stops, digits, capitals, rights, bars = (below(c, arrays) for c in _counted(nodes.text).T)
    links = below(np.array(nodes.link_chars, float), arrays)
    marks = below(np.array(nodes.marks, float), arrays)
    texts = below(arrays.is_text.astype(float), arrays)
    tags = arrays.end - np.arange(n) + marks
    page = np.repeat(np.arange(len(nodes.pages) - 1), np.diff(nodes.pages))
    root = np.array(nodes.pages[:-1], np.int64)[page]
    up = np.maximum(arrays.parent, root)
    some = np.maximum(chars, 1)
    link_share, density = links / some, chars / tags

    # neighbours under one parent stand together when sorted by it
    order = np.lexsort((np.arange(n), up))
    order = order[arrays.parent[order] >= 0]
    same = np.concatenate([[False], up[order][1:] == up[order][:-1]]) if len(order) else np.empty(0, bool)
    before, after = np.full(n, -1), np.full(n, -1)
    before[order[1:][same[1:]]] = order[:-1][same[1:]]
    after[order[:-1][same[1:]]] = order[1:][same[1:]]
    children = np.bincount(arrays.parent[arrays.parent >= 0], minlength=n)
    firsts = np.flatnonzero(~same)
    place = np.zeros(n)
    place[order] = np.arange(len(order)) - np.repeat(firsts, np.diff([*firsts, len(order)]))
    kinds = np.unique(np.array(nodes.kind, dtype=object).astype(str), return_inverse=True)[1] if n else np.empty(0, np.int64)
    _, family, sizes = np.unique(up * (kinds.max(initial=0) + 1) + kinds, return_inverse=True, return_counts=True)
    largest = np.zeros(n)
    np.maximum.at(largest, up, np.where(arrays.parent >= 0, chars, 0))
    start = np.concatenate([[0], np.cumsum(_lengths(nodes.text))])[:-1]

    def beside(values: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.where(other >= 0, values[other], -1)

    def log(values: np.ndarray) -> np.ndarray:
        return np.log1p(np.maximum(values, -0.5))

    whole = np.maximum(chars[root], 1)
    numbers = [
        arrays.depth, log(chars), log(words), chars / np.maximum(words, 1), link_share, log(marks), log(tags), log(density), stops / some,
        digits / some, capitals / some, log(texts), log(chars / np.maximum(texts, 1)), chars / whole, (start - start[root]) / whole,
        log(children), log(place), log(children[up] - place - 1), sizes[family] / np.maximum(children[up], 1),
        log(beside(chars, before)), log(beside(chars, after)), beside(link_share, before), beside(link_share, after),
        log(chars[up]), link_share[up], chars / np.maximum(chars[up], 1), log(density[up]), chars / np.maximum(largest[up], 1),
        rights / some, bars / some,
    ]
    own = np.array(nodes.flags, np.int64)
    above = np.zeros(n, np.int64)
    for level in arrays.levels[1:]:
        above[level] = above[arrays.parent[level]] | own[arrays.parent[level]]
    bits = [(flags >> i & 1).astype(np.float32) for flags in (own, above) for i in range(len(FLAGS))]
    return np.stack([np.asarray(c, np.float32) for c in numbers] + bits, axis=1)


def _lengths(texts: list[str]) -> np.ndarray:
    return np.fromiter(map(len, texts), np.int64, len(texts))
