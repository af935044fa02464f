"""Training pages: texts of sampled pages laid out again in many ways.

Sites mark up the same parts differently.  So that the classifier learns more than one template,
the article's blocks of a sampled page are put into containers of other kinds and names, in other
places and between other parts - menus, headers, sidebars, notices, adverts, forms, comments and
footers, whose words are taken from other texts.  Elements of the article carry ``data-keep="1"``,
other parts ``data-keep="0"``; the parser reads it as the label and features never see it.
"""

from __future__ import annotations

import html
from random import Random

KEEP, DROP = ' data-keep="1"', ' data-keep="0"'


def _name(rng: Random, words: str) -> str:
    """A class or id with one of the words, sometimes with none that says anything."""
    word = rng.choice(words.split())
    form = rng.choice(["{}", "{}", "{}-wrap", "site-{}", "{}_1", "box", "c{}"])
    value = form.format(word) if form != "c{}" else f"c{rng.randrange(100)}"
    return rng.choice([f' class="{value}"', f' id="{value}"', f" class='x {value}'", f' class={value.replace(" ", "")}'])


class Layout:
    """One page's random choices.  ``words`` are what other parts say."""

    def __init__(self, rng: Random, words: list[str]):
        self.rng, self.words = rng, words or ["text"]

    def phrase(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        at = self.rng.randrange(len(self.words))
        return html.escape(" ".join((self.words[at : at + n] + self.words)[:n]), quote=False)

    def links(self, low: int, high: int) -> str:
        n = self.rng.randint(low, high)
        return "".join(f'<li><a href="/{i}">{self.phrase(1, 4)}</a></li>' for i in range(n))

    def part(self, tags: str, names: str, inside: str, named: float = 0.8) -> str:
        tag = self.rng.choice(tags.split())
        attributes = _name(self.rng, names) if tag in ("div", "section", "ul", "ol", "table") or self.rng.random() > named else ""
        return f"<{tag}{attributes}{DROP}>{inside}</{tag}>"

    def navigation(self) -> str:
        if self.rng.random() < 0.3:
            return self.part("div nav", "breadcrumb pager menu tabs", " &raquo; ".join(f"<a href='#'>{self.phrase(1, 2)}</a>" for _ in range(4)))
        return self.part("nav nav div", "nav menu navbar navigation", f"<ul>{self.links(3, 9)}</ul>")

    def header(self) -> str:
        inside = self.rng.choice([f"<h1>{self.phrase(1, 3)}</h1>", f"<p>{self.phrase(2, 6)}</p>", f"<div>{self.phrase(1, 4)}</div>", self.phrase(1, 5)])
        return self.part("header div", "header masthead banner branding top", inside + (self.navigation() if self.rng.random() < 0.4 else ""))

    def footer(self) -> str:
        sign = self.rng.choice(["&copy; ", "&copy; 2020 ", "Copyright ", ""])
        inside = self.rng.choice([f"{sign}{self.phrase(2, 14)}", f"<p>{sign}{self.phrase(2, 20)}</p>", f"<ul>{self.links(2, 6)}</ul>{sign}{self.phrase(1, 5)}"])
        return self.part("footer footer div", "footer copyright foot bottom legal", inside)

    def side(self) -> str:
        inside = self.rng.choice([f"<h3>{self.phrase(1, 3)}</h3><ul>{self.links(3, 8)}</ul>", f"<p>{self.phrase(5, 40)}</p>", f"<ul>{self.links(2, 6)}</ul><p>{self.phrase(4, 20)}</p>"])
        return self.part("aside div", "sidebar side widget related recommended", inside)

    def advert(self) -> str:
        inside = self.rng.choice([self.phrase(3, 30), f"<p>{self.phrase(3, 30)}</p>", f'<a href="//x">{self.phrase(2, 12)}</a>', f"<b>{self.phrase(1, 4)}</b> {self.phrase(3, 20)}"])
        return self.part("div div aside", "ad ads advert sponsored promo advertisement", inside)

    def notice(self) -> str:
        inside = f"{self.phrase(5, 30)}" + self.rng.choice(["", f"<button>{self.phrase(1, 2)}</button>", f"<a href='#'>{self.phrase(1, 3)}</a>"])
        return self.part("div div section dialog", "cookie notice consent alert popup newsletter", self.rng.choice([inside, f"<p>{inside}</p>"]))

    def form(self) -> str:
        inside = f"<label>{self.phrase(1, 4)}</label><input name=q><button>{self.phrase(1, 2)}</button>" + self.rng.choice(["", f"<p>{self.phrase(3, 15)}</p>"])
        return f"<form{DROP}{self.rng.choice(['', _name(self.rng, 'search login contact newsletter')])}>{inside}</form>"

    def comments(self) -> str:
        tag, inner = self.rng.choice([("div", "div"), ("section", "article"), ("ol", "li"), ("section", "div"), ("ul", "li"), ("div", "p")])
        parts = [f"<h3>{self.phrase(1, 3)}</h3>"] if self.rng.random() < 0.6 else []
        for _ in range(self.rng.randint(1, 6)):
            text = self.phrase(4, 60) if inner == "p" else f"<p>{self.phrase(4, 60)}</p>"
            who = f"<b>{self.phrase(1, 2)}</b> " if self.rng.random() < 0.7 else ""
            parts.append(f"<{inner}{_name(self.rng, 'comment reply comment response')}>{who}{text}</{inner}>")
        return f"<{tag}{_name(self.rng, 'comments comments responses discussion commentlist')}{DROP}>{''.join(parts)}</{tag}>"

    def share(self) -> str:
        return self.part("div ul", "share social tags meta", f"{self.links(2, 5)}")

    def block(self, text: str, first: bool) -> str:
        """A block of the article."""
        said = html.escape(text, quote=False)
        if first and self.rng.random() < 0.7:
            return f"<h1{KEEP}>{said}</h1>"
        words = said.split(" ")
        if len(words) > 8 and self.rng.random() < 0.25:
            at = self.rng.randrange(len(words) - 4)
            mark = self.rng.choice(["a href='/x'", "b", "i", "em", "span"])
            words[at : at + 3] = [f"<{mark}>{' '.join(words[at : at + 3])}</{mark.split(' ')[0]}>"]
            said = " ".join(words)
        if self.rng.random() < 0.1:
            said = said.replace(". ", ".<br>", 1)
        tag = self.rng.choice("p p p p p p div blockquote h2 pre li".split())
        if tag == "li":
            return f"<ul{KEEP}><li>{said}</li></ul>"
        return f"<{tag}{KEEP}>{said}" + ("" if tag == "p" and self.rng.random() < 0.2 else f"</{tag}>")

    def article(self, blocks: list[str]) -> str:
        parts = [self.block(text, i == 0) for i, text in enumerate(blocks)]
        for make, chance in ((self.advert, 0.3), (self.share, 0.15), (self.notice, 0.1), (self.side, 0.1)):
            if self.rng.random() < chance:
                parts.insert(self.rng.randint(0, len(parts)), make())
        if self.rng.random() < 0.25:
            parts.append(self.comments())
        inside = "".join(parts)
        for _ in range(self.rng.randint(1, 3)):
            tag = self.rng.choice("article article main div div section td".split())
            name = _name(self.rng, "article content post entry main story body") if tag in ("div", "section") else ""
            if tag == "td":
                inside = f"<table><tr><td>{inside}</td></tr></table>"
            else:
                inside = f"<{tag}{name}>{inside}</{tag}>"
        return inside

    def page(self, blocks: list[str]) -> str:
        rng = self.rng
        before = [(self.header, 0.6), (self.navigation, 0.7), (self.notice, 0.3), (self.advert, 0.4), (self.form, 0.2), (self.side, 0.2)]
        after = [(self.share, 0.2), (self.comments, 0.4), (self.side, 0.4), (self.advert, 0.2), (self.form, 0.2), (self.notice, 0.2), (self.footer, 0.8)]
        parts = [make() for make, chance in before if rng.random() < chance]
        if rng.random() < 0.3:
            rng.shuffle(parts)
        parts.append(self.article(blocks))
        parts += [make() for make, chance in after if rng.random() < chance]
        inside = "".join(parts)
        if rng.random() < 0.3:
            inside = f"<div{_name(rng, 'page wrap container site')}>{inside}</div>"
        return f"<html><head><title>{self.phrase(2, 8)}</title><style>p{{}}</style></head><body>{inside}</body></html>"
