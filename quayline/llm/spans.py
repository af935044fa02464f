"""Where patterns match, as column expressions: spans of code points.

A row may hold a very long text with very many matches, so nothing here costs more than in proportion:
running values are taken chunk by chunk (``running``) and pieces of a text are cut from short stretches of it
(``Stretches``) instead of being counted off from its beginning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

SPANS = "array<struct<start:int,order:int,end:int,kind:string>>"
# items in a chunk, characters in a stretch
CHUNK, STRETCH = 256, 512


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(items: Column, start: Column, step: Callable[[Column, Column], Column], out: Callable[[Column, Column], Column], state: str, found: str) -> Column:
    """``out(state before the item, item)`` of every item, where ``step`` takes the state past an item.
    ``state`` and ``found`` are the types of the state and of an output.

    An array that grows by one is copied each time; arrays of a chunk's outputs, and of the states at the
    chunks' beginnings, stay short."""

    def cut(own: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1)), F.lit(CHUNK)), lambda i: i <= F.size(own))
        return F.transform(begins, lambda i: F.slice(own, i, CHUNK))

    def inside(chunk: Column, at: Column) -> Column:
        begin = F.struct(at.alias("now"), F.array().cast(f"array<{found}>").alias("found"))
        return F.aggregate(
            chunk, begin,
            lambda s, x: F.struct(step(s["now"], x).alias("now"), F.array_append(s["found"], out(s["now"], x)).alias("found")),
            lambda s: s["found"],
        )

    def all_chunks(chunks: Column) -> Column:
        first = F.struct(start.cast(state).alias("now"), F.array().cast(f"array<{state}>").alias("seen"))
        states = F.aggregate(
            chunks, first,
            lambda s, chunk: F.struct(F.aggregate(chunk, s["now"], step).alias("now"), F.array_append(s["seen"], s["now"]).alias("seen")),
            lambda s: s["seen"],
        )
        return F.flatten(F.zip_with(chunks, states, inside))

    return bound(bound(items, cut), all_chunks)


def match_spans(text: Column, pattern: Column, length: Callable[[Column], Column] = F.length) -> Column:
    """``start, end`` of every match, leftmost first, without overlaps.

    The text is split at the matches; positions are the running lengths of gaps and matches.
    ``length`` says in which unit."""

    def pairs(matches: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(matches))
        return F.zip_with(gaps, matches, lambda g, m: F.struct(length(g).alias("gap"), length(m).alias("own")))

    def span(at: Column, pair: Column) -> Column:
        return F.struct((at + pair["gap"]).alias("start"), (at + pair["gap"] + pair["own"]).alias("end"))

    found = bound(F.regexp_extract_all(text, pattern, F.lit(0)), pairs)
    return running(found, F.lit(0), lambda at, pair: at + pair["gap"] + pair["own"], span, "int", "struct<start:int,end:int>")


def apart_from(spans: Column, others: Column, kind: str) -> Column:
    """Those of ``spans`` (sorted by start, of the array element type ``kind``) that touch none of ``others``."""
    entry = f"struct<start:int,other:boolean,end:int,span:{kind}>"
    pair = f"struct<x:{entry},edge:int>"
    nothing, big = F.lit(None).cast(kind), F.lit((1 << 31) - 1)

    def with_edge(edge: Column, x: Column) -> Column:
        return F.struct(x.alias("x"), edge.alias("edge"))

    def own_parts(own: Column) -> Column:
        mine = F.transform(own, lambda s: F.struct(s["start"].alias("start"), F.lit(False).alias("other"), s["end"].alias("end"), s.alias("span")))
        rest = F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(True).alias("other"), s["end"].alias("end"), nothing.alias("span")))
        merged = F.array_sort(F.concat(mine.cast(f"array<{entry}>"), rest.cast(f"array<{entry}>")))
        # the furthest end of the others that start before, then the nearest start of those behind
        after = running(merged, F.lit(-1), lambda m, x: F.when(x["other"], F.greatest(m, x["end"])).otherwise(m), with_edge, "int", pair)
        left = F.filter(after, lambda p: p["x"]["other"] | (p["edge"] <= p["x"]["start"]))
        back = F.reverse(F.transform(left, lambda p: p["x"]))
        before = running(back, big, lambda m, x: F.when(x["other"], F.least(m, x["start"])).otherwise(m), with_edge, "int", pair)
        kept = F.filter(before, lambda p: ~p["x"]["other"] & (p["edge"] >= p["x"]["end"]))
        return F.reverse(F.transform(kept, lambda p: p["x"]["span"]))

    return bound(spans, lambda own: F.when((F.size(others) > 0) & (F.size(own) > 0), own_parts(own)).otherwise(own))


class Stretches:
    """A text as an array of short stretches, from which pieces are cut."""

    def __init__(self, text: Column):
        self.whole = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % STRETCH), F.lit(0))

    def piece(self, stretches: Column, start: Column, end: Column) -> Column:
        """The characters from ``start`` up to ``end``."""
        first = F.floor(start / STRETCH).cast("int")
        held = F.slice(stretches, first + 1, F.floor((F.greatest(end, start) - 1) / STRETCH).cast("int") - first + 1)
        cut = F.substring(F.array_join(held, ""), start - first * STRETCH + 1, end - start)
        return F.when(end > start, cut).otherwise(F.lit(""))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
