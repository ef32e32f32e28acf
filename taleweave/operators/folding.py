"""Folds over long arrays inside a row, whose results grow with the array."""

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Values of a block. A result grows within its block alone; whole blocks are joined after.
BLOCK = 256


def bound(value: Column, use) -> Column:
    """use(value), with value evaluated once: lambda bodies are interpreted, and an expression in them is evaluated each time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def fold(values: Column, state: Column, step, element: str) -> Column:
    """struct(state, out): what is left after all values, and all that the steps put out, in order.

    step(state, value) gives the next state, whether something is put out, and that, of type `element`. A fold that adds to one array copies it at each
    step; here that is at most BLOCK elements a step, and once a block all there are, so a million values cost what a few arrays of that size do.
    """
    none = F.array().cast(f"array<{element}>")

    def one(acc, value):
        state, some, put = step(acc["state"], value)
        return F.struct(state.alias("state"), F.when(some, F.concat(acc["out"], F.array(put))).otherwise(acc["out"]).alias("out"))

    def of(values, state):
        return F.aggregate(values, F.struct(state.alias("state"), none.alias("out")), one)

    def blocks(values):
        def block(acc, k):
            part = of(F.slice(values, k * BLOCK + 1, F.lit(BLOCK)), acc["state"])
            return bound(part, lambda p: F.struct(p["state"].alias("state"), F.concat(acc["out"], p["out"]).alias("out")))

        last = ((F.size(values) - 1) / BLOCK).cast("int")
        whole = F.aggregate(F.sequence(F.lit(0), last), F.struct(state.alias("state"), none.alias("out")), block)
        return F.when(F.size(values) <= BLOCK, of(values, state)).otherwise(whole)

    return bound(values, blocks)


#: Characters of a page of a text.
PAGE = 4096


def pages(text: Column) -> Column:
    """A text in pages of PAGE characters, so that a place far behind is reached without counting all characters before it."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PAGE}}}"), 0)


def passage(pages: Column, start: Column, end: Column) -> Column:
    """The characters from start up to end (from 0; outside there are none) of a text in pages."""
    start, end = F.greatest(start, F.lit(0)), F.least(end, F.size(pages) * PAGE)

    def cut(place):
        first, last = (place["a"] / PAGE).cast("int"), ((place["b"] - 1) / PAGE).cast("int")
        page = lambda k: F.coalesce(F.get(pages, k), F.lit(""))
        head = F.substring(page(first), place["a"] - first * PAGE + 1, place["b"] - place["a"])
        middle = F.array_join(F.slice(pages, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
        tail = F.substring(page(last), F.lit(1), place["b"] - last * PAGE)
        return F.when(place["b"] <= place["a"], "").when(first == last, head).otherwise(F.concat(head, middle, tail))

    return bound(F.struct(start.alias("a"), end.alias("b")), cut)
