"""The outermost blocks of a page from its tags, with the ends that HTML implies.

A stack of open elements goes over the tags of a page as a tree builder's does: a paragraph ends where a block, a heading or a list begins, a heading
where the next one does, an item where the next item of its list does, a cell, row or group of rows where its table goes on; an end tag ends all that is open within its
element, and is ignored where none is open in its scope. Elements of phrases never end a block and aren't kept. `<p/>` is empty, as in XHTML. What stands
in a table outside its cells stays where it is. Each tag is looked at once, and positions are kept by name, so the time is linear in the tags, however deep a page is.
"""

from collections import defaultdict

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

# HTML's elements by what they do to the stack.
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
BLOCKS = ("p", *HEADINGS, "blockquote", "li")
_ITEMS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt")}
_END_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form header hgroup listing main menu nav ol p pre search section summary table ul".split())
_SCOPES = frozenset("applet caption html marquee object table td template th".split())
_GROUPS = ("tbody", "thead", "tfoot")
#: Elements within tables, and after which open element of the table they stand.
_WITHIN = {"caption": ("table",), "colgroup": ("table",), **{g: ("table",) for g in _GROUPS}, "tr": ("table", *_GROUPS), "td": ("table", *_GROUPS, "tr"), "th": ("table", *_GROUPS, "tr")}
_KEPT = _END_P | _SCOPES | frozenset(HEADINGS) | frozenset(_ITEMS) | frozenset(_WITHIN) | {"button"}


def _roles(tag):
    yield tag
    if tag in _SCOPES:
        yield "#scope"
    if tag in _SCOPES or tag in ("ol", "ul"):
        yield "#list"
    if tag in HEADINGS:
        yield "#heading"
    if tag not in ("address", "div", "p"):
        yield "#special"


_ROLES = {tag: tuple(_roles(tag)) for tag in _KEPT}


def outermost(tags):
    """[(tag, first, end)]: the outermost blocks and their tokens, end excluded.

    tags has a value for each token: a name, `/name` of an end tag, `name/` of an empty element, nothing for text.
    """
    stack, where, made = [], defaultdict(list), []
    last = lambda role: where[role][-1] if where[role] else -1
    tag_of, first, base = None, 0, 0  # of the block that is open

    def pop_to(place, now):
        nonlocal tag_of
        while len(stack) > place:
            for role in _ROLES[stack.pop()]:
                where[role].pop()
        if tag_of and place <= base:
            made.append((tag_of, first, max(first, now)))
            tag_of = None

    for now, code in enumerate(tags):
        closing, name = code[:1] == "/", code.strip("/")
        top = stack[-1] if stack else ""
        if closing and name in _KEPT:
            if name == "p":  # whatever is kept and opened within a paragraph ended it, or hides it
                place = len(stack) - 1 if top == "p" else -1
            elif name in HEADINGS:
                place = last("#heading") if last("#heading") > last("#scope") else -1
            else:
                place = last(name) if last(name) >= last("#list" if name == "li" else "table" if name in _WITHIN or name == "table" else "#scope") else -1
            if place >= 0:
                pop_to(place, now)
        elif not closing and (name in _KEPT or name == "hr"):
            if name in _ITEMS and last("#special") >= 0 and stack[last("#special")] in _ITEMS[name]:
                pop_to(last("#special"), now)
            if name in _WITHIN:
                if last("table") < 0:
                    continue
                pop_to(max(last(outer) for outer in _WITHIN[name] if last(outer) >= last("table")) + 1, now)
            elif name == "button" and last("button") > last("#scope"):
                pop_to(last("button"), now)
            if stack and stack[-1] == "p" and (name in _END_P or name in HEADINGS or name in _ITEMS or name == "hr"):
                pop_to(len(stack) - 1, now)
            if name in HEADINGS and stack and stack[-1] in HEADINGS:
                pop_to(len(stack) - 1, now)
            if name == "hr":
                continue
            if not tag_of and name in BLOCKS:
                tag_of, first, base = name, now + 1, len(stack)
            for role in _ROLES[name]:
                where[role].append(len(stack))
            stack.append(name)
            if code[-1] == "/":
                pop_to(len(stack) - 1, now)
    pop_to(0, len(tags))
    return made


@F.pandas_udf(ArrayType(StructType().add("tag", StringType()).add("first", IntegerType()).add("end", IntegerType())))
def outermost_blocks(tags: pd.Series) -> pd.Series:
    """outermost() of each page; a null page has none."""
    return tags.map(lambda codes: [] if codes is None else [{"tag": t, "first": a, "end": b} for t, a, b in outermost(codes)])
