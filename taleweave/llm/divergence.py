"""Source divergence audit: how unlike the sources of a language use its terms, by pair-task sparse merges.

Method: each (language, source) group has a sparse vector of (term id, count), sorted by id; a language as a whole has one too. For each
unordered pair of groups a task co-groups their arrays and merges them by galloping: terms of both, of one side alone, and of neither,
which all have the same price, are summed up in both directions. A group paired with its language gives its telling terms.

Prices are exact: a term counted c times among N has p = 1 + floor(10^9 (c + 1) / (N + V)), and costs floor((p - q)^2 / q) against q. The division
is done digit by digit to the base 1000, so 64 bits are enough for up to 9 * 10^15 counted words a group.

Scale and skew:
* Words are counted inside each task before anything is shuffled; a hot source's rows are added up where they are read.
* The kept terms of a language are cut by hash into blocks of about BLOCK terms, and its sources into tiles of about TILE; ids are numbered
  within a block. One task holds two tiles of one block, however large vocabulary, corpus and number of sources are. The sums of blocks are added.
* Only the result itself grows with the square of a language's sources. The ranking of terms sees at most `ranks` a group and block.

Defined cases: null text, lang and source are ''. Repeated rows count each time, as documents of their own, for ids aren't read. A group without terms has
N = 0; a language without kept terms gives pairs of value 0. Equal values rank by the bytes of the item. Very long texts are counted whole. Other columns
are not read, whatever their names. An empty table gives an empty one.
"""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import rows_to_batch, row_slices
from taleweave.llm.lineage import stored

#: A term is kept if so many documents of its language have it.
DOCUMENTS = 3
SCALE_STEPS = 3  # the scale of prices is 1000 ** 3
RANKS = 200
#: Terms of a block and groups of a tile, about.
BLOCK, TILE = 16_384, 32
#: A task's counts are handed on when they hold this many terms.
HELD = 200_000

COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])
#: Bytes of terms: letters, A-Z lower-cased, and all that isn't ASCII; others stand between terms.
_FOLD = bytes(i if i >= 128 or 97 <= i <= 122 else i + 32 if 65 <= i <= 90 else 32 for i in range(256))


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (rows that have it), added up; a null term has a row for each group."""

    def handed_on(held):
        for (lang, source), (n, seen, _) in held.items():
            terms = list(n)
            for i in range(0, len(terms), 20_000):
                part = terms[i : i + 20_000]
                yield rows_to_batch(COUNTS, {"lang": [lang] * len(part), "source": [source] * len(part), "term": [t.decode() for t in part], "n": [n[t] for t in part], "docs": [seen[t] for t in part]})
            yield rows_to_batch(COUNTS, {"lang": [lang], "source": [source], "term": [None], "n": [0], "docs": [0]})

    def run(batches):
        held, size = {}, 0
        for batch in batches:
            for _, part in row_slices(batch, ["text"]):
                for text, lang, source in zip(part.column("text").to_pylist(), part.column("lang").to_pylist(), part.column("source").to_pylist()):
                    if (lang, source) not in held:
                        held[lang, source] = (Counter(), Counter(), None)
                    n, seen, _ = held[lang, source]
                    before = len(n)
                    words = text.encode().translate(_FOLD).split(b" ")
                    n.update(words)
                    n.pop(b"", None)
                    seen.update(set(words))
                    size += len(n) - before
                    if size > HELD:
                        yield from handed_on(held)
                        held, size = {}, 0
        yield from handed_on(held)

    filled = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")))
    parts = filled.mapInArrow(run, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def prices(counts: np.ndarray, whole: int) -> np.ndarray:
    """1 + floor(1000 ** SCALE_STEPS * (count + 1) / whole), for 0 <= count < whole."""
    rest = np.asarray(counts, dtype=np.int64) + 1
    found, rest = np.divmod(rest, whole)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * 1000, whole)
        found = found * 1000 + digit
    return found + 1


def costs(p, q):
    """floor((p - q)^2 / q)"""
    return (p - q) * (p - q) // q


def gallop(some: np.ndarray, many: np.ndarray, chunk: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Where the ids that two sorted arrays share stand in each; steps through the longer one double until they pass a chunk of the shorter one."""
    if len(some) > len(many):
        b, a = gallop(many, some, chunk)
        return a, b
    at, base = np.empty(len(some), dtype=np.int64), 0
    for i in range(0, len(some), chunk):
        ids = some[i : i + chunk]
        step = chunk
        while base + step < len(many) and many[base + step] < ids[-1]:
            step *= 2
        at[i : i + chunk] = base + np.searchsorted(many[base : base + step + 1], ids)
        base = int(at[min(i + chunk, len(some)) - 1])
    here = at < len(many)
    here[here] = many[at[here]] == some[here]
    return np.flatnonzero(here), at[here]


class Group:
    """One group's terms of a block, and what they cost."""

    def __init__(self, row):
        self.source, self.ids = row["source"], np.array(row["ids"], dtype=np.int64)
        whole = row["whole"] + row["terms"]
        self.p = prices(np.array(row["counts"], dtype=np.int64), whole) if len(self.ids) else self.ids
        self.none = int(prices(np.zeros(1), whole)[0]) if whole else 1


def both_ways(a: Group, b: Group, terms: int) -> tuple[int, int]:
    """The cost of a against b, and of b against a, over a block of so many terms."""
    i, j = gallop(a.ids, b.ids)
    alone_a, alone_b = np.delete(a.p, i), np.delete(b.p, j)
    neither = terms - len(a.ids) - len(b.ids) + len(i)
    there = costs(a.p[i], b.p[j]).sum() + costs(alone_a, b.none).sum() + costs(a.none, alone_b).sum() + costs(a.none, b.none) * neither
    back = costs(b.p[j], a.p[i]).sum() + costs(b.none, alone_a).sum() + costs(alone_b, a.none).sum() + costs(b.none, a.none) * neither
    return int(there), int(back)


def telling(a: Group, language: Group, ranks: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of the terms that a has oftener than its language, at most `ranks` in order of cost, then id; and their costs."""
    i, j = gallop(a.ids, language.ids)
    p, q = a.p[i], language.p[j]
    more = p > q
    ids, value = a.ids[i][more], costs(p[more], q[more])
    first = np.lexsort((ids, -value))[:ranks]
    return ids[first], value[first]


PRICED = pa.schema([("lang", pa.string()), ("source", pa.string()), ("other", pa.string()), ("block", pa.int32()), ("id", pa.int32()), ("value", pa.int64())])


def vectors(counts: DataFrame, kept: DataFrame, languages: DataFrame) -> DataFrame:
    """One row a group and block, and one a language and block (source null): ids and counts, sorted; whole, the group's N; terms, V; here, the block's terms; tile."""
    entries = counts.where("term is not null").join(kept.select("lang", "term", "block", "id"), ["lang", "term"])
    groups = counts.where("term is null").select("lang", "source").join(languages, "lang")
    sums = entries.groupBy("lang", "source").agg(F.sum("n").alias("whole"))
    groups = groups.join(sums, ["lang", "source"], "left").withColumn("whole", F.coalesce("whole", F.lit(0))).withColumn("tile", F.pmod(F.xxhash64("source"), "tiles").cast("int"))
    grid = groups.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    arrays = F.sort_array(F.collect_list(F.struct("id", "n")))
    of_group = entries.groupBy("lang", "source", "block").agg(arrays.alias("v"))
    of_lang = kept.select("lang", "block", "id", F.col("total").alias("n")).groupBy("lang", "block").agg(arrays.alias("v"), F.count("*").cast("long").alias("here"))
    sides = grid.join(of_group, ["lang", "source", "block"], "left").join(of_lang.select("lang", "block", "here"), ["lang", "block"], "left")
    whole = languages.join(of_lang, "lang").select("lang", F.lit(None).cast("string").alias("source"), "block", "v", "here", F.col("total").alias("whole"), "terms", "tiles", F.lit(-1).alias("tile"))
    rows = sides.select("lang", "source", "block", "v", "here", "whole", "terms", "tiles", "tile").unionByName(whole)
    return rows.select(
        "lang", "source", "block", F.coalesce("v.id", F.array().cast("array<int>")).alias("ids"), F.coalesce("v.n", F.array().cast("array<long>")).alias("counts"), F.coalesce("here", F.lit(0)).alias("here"), "whole", "terms", "tiles", "tile"
    )


def priced_pairs(sides: DataFrame, ranks: int = RANKS) -> DataFrame:
    """lang, source, other, value: of each block the costs of a group against another (id null), and of its telling terms (other null)."""
    # A tile is the first of a pair with itself and all after it, and the second with itself and all before; a language, tile -1, comes before all.
    after = F.sequence(F.greatest("tile", F.lit(0)), F.col("tiles") - 1)
    firsts = sides.select("*", F.explode(after).alias("second")).withColumn("first", F.col("tile"))
    seconds = sides.toDF(*sides.columns).where("tile >= 0").select("*", F.explode(F.sequence(F.lit(-1), F.col("tile"))).alias("first")).withColumn("second", F.col("tile"))
    keys = ["lang", "block", "first", "second"]

    def price(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = {f.name: [] for f in PRICED}

        def add(*values):
            for name, v in zip(rows, values):
                rows[name].append(v)

        lefts, rights = left.to_pylist(), right.to_pylist()
        if not lefts or not rights:
            return PRICED.empty_table()
        lang, block, here = rights[0]["lang"], rights[0]["block"], rights[0]["here"]
        a_side, b_side = [Group(r) for r in lefts], [Group(r) for r in rights]
        same = lefts[0]["tile"] == rights[0]["tile"]
        for a in a_side:
            for b in b_side:
                if a.source is None:
                    for i, value in zip(*(v.tolist() for v in telling(b, a, ranks))):
                        add(lang, b.source, None, block, i, value)
                elif not same or a.source < b.source:
                    there, back = both_ways(a, b, here)
                    add(lang, a.source, b.source, block, None, there)
                    add(lang, b.source, a.source, block, None, back)
        return pa.table({f.name: pa.array(rows[f.name], type=f.type) for f in PRICED}, schema=PRICED)

    pairs = firsts.groupBy(*keys).cogroup(seconds.groupBy(*keys))
    return pairs.applyInArrow(price, "lang string, source string, other string, block int, id int, value long")


def audit(docs: DataFrame, documents: int = DOCUMENTS, ranks: int = RANKS) -> DataFrame:
    """lang, source, part ('pair', 'term'), item, value, rank: a group's cost against each other source, and its `ranks` most telling terms."""
    counts = stored(term_counts(docs))
    lang_terms = stored(counts.where("term is not null").groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total")).where(F.col("docs") >= documents))
    sizes = lang_terms.groupBy("lang").agg(F.count("*").alias("terms"), F.sum("total").alias("total"))
    languages = counts.where("term is null").groupBy("lang").agg(F.count("*").alias("groups")).join(sizes, "lang", "left")
    languages = stored(languages.select(
        "lang", F.coalesce("terms", F.lit(0)).alias("terms"), F.coalesce("total", F.lit(0)).alias("total"),
        F.ceil(F.greatest(F.coalesce("terms", F.lit(0)), F.lit(1)) / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("groups") / TILE).cast("int").alias("tiles"),
    ))
    blocked = lang_terms.join(languages.select("lang", "blocks"), "lang").withColumn("block", F.pmod(F.xxhash64("term"), "blocks").cast("int"))
    in_block = Window.partitionBy("lang", "block").orderBy("term")
    kept = stored(blocked.select("lang", "term", "total", "block", (F.row_number().over(in_block) - 1).alias("id")))
    priced = stored(priced_pairs(stored(vectors(counts, kept, languages)), ranks))
    pairs = priced.where("id is null").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    first = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked_pairs = pairs.withColumn("rank", F.row_number().over(first))
    terms = priced.where("id is not null").join(kept.select("lang", "block", "id", F.col("term").alias("item")), ["lang", "block", "id"]).select("lang", "source", "item", "value", F.lit("term").alias("part"))
    ranked_terms = terms.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= ranks)
    return ranked_pairs.unionByName(ranked_terms).select("lang", "source", "part", "item", "value", "rank")
