"""Near-duplicate documents: a signature-coordinate inverted join, confirmed on full shingle sets.

Method: every document's set of distinct five-word shingles gets a min-hash signature of COORDINATES values. Documents are
posted under each (coordinate, value). Two documents are candidates if at least MATCHES values are equal. For that they must
meet in a prefix: with each document's values ordered from rare to frequent, one of the first COORDINATES - MATCHES + 1.
Only those are merged; the other, frequent lists are skipped, and a candidate's collisions are counted from the signatures.
Links are then confirmed on the whole sets, and components are taken of the links. Before that an odd sketch of the sets
(one parity bit per hash value) rules pairs out: the bits in which two sketches differ never exceed the shingles that
only one of the sets has, so no link can be lost by it.

Scale and skew:
* Equal sets are one class, found by a grouping that aggregates before its shuffle; only a class's first document goes on.
* A value that no other class has needs no posting, and the most frequent values of a document are outside its prefix, so a
  passage that many documents share doesn't join them all.
* The members of a list are first linked to the list's pivots (its smallest id, and the one that shares most values, which is
  the likely original of copies), which is linear in the list. Only classes that still lie in
  different components afterwards are paired, and only with those of their list outside their component. A large group of
  near copies is therefore joined by its pivot and never paired with itself. No link between components is lost.
* All else are joins on ids or values, which Spark splits when skewed. Nothing is collected; lineage is cut by written tables.

Defined cases: null text, or text without words, has no shingles, is in no group and is kept. Fewer than five words: the
whole sequence is the one shingle. Rows that share an id are one document: their links count together. A null id is in no
group, component_id null. Ties: the smallest id is kept. Other columns are not read. An empty table gives an empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import joined, mixed, row_slices, rows_to_batch, small_batches, span_hashes, text_slices
from taleweave.llm.lineage import broadcast_if_small, join_hot, stored

WORDS = 5
#: Values of a signature, and how many must be equal. At likeness 0.85, 17 of 32 or fewer are equal once in 20,000 pairs.
COORDINATES, MATCHES = 32, 18
#: Links: 100 * shared >= PERCENT * all.
PERCENT = 85
#: Bits of the odd sketch.
BITS = 2048

_RANDOM = np.random.default_rng(20240607)
_PLACE = _RANDOM.integers(1, 2**62, WORDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_XOR = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64)
_TIMES = _RANDOM.integers(1, 2**62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True

FEATURES = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_id", pa.string()), ("tokens", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def shingle_sets(rows: list[bytes]) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text (UTF-8), A-Z lower-cased, words between white space."""
    data, starts = joined([r.lower() for r in rows])
    word = ~_SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], word)).astype(np.int8)))
    first, last = edge[0::2], edge[1::2]  # the separator ends the last word
    hashes = span_hashes(data, first, last)
    bounds = np.searchsorted(first, starts)
    if len(hashes) >= WORDS:
        runs = sum(hashes[k : len(hashes) - WORDS + 1 + k] * _PLACE[k] for k in range(WORDS))
        runs = mixed(runs)
    else:
        runs = hashes[:0]
    sets = []
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            sets.append(np.unique(runs[a : b - WORDS + 1]))
        elif b > a:
            sets.append(mixed(np.array([(hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)])))
        else:
            sets.append(hashes[:0])
    return sets


def signature(shingles: np.ndarray) -> np.ndarray:
    """For each coordinate the least hash, marked with its coordinate."""
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 4096):
        part = (shingles[i : i + 4096, None] ^ _XOR) * _TIMES
        least = np.minimum(least, part.min(axis=0))
    return mixed(least + np.arange(COORDINATES, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def odd_sketch(shingles: np.ndarray) -> np.ndarray:
    """For each of BITS places whether an odd number of hashes falls there."""
    places = np.bincount(((shingles >> np.uint64(20)) % np.uint64(BITS)).astype(np.int64), minlength=BITS)
    return np.packbits((places & 1).astype(np.uint8)).view(np.int64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared > 0 and 100 * shared >= percent * (len(a) + len(b) - shared)


def features(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_id (a 128-bit digest of the set) and tokens (the signature) of each row."""

    def run(batches):
        import xxhash

        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows in text_slices(batch):
                sets = shingle_sets(rows)
                yield rows_to_batch(FEATURES, {
                    "doc_id": ids.slice(first, len(rows)), "n_shingles": [len(s) for s in sets], "set_id": [xxhash.xxh3_128_hexdigest(s.tobytes()) for s in sets],
                    "tokens": [signature(s).view(np.int64) if len(s) else None for s in sets], "sketch": [odd_sketch(s) if len(s) else None for s in sets],
                })

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, set_id string, tokens array<long>, sketch array<long>")


def prefix_postings(sets: DataFrame, matches: int = MATCHES) -> DataFrame:
    """(token, id, held, prefix) under which a class can meet another that shares so many tokens with it; held: how many of its tokens others have."""
    posts = sets.select("id", F.explode("tokens").alias("token"))
    shared = stored(posts.groupBy("token").agg(F.count("*").alias("posted")).where("posted > 1"))
    rare_first = Window.partitionBy("id").orderBy("posted", "token")
    every = Window.partitionBy("id")
    held = join_hot(posts, shared, "token", "posted").withColumn("nth", F.row_number().over(rare_first)).withColumn("held", F.count("*").over(every))
    # Tokens of its own come first in a document's order; then these, up to the matches - 1 most frequent.
    kept = held.where(F.col("nth") <= F.col("held") - (matches - 1))
    return kept.select("token", "id", "held", F.collect_list("token").over(every).alias("prefix"))  # at most COORDINATES rows a window


def alike(a: str, b: str, percent: int = PERCENT, matches: int = MATCHES):
    """Whether two classes are candidates: sizes that allow a link, sketches that allow it, then enough equal tokens."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    apart = sum((F.bit_count(F.col(f"{a}.sketch")[i].bitwiseXOR(F.col(f"{b}.sketch")[i])) for i in range(1, BITS // 64)), F.bit_count(F.col(f"{a}.sketch")[0].bitwiseXOR(F.col(f"{b}.sketch")[0])))
    # Of na + nb - shared shingles, na + nb - 2 shared are in one set alone; linked sets have shared >= percent / 100 of all.
    return (
        (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & ((100 + percent) * apart <= (100 - percent) * (na + nb))
        & (F.size(F.array_intersect(f"{a}.tokens", f"{b}.tokens")) >= matches)
    )


def confirmed(pairs: DataFrame, docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose whole shingle sets are linked. Texts of the pairs' documents alone are moved."""
    ids = stored(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    texts = docs.select("doc_id", "text").join(broadcast_if_small(ids), "doc_id", "left_semi")
    both = pairs.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")

    def run(batches):
        held = (None, None)  # the pivot's set, while its pairs follow each other
        for batch in batches:
            for _, part in row_slices(batch, ["text_a", "text_b"]):
                kept = []
                for a, b in zip(part.column("text_a").to_pylist(), part.column("text_b").to_pylist()):
                    if held[0] != a:
                        held = (a, shingle_sets([a.encode()])[0])
                    kept.append(linked(held[1], shingle_sets([b.encode()])[0], percent))
                yield part.select(["a", "b"]).filter(pa.array(kept, type=pa.bool_()))

    return small_batches(both).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ids in links (a, b); component is the smallest id reachable.

    Large star and small star in turn: each round hangs neighbours on the smallest one, until all hang on their root.
    """
    edges = stored(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()  # large star
        low = hung.groupBy("u").agg(F.min("v").alias("m"))
        edges = stored(hung.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct())  # small star
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.union(edges.select("v", "v")).groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
        state = now


def class_links(sets: DataFrame, docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """(id, component) of classes (id, n, tokens, sketch) that are linked with others."""
    posts = stored(prefix_postings(sets, matches))
    pivots = stored(posts.groupBy("token").agg(F.min("id").alias("low"), F.max(F.struct("held", "id")).alias("top"), F.count("*").alias("members")).where("members > 1"))
    near = join_hot(posts.select("token", "id"), pivots.select("token", "members", F.array_distinct(F.array("low", "top.id")).alias("pivots")), "token", "members")
    near = near.select("id", F.explode("pivots").alias("pivot")).where("id != pivot")
    pairs = near.select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    sides = sets.select("id", "n", "tokens", "sketch")
    stars = pairs.join(sides.alias("y"), F.col("b") == F.col("y.id")).join(sides.alias("x"), F.col("a") == F.col("x.id")).where(alike("x", "y", percent, matches))
    first = stored(confirmed(stored(stars.select("a", "b")), docs, percent))
    labels = components(first)
    # What still lies apart in a list: its members outside the list's largest component, with all members of other components.
    apart = posts.join(labels, "id", "left").withColumn("component", F.coalesce("component", "id"))
    counts = apart.groupBy("token", "component").agg(F.count("*").alias("members"))
    mixed_lists = counts.groupBy("token").agg(F.max_by("component", F.struct("members", "component")).alias("most"), F.count("*").alias("parts")).where("parts > 1").select("token", "most")
    lists = stored(apart.join(mixed_lists, "token").join(sides, "id"))
    x, y = lists.where("component != most").alias("x"), lists.alias("y")
    once = (F.col("y.component") == F.col("y.most")) | (F.col("x.id") < F.col("y.id"))
    here = F.col("x.token") == F.array_min(F.array_intersect("x.prefix", "y.prefix"))  # of the lists that two share, one pairs them
    rest = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.component") != F.col("y.component")) & once & alike("x", "y", percent, matches) & here)
    more = stored(rest.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct())
    if more.isEmpty():
        return labels
    return components(first.union(confirmed(more, docs, percent)))


def near_duplicates(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row, for links of a likeness of percent; of linked documents, matches values must be equal."""
    held = stored(features(docs))
    classes = held.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("id"), F.min_by(F.struct("tokens", "sketch"), "doc_id").alias("s"), F.first("n_shingles").alias("n")).select("set_id", "id", "n", "s.tokens", "s.sketch")
    sets = stored(classes)
    # An id with several texts is in several classes: they are one.
    ids = held.where("n_shingles > 0 and doc_id is not null").select("doc_id", "set_id").distinct()
    rows = stored(ids.join(sets.select("set_id", "id"), "set_id"))
    several = rows.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("a", "b")
    labels = class_links(sets.select("id", "n", "tokens", "sketch"), docs, percent, matches)
    if not several.isEmpty():
        labels = components(labels.select(F.col("id").alias("a"), F.col("component").alias("b")).union(several))
    found = rows.join(labels, "id", "left").select("doc_id", F.coalesce("component", "id").alias("component_id")).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))
    return held.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce(F.col("doc_id") == F.coalesce("component_id", "doc_id"), F.lit(True)).alias("kept")
    )


def keep_first(docs: DataFrame, percent: int = PERCENT, matches: int = MATCHES) -> DataFrame:
    """One document of each group of near duplicates, with all columns: the one with the smallest id; of rows with that id, one with the smallest text."""
    found = near_duplicates(docs, percent, matches)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(broadcast_if_small(stored(dropped)), "doc_id", "left_anti").select(docs.columns)
    repeated = docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null")
    if repeated.isEmpty():
        return kept
    rows = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    again = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(rows, F.struct(F.col("text"), F.xxhash64(*(F.col(f"`{c}`") for c in docs.columns)))).alias("__row")).select("__row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(again).select(docs.columns)
