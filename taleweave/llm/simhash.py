"""Near-duplicate documents by SimHash: multi-index hashing over fingerprint segments.

Method: each three-word shingle of a text, repeats included, has a 64-bit XXH64 hash; a bit of the text's fingerprint is one where more than half of
the hashes have it. Two fingerprints are linked if they differ in at most DISTANCE = 2 bits. Cut in two segments of 32 bits, linked
ones differ in at most one bit of one segment. So all fingerprints are kept in two tables, by each segment, and each one looks up the
ball of radius one around its own segment in both; what the tables give is verified on all 64 bits. Of two values that differ
in one bit, the one with the smaller value looks the other up, so a pair is fetched once per segment.

Scale and skew:
* Equal fingerprints are one class, by a grouping that aggregates before its shuffle; copies, however many, are one entry.
* A segment value held by more than HOT_SEGMENT fingerprints (versions of one form, say) is hot. There the other segment isn't
  compared pair by pair but looked up by its ball too: a fingerprint that shares the hot value posts the 33 values of its other
  segment's ball, and two within two bits meet in one of them, where at most 33 fingerprints can stand; one whose segment
  is a bit off looks for the 33 values themselves. A hot value's work is thus linear in its fingerprints, and no link is lost.
* All joins are on 64-bit keys; nothing is collected, and lineage is cut by written tables.

Defined cases: null or empty text, or text without words, has fingerprint zero and is linked as any other. Fewer than three words: the
whole sequence is the one shingle. Rows that share an id are one document: their links count together. A null id has a fingerprint, but component_id
null, and links nothing. Very long texts are read whole, their hashes summed in blocks. Repeated rows give repeated
results. Other columns are not read, whatever their names. An empty table gives an empty one.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import rows_to_batch, text_slices
from taleweave.llm.lineage import stored
from taleweave.llm.neardup import components

WORDS, SEED = 3, 42
DISTANCE = 2
#: A segment value of more fingerprints than this is hot.
HOT_SEGMENT = 128
#: Hashes are counted bit by bit in blocks of this many.
BLOCK = 1 << 14

FEATURES = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.int64())])


def shingle_hashes(text: bytes) -> np.ndarray:
    """XXH64 of each shingle of a text (UTF-8), A-Z lower-cased, repeats included."""
    import xxhash

    words = text.lower().split()  # bytes: ASCII letters and white space alone
    if len(words) < WORDS:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], dtype=np.uint64)
    spaced = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.concatenate(([0], ends[: -WORDS])).tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(spaced[a:b], SEED) for a, b in zip(starts, (ends[WORDS - 1 :] - 1).tolist())], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[i : i + BLOCK]).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


def features(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint (its 64 bits as a signed long) of each row."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows in text_slices(batch):
                codes = np.array([fingerprint(shingle_hashes(r)) for r in rows], dtype=np.uint64).view(np.int64)
                yield rows_to_batch(FEATURES, {"doc_id": ids.slice(first, len(rows)), "fingerprint": codes})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, fingerprint long")


def segment(code: str, side: int) -> Column:
    """A fingerprint's upper (0) or lower (1) 32 bits."""
    return F.shiftrightunsigned(code, 32) if side == 0 else F.col(code).bitwiseAND(F.lit(0xFFFFFFFF))


def ball(value: str, centre: bool = True, larger: bool = False) -> Column:
    """The 32-bit values within one bit of a value; larger: of those beside it only the larger ones."""
    one_off = f"transform(sequence(0, 31), k -> {value} ^ shiftleft(1L, k))"
    if larger:
        one_off = f"filter({one_off}, v -> v > {value})"
    return F.expr(f"concat(array({value}), {one_off})" if centre else one_off)


def links(codes: DataFrame) -> DataFrame:
    """(a, b): links that join all fingerprints (column code, each once) that differ in at most DISTANCE bits; some more than once."""
    found = []
    for side in (0, 1):
        sides = codes.select("code", segment("code", side).alias("own"), segment("code", 1 - side).alias("other"))
        counts = sides.groupBy("own").agg(F.count("*").alias("members"))
        hot = stored(counts.where(F.col("members") > HOT_SEGMENT).select("own"))
        table = sides.join(hot, "own", "left_anti").select(F.col("own").alias("key"), F.col("code").alias("b"))
        probes = sides.select(F.col("code").alias("a"), "own", "other", F.explode(ball("own", larger=True)).alias("key"))
        near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
        fetched = probes.select("key", "a").join(table, "key").where(near & ((F.col("key") != segment("a", side)) | (F.col("a") < F.col("b"))))
        found.append(fetched.select("a", "b"))
        if hot.isEmpty():
            continue
        # Both in a hot value: they meet in the ball of the other segment, whose members are all within two bits of each other.
        inside = sides.join(hot, "own").select("own", "code", F.explode(ball("other")).alias("meet"))
        met = inside.groupBy("own", "meet").agg(F.min("code").alias("a"), F.collect_list("code").alias("b")).where("size(b) > 1")
        found.append(met.select("a", F.explode("b").alias("b")).where("a != b"))
        # One bit away from a hot value: the other segment is at most one bit away too.
        beside = probes.where("key != own").join(hot.select(F.col("own").alias("key")), "key").select("a", "key", F.explode(ball("other")).alias("rest"))
        members = sides.join(hot, "own").select(F.col("own").alias("key"), F.col("other").alias("rest"), F.col("code").alias("b"))
        found.append(beside.join(members, ["key", "rest"]).select("a", "b"))
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.union(more)
    return pairs


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 lowercase hex digits) and component_id, the smallest doc_id reachable over links, of each row."""
    held = stored(features(docs))
    classes = stored(held.where("doc_id is not null").groupBy(F.col("fingerprint").alias("code")).agg(F.min("doc_id").alias("id")))
    of_code = classes.select("code", "id")
    pairs = stored(links(classes.select("code")))
    by_id = pairs.join(of_code.select(F.col("code").alias("a"), F.col("id").alias("u")), "a").join(of_code.select(F.col("code").alias("b"), F.col("id").alias("v")), "b").select(F.col("u").alias("a"), F.col("v").alias("b"))
    # Rows of one id with several fingerprints are one document, so their classes are one.
    ids = held.where("doc_id is not null").join(of_code, held.fingerprint == of_code.code).select("doc_id", "id").distinct()
    lowest = ids.groupBy("doc_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select("doc_id", "a")
    several = ids.join(lowest, "doc_id").where("a != id").select("a", F.col("id").alias("b"))
    labels = components(by_id.union(several).distinct())
    of_class = of_code.join(labels, "id", "left").select(F.col("code").alias("fingerprint"), F.coalesce("component", "id").alias("component_id"))
    rows = held.where("doc_id is not null").join(of_class, "fingerprint").unionByName(held.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
