"""Canonical exact digests and the groups of equal documents.

Method: a text is brought to NFKC, case-folded and normalised again, its white space folded to single spaces and trimmed;
the 128-bit xxh3 of its UTF-8 is the fingerprint. Documents are grouped by fingerprint, and inside a bucket of equal
fingerprints the canonical texts are compared byte by byte.

Scale: the fingerprint is a map. Grouping counts before its shuffle, and only buckets of two and more compare texts: each task
keeps the least and greatest of a bucket, so that a hot bucket moves two texts a task. Groups join the documents by their
fingerprint: sent to executors if measured and small. The next document is found within ranges of ids, whose number follows the
shuffle partitions.

Defined cases: null text is the empty text; all texts of white space alone have the fingerprint of the empty text. Null ids
order first and are in no group. Rows that share an id order by fingerprint, then compressed bytes, and equal rows have equal
results but for the last of them. Very long texts are read whole. Other columns are not read. An empty table gives an empty one.
"""

import hashlib
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.llm.arrow_text import row_slices, rows_to_batch, small_batches, text_slices
from taleweave.llm.lineage import broadcast_if_small, join_hot, stored


def canonical(text: str | None) -> str:
    """NFKC, case folded, white space folded."""
    if not text:
        return ""
    if text.isascii():
        return " ".join(text.lower().split())
    folded = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split())


def fingerprint(text: str | None) -> str:
    import xxhash

    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def likeness(a, b):
    """An exact digest is like another (1) or not (0)."""
    return F.when(a == b, 1.0).otherwise(0.0)


def exact_groups(prints: DataFrame, docs: DataFrame, digest=fingerprint) -> DataFrame:
    """(fingerprint, canon_sha256, group_id, group_size) of the groups of two and more documents whose canonical texts are equal byte by byte.

    prints: doc_id, fingerprint of docs, by digest. group_id is the smallest doc_id of the group, group_size its rows. The bytes of a
    bucket are compared with each other by its least and its greatest text, in each task before the shuffle, so that a hot bucket moves
    one text a task. If they are equal, the bucket is one group and canon_sha256 is null; else (a collision) it is as many as it has texts.
    """
    buckets = stored(prints.where("doc_id is not null").groupBy("fingerprint").agg(F.count("*").alias("members")).where("members > 1"))
    ids = stored(join_hot(prints.where("doc_id is not null"), buckets, "fingerprint", "members").select("doc_id").distinct())
    texts = canonical_texts(docs.join(broadcast_if_small(ids), "doc_id", "left_semi"), digest)
    ends = stored(texts.groupBy("fingerprint").agg(F.min("canon").alias("least"), F.max("canon").alias("most"), F.min("doc_id").alias("group_id"), F.count("*").alias("group_size")).withColumn("same", F.col("least") == F.col("most")))
    groups = ends.where("same and group_size > 1").select("fingerprint", F.lit(None).cast("string").alias("canon_sha256"), "group_id", "group_size")
    several = ends.where("not same").select("fingerprint")
    if several.isEmpty():
        return groups
    apart = texts.join(broadcast_if_small(several), "fingerprint").groupBy("fingerprint", "canon").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("group_size"))
    return groups.unionByName(apart.select("fingerprint", F.sha2("canon", 256).alias("canon_sha256"), "group_id", "group_size"))


def canonical_texts(docs: DataFrame, digest=fingerprint) -> DataFrame:
    """doc_id, fingerprint, canon of each document."""

    def run(batches):
        for batch in batches:
            ids = batch.column("doc_id")
            for first, rows in text_slices(batch):
                texts = [r.decode() for r in rows]
                yield rows_to_batch(_CANON, {"doc_id": ids.slice(first, len(rows)), "fingerprint": list(map(digest, texts)), "canon": list(map(canonical, texts))})

    return small_batches(docs).select("doc_id", "text").mapInArrow(run, "doc_id long, fingerprint string, canon string")


def with_groups(prints: DataFrame, docs: DataFrame, digest=fingerprint) -> DataFrame:
    """prints (doc_id, fingerprint, ...) with group_id and group_size."""
    groups = stored(exact_groups(prints.select("doc_id", "fingerprint"), docs, digest))
    whole, apart = groups.where("canon_sha256 is null").drop("canon_sha256"), groups.where("canon_sha256 is not null")
    found = prints.join(broadcast_if_small(whole), "fingerprint", "left")
    if not apart.isEmpty():  # documents of buckets in which hashes collide are told apart by their texts
        texts = canonical_texts(docs.join(prints.join(apart.select("fingerprint").distinct(), "fingerprint", "left_semi").select("doc_id").distinct(), "doc_id", "left_semi"), digest)
        own = texts.select("doc_id", "fingerprint", F.sha2("canon", 256).alias("canon_sha256")).join(apart, ["fingerprint", "canon_sha256"]).groupBy("doc_id", "fingerprint").agg(F.min("group_id").alias("g"), F.max("group_size").alias("s"))
        found = found.join(own, ["doc_id", "fingerprint"], "left").withColumns({"group_id": F.coalesce("group_id", "g"), "group_size": F.coalesce("group_size", "s")}).drop("g", "s")
    grouped = F.col("doc_id").isNotNull()
    return found.withColumns({"group_id": F.when(grouped, F.coalesce("group_id", "doc_id")), "group_size": F.when(grouped, F.coalesce("group_size", F.lit(1))).otherwise(1)})


def with_next(rows: DataFrame, order: str, prepare, payload: list[str]) -> DataFrame:
    """prepare(rows), each row with next_* of the payload columns, taken from the row after it in ascending order (the first after the last).

    The order is dealt into ranges that begin at ids of the table, so that a window per range is enough: a copy of each
    range's first row also goes to the range before, as the row that its last one looks ahead to. prepare maps rows and keeps
    the columns _range and _ahead; rows that share an id order by the payload.
    """
    buckets = min(100_000, 4 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # One row of at most `buckets` ids comes to the driver.
    head = rows.agg(
        F.min(order).alias("first"), F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 4 * buckets).alias("cuts"), F.count_if(F.col(order).isNull()).alias("nulls")
    ).first()
    cuts = sorted({head["first"], *(head["cuts"] or [])} - {None})
    ranged = rows.withColumn("_range", _range_of(F.col(order), cuts) if cuts else F.lit(0))
    heads = ranged.where(F.col(order).isin(cuts)) if cuts else ranged
    if head["nulls"]:  # ids that are null stand before all
        first = ranged.where(F.col(order).isNull())
        later = heads
    else:
        first = heads.where("_range = 1")
        later = heads.where("_range > 1")
    ahead = later.withColumn("_range", F.col("_range") - 1).unionByName(first.withColumn("_range", F.lit(len(cuts)))).withColumn("_ahead", F.lit(True))
    both = prepare(ranged.withColumn("_ahead", F.lit(False)).unionByName(ahead))
    window = Window.partitionBy("_range").orderBy("_ahead", F.col(order).asc_nulls_first(), *payload)
    return both.withColumns({f"next_{c}": F.lead(c).over(window) for c in payload}).where(~F.col("_ahead")).drop("_ahead", "_range")


def _range_of(value, cuts):
    """How many of the sorted cuts are <= value, by halving; 0 for null."""
    held, steps = F.lit(cuts), len(cuts).bit_length()

    def half(bounds, _):
        mid = F.floor((bounds["low"] + bounds["high"]) / 2).cast("int")
        up = F.get(held, mid) <= value
        more = bounds["low"] < bounds["high"]
        return F.struct(F.when(more & up, mid + 1).otherwise(bounds["low"]).alias("low"), F.when(more & ~up, mid).otherwise(bounds["high"]).alias("high"))

    found = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high")), half, lambda b: b["low"])
    return F.when(value.isNull(), 0).otherwise(found)


_CANON = pa.schema([("doc_id", pa.int64()), ("fingerprint", pa.string()), ("canon", pa.string())])
_PACKED = pa.schema([("doc_id", pa.int64()), ("_range", pa.int32()), ("_ahead", pa.bool_()), ("fingerprint", pa.string()), ("packed", pa.binary())])
_EDITED = pa.schema([
    ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("next_fingerprint", pa.string()),
])


def _packed(batches):
    """Fingerprints, and the texts compressed for their way through the shuffle."""
    import zstandard

    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for first, rows in text_slices(batch):
            part = batch.slice(first, len(rows))
            yield rows_to_batch(_PACKED, {
                **{c: part.column(c) for c in ("doc_id", "_range", "_ahead")}, "fingerprint": [fingerprint(r.decode()) for r in rows], "packed": [press.compress(r) for r in rows],
            })


def _edited(batches):
    import zstandard

    press = zstandard.ZstdDecompressor()
    for batch in batches:
        for _, part in row_slices(batch, ["packed", "next_packed"]):
            out = {f.name: [] for f in _EDITED}
            for doc_id, mine, packed, theirs, after in zip(*(part.column(c).to_pylist() for c in ("doc_id", "fingerprint", "packed", "next_fingerprint", "next_packed"))):
                text, following = press.decompress(packed).decode(), press.decompress(after).decode()
                quarter = len(text) // 4
                edited = text[: len(text) - quarter] + following[:quarter]
                values = (doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine, fingerprint(edited), theirs)
                for column, value in zip(out.values(), values):
                    column.append(value)
            yield rows_to_batch(_EDITED, out)


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """The fingerprint and the group of each document, and the fingerprint of its text with the last quarter replaced from the next document.

    Rows that repeat an id have equal rows in the result only if their texts are equal.
    """
    prepare = lambda rows: rows.mapInArrow(_packed, "doc_id long, _range int, _ahead boolean, fingerprint string, packed binary")
    near = with_next(docs.select("doc_id", "text"), "doc_id", prepare, ["fingerprint", "packed"])
    columns = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    prints = stored(near.mapInArrow(_edited, columns))
    return with_groups(prints, docs).select(
        "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"), "group_id", "group_size",
    )
