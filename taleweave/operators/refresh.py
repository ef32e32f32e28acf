"""Incremental recompute: what is stored, what is stale, what is left to do."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def complete_chapters(segments: DataFrame, book: str, chapter: str) -> DataFrame:
    """Chapters per book, and how many have every expected segment present (a boolean column `present`)."""
    chapters = segments.groupBy(book, chapter).agg(F.bool_and("present").alias("done"))
    return chapters.groupBy(book).agg(F.count_if("done").alias("chapters_done"), F.count("*").alias("chapters"))


def stale_chapters(want: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """keys, stale: whether a chapter's stored parts can't be used.

    want, have: keys, part, sig. Stale are parts signed otherwise, unsigned parts that are not just all the expected ones, and
    any part beyond the expected ones. A chapter of which nothing is stored is not stale.
    """
    expected = want.groupBy(*keys).agg(F.count("*").alias("n"), F.min("sig").alias("w"))
    stored = have.groupBy(*keys).agg(F.max("part").alias("top"), F.min("part").alias("low"), F.count_distinct("part").alias("parts"), F.bool_or(F.col("sig").isNotNull()).alias("signed"), F.min("sig").alias("h"))
    whole = (F.col("parts") == F.col("n")) & (F.col("low") == 0) & (F.col("top") == F.col("n") - 1)
    stale = (F.col("signed") & ~F.col("h").eqNullSafe(F.col("w"))) | (~F.col("signed") & ~whole) | (F.col("top") >= F.col("n"))
    return expected.join(stored, keys, "left").select(*keys, F.coalesce(stale, F.lit(False)).alias("stale"))


def to_do(want: DataFrame, have: DataFrame, keys: list[str]) -> DataFrame:
    """Parts that must be made: all of a stale chapter, else those that are missing."""
    judged = want.select(*keys, "part").join(stale_chapters(want, have, keys), keys)
    stored = have.select(*keys, "part", F.lit(True).alias("_stored")).distinct()
    return judged.join(stored, [*keys, "part"], "left").where(F.col("stale") | F.col("_stored").isNull()).drop("_stored")


def usable(listing: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Stored segments that count: the file has bytes and holds frames."""
    return listing.where("length > 0").join(frames.where("frames > 0"), keys, "left_semi").select(*keys)


def append_missing(source: DataFrame, target: DataFrame, key: list[str]) -> DataFrame:
    """Rows of source that target hasn't; nothing that is there is overwritten."""
    return source.join(target, key, "left_anti")
