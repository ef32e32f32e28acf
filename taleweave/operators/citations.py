"""References in parentheses: every one found in its place, with counts and examples per book."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.speech import CITED, pre_clean, words

CONTEXT, EXAMPLES = 60, 300
#: A code point that is no character, so that no text has it.
_MARK = "\ufdd0"


def find_citations(docs: DataFrame, keys: list[str], text: str = "text", context: int = CONTEXT) -> DataFrame:
    """keys, occurrence (from 1), citation, before, after: what dropping citations removes from the pre-cleaned text, with context."""
    clean = docs.where(F.contains(text, F.lit("("))).select(*keys, F.translate(pre_clean(F.col(text)), _MARK, "").alias("_t"))
    parts = clean.withColumn("_p", F.split(F.regexp_replace("_t", CITED, f"{_MARK}$0{_MARK}"), _MARK)).where(F.size("_p") > 1)
    ends = F.transform("_p", F.length)
    held = parts.select(*keys, "_t", F.posexplode("_p").alias("_n", "citation"), ends.alias("_e")).where(F.col("_n") % 2 == 1)
    at = F.aggregate(F.slice("_e", F.lit(1), F.col("_n")), F.lit(0), lambda a, x: a + x)
    spaced = lambda c: F.array_join(words(c), " ")
    return held.withColumn("_at", at).select(
        *keys, ((F.col("_n") + 1) / 2).cast("long").alias("occurrence"), "citation",
        spaced(F.substring("_t", F.greatest(F.col("_at") - context, F.lit(0)) + 1, F.least(F.col("_at"), F.lit(context)))).alias("before"),
        spaced(F.substring("_t", F.col("_at") + F.length("citation") + 1, F.lit(context))).alias("after"),
    )


def counts(found: DataFrame, book: str, chapter: str, shown: int = EXAMPLES) -> DataFrame:
    return found.groupBy(book).agg(F.count("*").alias("citations"), F.count_distinct(chapter).alias("chapters"), (F.count("*") > shown).alias("truncated"))


def first_examples(found: DataFrame, book: str, chapter: str, n: int = EXAMPLES) -> DataFrame:
    """The first n of each book in chapter and text order."""
    order = Window.partitionBy(book).orderBy(chapter, "occurrence")
    return found.withColumn("_nth", F.row_number().over(order)).where(F.col("_nth") <= n).drop("_nth")


def selected_total(found: DataFrame, chosen: DataFrame, chapter: str, book: str) -> DataFrame:
    """Citations per book in the chosen chapters alone."""
    return found.join(chosen, chapter, "left_semi").groupBy(book).agg(F.count("*").alias("citations"))
