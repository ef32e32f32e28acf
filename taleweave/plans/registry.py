"""Queries by name, each with the SQL that gives the same rows where SQL can."""

from pyspark.sql import functions as F

from taleweave.operators.partitioning import spread

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Tables of long texts, on which most work is done per row, and their keys.
TEXTS = {"documents": "doc_id", "pages": "page_id"}


#: The book that a document stands in as a chapter: about fifty neighbours of a source, whatever the table's size.
BOOK = "source || '/' || (doc_id // 1000)"


def book_key(name: str = "book"):
    return F.concat("source", F.lit("/"), F.floor(F.col("doc_id") / 1000).cast("string")).alias(name)


def reader(spark, sf_dir):
    """A function that reads a table of the folder by name."""

    def table(name):
        held = spark.read.parquet(f"{sf_dir}/{name}.parquet")
        return spread(held, TEXTS[name]) if name in TEXTS else held

    table.path = lambda name: f"{sf_dir}/{name}.parquet"  # for streams, which read files
    return table


def query(name: str, sql: str | None = None):
    """Registers a function of (t, spark) under a name; t(table) reads a table of the folder."""

    def put(f):
        QUERIES[name] = lambda spark, sf_dir: f(reader(spark, sf_dir))
        if sql:
            SQL[name] = sql
        return f

    return put
