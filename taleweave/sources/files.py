"""Small file formats around books: preset catalogues, timing sidecars, storage listings, database tables."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from taleweave.functions.speech import words

PRESETS = "narrators array<struct<id:string,name:string,description:string,ref:string,params:map<string,double>>>"
SIDECAR = "duration double, chunks array<struct<text:string,start:double,end:double,words:array<struct<text:string,start:double,end:double>>>>"
SIDECAR_FIELDS = "duration:double,chunks:array<struct<text:string,start:double,end:double,words:array<struct<text:string,start:double,end:double>>>>"


def presets(catalogues: DataFrame, files: DataFrame, column: str = "value") -> DataFrame:
    """(id, name, description, ref, params) of catalogue documents (JSON text); entries without id, name or their clip are left out.

    files: (ref) of the clips that are there. A document that can't be read has no entries.
    """
    held = catalogues.select(F.explode(F.from_json(column, PRESETS)["narrators"]).alias("n")).select("n.*")
    named = held.where((F.coalesce("id", F.lit("")) != "") & (F.coalesce("name", F.lit("")) != ""))
    there = named.where("ref is not null").join(files.select("ref").distinct(), "ref", "left_semi").select(named.columns)
    kept = there.unionByName(named.where("ref is null"))
    none = F.create_map().cast("map<string,double>")
    return kept.select("id", "name", F.coalesce("description", F.lit("")).alias("description"), "ref", F.coalesce("params", none).alias("params"))


def sidecars(texts: DataFrame, keys: list[str], column: str = "value") -> DataFrame:
    """keys, timing: the parsed sidecar, null for one that is missing or malformed."""
    parsed = F.from_json(column, SIDECAR, {"mode": "PERMISSIVE"})
    return texts.select(*keys, F.when(parsed["duration"].isNotNull(), parsed).alias("timing"))


def sidecar_chunks(timed: DataFrame, keys: list[str]) -> DataFrame:
    """keys, chunk_no, text, start, end and words of the sidecars that could be read."""
    held = timed.where("timing is not null").select(*keys, F.posexplode("timing.chunks").alias("chunk_no", "c"))
    return held.select(*keys, "chunk_no", "c.*")


def with_words(timed: DataFrame) -> DataFrame:
    """Timing rows whose chunks without words get them, at equal shares of the duration."""
    def spread(c):
        texts = words(c["text"])
        share = F.col("timing.duration") / F.size(texts)
        made = F.transform(texts, lambda w, i: F.struct(w.alias("text"), (c["start"] + i * share).alias("start"), (c["start"] + (i + 1) * share).alias("end")))
        return c.withField("words", F.coalesce(c["words"], made))

    return timed.withColumn("timing", F.col("timing").withField("chunks", F.transform("timing.chunks", spread)))


def write_sidecars(rows: DataFrame, folder: str) -> None:
    """Timing rows by book and chapter; only the partitions written are replaced."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("book_id", "chapter_index").json(folder)


def storage(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """(path, length) of the files under a folder; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length")


def storage_totals(files: DataFrame) -> DataFrame:
    """(job, kind, bytes): bytes by job and kind, by job, and of all. A path is .../kind/job/..."""
    named = files.select(F.regexp_extract("path", r"(output|upload)s?/([^/]+)/", 2).alias("job"), F.regexp_extract("path", r"(output|upload)s?/([^/]+)/", 1).alias("kind"), "length").where("job <> ''")
    return named.rollup("job", "kind").agg(F.sum("length").alias("bytes"))


def database_table(spark: SparkSession, url: str, table: str, columns: list[str], **options) -> DataFrame:
    """Some columns of a table of an existing database; the database reads no others."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load().select(*columns)
