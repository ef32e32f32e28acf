"""Books from their parts: spine, contents, titles, plans, presets, covers."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.functions.speech import base_name, derive_title, is_front_matter


def spine_documents(spine: DataFrame, manifest: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents in spine order; items that are missing from the manifest or the archive are skipped."""
    return spine.join(manifest.select("book_id", "idref", "href"), ["book_id", "idref"]).join(documents, ["book_id", "href"])


def contents_titles(toc: DataFrame) -> DataFrame:
    """(book_id, href, title): the first entry of each file, fragments aside."""
    path = F.substring_index("href", "#", 1)
    named = toc.where((F.coalesce("href", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != "")).withColumn("href", path)
    return named.groupBy("book_id", "href").agg(F.min_by("title", "ord").alias("title"), F.min("ord").alias("ord")).withColumn("title", F.trim("title"))


def with_contents_titles(documents: DataFrame, toc: DataFrame) -> DataFrame:
    """documents with toc_title: by path, else by file name; the first entry wins."""
    exact = contents_titles(toc)
    by_name = exact.groupBy("book_id", base_name(F.col("href")).alias("_base")).agg(F.min_by("title", "ord").alias("_by_name"))
    held = documents.join(exact.select("book_id", "href", F.col("title").alias("_exact")), ["book_id", "href"], "left").withColumn("_base", base_name(F.col("href")))
    return held.join(by_name, ["book_id", "_base"], "left").withColumn("toc_title", F.coalesce("_exact", "_by_name")).drop("_exact", "_by_name", "_base")


def resolve_titles(documents: DataFrame, order: str, shortest: int = 200) -> DataFrame:
    """Chapters: long enough documents, numbered, titled from contents, heading, opening words or number, with the source and a front-matter flag."""
    kept = documents.where(F.length("text") >= shortest)
    number = F.row_number().over(Window.partitionBy("book_id").orderBy(order))
    present = lambda c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c))
    held = kept.withColumn("index", (number - 1).cast("long")).withColumn("_derived", derive_title(F.col("text")))
    toc, heading, derived = present("toc_title"), present("heading"), present("_derived")
    held = held.withColumn("title", F.coalesce(toc, heading, derived, F.concat(F.lit("Section "), (F.col("index") + 1).cast("string"))))
    source = F.when(toc.isNotNull(), "toc").when(heading.isNotNull(), "heading").when(derived.isNotNull(), "derived").otherwise("generic")
    return held.withColumn("source", source).withColumn("front_matter", is_front_matter(F.col("title"))).drop("_derived")


def apply_plan(chapters: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """Chapters with the reviewed plan: no entry is included, a title that isn't empty overrides."""
    entry = plan.select(*keys, F.col("include").alias("_include"), F.col("title").alias("_title"))
    held = chapters.join(entry, keys, "left").where(F.coalesce("_include", F.lit(True)))
    position = F.row_number().over(Window.partitionBy(keys[0]).orderBy(keys[1])) - 1
    return held.withColumn("title", F.coalesce(F.when(F.trim("_title") != "", F.col("_title")), "title")).withColumn("position", position.cast("long")).drop("_include", "_title")


def plan_changes(recorded: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    """keys, change: `narrate` for what is included now and not recorded, `dropped` for what is recorded and excluded now."""
    included = plan.where(F.coalesce("include", F.lit(True))).select(*keys)
    new = included.join(recorded, keys, "left_anti").withColumn("change", F.lit("narrate"))
    return new.unionByName(recorded.select(*keys).join(included, keys, "left_anti").withColumn("change", F.lit("dropped")))


def with_presets(jobs: DataFrame, presets: DataFrame, key: str) -> DataFrame:
    """Jobs with their preset's name; found is false for an unknown one. `custom` needs none."""
    held = jobs.join(presets.select(F.col("id").alias(key), "name"), key, "left")
    return held.withColumn("found", F.col("name").isNotNull() | (F.col(key) == "custom"))


def upsert(existing: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """New entries in place of those with their key; all others stay."""
    return existing.join(new, key, "left_anti").unionByName(new)


def prefer_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Both, with first's entry where both have a key."""
    return first.unionByName(second.join(first, key, "left_anti"))


def preview_coverage(presets: DataFrame, previews: DataFrame, key: str = "id") -> DataFrame:
    here = previews.select(key).distinct().withColumn("_here", F.lit(True))
    return presets.join(here, key, "left").withColumn("has_preview", F.coalesce("_here", F.lit(False))).drop("_here")


def cover_score(name: Column) -> Column:
    stem = F.lower(F.regexp_replace(base_name(name), r"\.[^.]*$", ""))
    return F.when(stem == "cover", 3).when(F.startswith(stem, F.lit("cover")), 2).when(F.contains(stem, F.lit("cover")) & ~F.contains(stem, F.lit("back")), 1).otherwise(0)


def best_cover(declared: DataFrame, meta: DataFrame, guide: DataFrame, images: DataFrame) -> DataFrame:
    """(book_id, href, rank): the declared cover, else what the metadata name, else the guide's first image, else the best file name. Inputs: book_id, ord, href."""
    named = images.withColumn("_score", cover_score(F.col("href"))).where("_score > 0")
    ranked = [declared.withColumn("rank", F.lit(0)), meta.withColumn("rank", F.lit(1)), guide.withColumn("rank", F.lit(2)), named.withColumn("rank", 6 - F.col("_score")).drop("_score")]
    every = ranked[0]
    for more in ranked[1:]:
        every = every.unionByName(more)
    return every.groupBy("book_id").agg(F.min(F.struct("rank", "ord", "href")).alias("b")).select("book_id", F.col("b.href").alias("href"), F.col("b.rank").alias("rank"))


def evolve(old: DataFrame, new: DataFrame, defaults: dict) -> DataFrame:
    """Rows of both schemas; columns that a side lacks are null, or their default."""
    both = old.unionByName(new, allowMissingColumns=True)
    return both.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def job_list(jobs: DataFrame, columns: list[str]) -> DataFrame:
    """Listed columns, and whether timings and output are there; the timings themselves are not read."""
    return jobs.select(*columns, F.col("timings").isNotNull().alias("has_timings"), F.col("output_path").isNotNull().alias("has_output"))


def timed_chapters(jobs: DataFrame, key: str) -> DataFrame:
    """Only the chapters of the timings, empty where there are none."""
    inner = jobs.schema["timings"].dataType["chapters"].dataType
    return jobs.select(key, F.coalesce("timings.chapters", F.array().cast(inner)).alias("chapters"))
