"""Durations accumulated into book-wide times, gaps filled, silence found, moments looked up.

Times keep full precision in tables and are rounded to milliseconds at the output. Offsets, marks, numbers and lookups over a
book are scans of two levels (scans.py), so a book may be of any size; other windows are partitioned by segment or list.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.operators import scans
from taleweave.operators.partitioning import dealt

PAUSE, SILENCE, PER_SEGMENT = 0.4, 0.30, 20


def _before(*keys, order):
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def positions(chapters: DataFrame, book: str, index: str, include: str, tasks: int | None = None) -> DataFrame:
    """The included chapters (null: included) with their position among them; the original index stays."""
    kept = chapters.where(F.coalesce(F.col(include), F.lit(True)))
    return scans.numbered(kept, [book], [index], "position", tasks=tasks)


def segment_offsets(segments: DataFrame, book: str, order: list[str], duration: str, tasks: int | None = None) -> DataFrame:
    """start and end of each segment in its book."""
    return scans.sum_before(segments, [book], order, F.col(duration).cast("double"), "start", tasks=tasks).withColumn("end", F.col("start") + F.col(duration))


def chapter_marks(offsets: DataFrame, keys: list[str], tasks: int | None = None) -> DataFrame:
    return dealt(offsets, tasks, *keys).groupBy(*keys).agg(F.min("start").alias("start"), F.max("end").alias("end"))


def parts(chunks: DataFrame, keys: list[str], order: list[str], per: int = PER_SEGMENT) -> DataFrame:
    """part of each chunk, parts of its chapter, and whether the part ends with a pause (all but the last do)."""
    window = Window.partitionBy(*keys)
    at = F.row_number().over(window.orderBy(*order)) - 1
    held = chunks.withColumn("part", F.floor(at / per)).withColumn("parts", F.ceil(F.count("*").over(window) / per))
    return held.withColumn("pause_after", F.col("part") < F.col("parts") - 1)


def fill_untimed(words: DataFrame, segment: str, number: str, clip: str = "clip_seconds") -> DataFrame:
    """Words without times: the first of a run fills the gap between its neighbours, later ones have no width at its end."""
    order = Window.partitionBy(segment).orderBy(number)
    timed = F.col("start").isNotNull()
    held = words.withColumn("_run", F.sum(timed.cast("int")).over(order))
    held = held.withColumn("_nth", F.row_number().over(Window.partitionBy(segment, "_run", timed).orderBy(number)))
    before = F.coalesce(F.last("end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    after = F.coalesce(F.first("start", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.col(clip))
    held = held.withColumn("_before", before).withColumn("_close", F.greatest(before, after))
    start = F.when(timed, F.col("start")).when(F.col("_nth") == 1, F.col("_before")).otherwise(F.col("_close"))
    return held.withColumn("end", F.when(timed, F.col("end")).otherwise(F.col("_close"))).withColumn("start", start).drop("_run", "_nth", "_before", "_close")


def sound_runs(samples: DataFrame, segment: str, place: str, silent: Column, least: int) -> DataFrame:
    """Runs of sound of each segment: (run, first, last), between silent runs of at least `least` samples."""
    order = Window.partitionBy(segment).orderBy(place)
    held = samples.select(segment, place, silent.alias("_s"))
    held = held.withColumn("_g", F.col(place) - F.row_number().over(Window.partitionBy(segment, "_s").orderBy(place)))
    size = F.count("*").over(Window.partitionBy(segment, "_s", "_g"))
    held = held.withColumn("_quiet", F.col("_s") & (size >= least))
    held = held.withColumn("_new", (~F.col("_quiet") & F.coalesce(F.lag("_quiet").over(order), F.lit(True))).cast("int")).withColumn("run", F.sum("_new").over(order))
    return held.where(~F.col("_quiet")).groupBy(segment, "run").agg(F.min(place).alias("first"), F.max(place).alias("last"))


def accepted_runs(runs: DataFrame, expected: DataFrame, segment: str, chunks: str) -> DataFrame:
    """Runs of the segments that have as many of them as chunks."""
    counted = runs.withColumn("_n", F.count("*").over(Window.partitionBy(segment)))
    return counted.join(expected, segment).where(F.col("_n") == F.col(chunks)).drop("_n", chunks)


def chunk_samples(chunks: DataFrame, segment: str, order: str, length: str, rate: int, trailing: Column, pause: float = PAUSE) -> DataFrame:
    """start and end of each chunk in its segment, in samples, with a pause between chunks; and the segment's length."""
    gap = int(pause * rate)
    window = Window.partitionBy(segment)
    nth = F.row_number().over(window.orderBy(order)) - 1
    start = F.coalesce(F.sum(length).over(_before(segment, order=[order])), F.lit(0)) + nth * gap
    held = chunks.withColumn("start", start).withColumn("end", F.col("start") + F.col(length))
    return held.withColumn("total", F.max("end").over(window) + F.when(trailing, gap).otherwise(0))


def millisecond_marks(chapters: DataFrame, book: str, order: str, duration: str) -> DataFrame:
    """Whole milliseconds, each chapter's cut off before it is added."""
    ms = (F.col(duration) * 1000).cast("long")
    return scans.sum_before(chapters.withColumn("_ms", ms), [book], [order], F.col("_ms"), "start_ms").withColumn("end_ms", F.col("start_ms") + F.col("_ms")).drop("_ms")


def word_leads(words: DataFrame, list_: str, order: list[str], t: Column) -> DataFrame:
    """How far a moment t has gone from a word's start to the next one's: 1 if they nearly meet, null for the last word."""
    following = F.lead("start").over(Window.partitionBy(list_).orderBy(*order))
    gap = following - F.col("start")
    share = F.when(gap <= 0.01, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (t - F.col("start")) / gap)))
    return words.withColumn("next_start", following).withColumn("fraction", F.when(following.isNotNull(), share))


def rebase_words(words: DataFrame, chunks: DataFrame, segments: DataFrame, segment: list[str], chunk: str) -> DataFrame:
    """Word times in the book: the word's in the chunk, plus the chunk's in the segment, rounded, plus the segment's in the book, rounded."""
    held = words.join(chunks.withColumnRenamed("start", "_c"), [*segment, chunk]).join(segments.withColumnRenamed("start", "_s").select(*segment, "_s"), segment)
    place = lambda x: F.round(F.round(F.col(x) + F.col("_c"), 3) + F.col("_s"), 3)
    return held.withColumn("start", place("start")).withColumn("end", place("end")).drop("_c", "_s")


def flat_numbers(words: DataFrame, chapter: list[str], order: list[str]) -> DataFrame:
    return scans.numbered(words, chapter, order, "flat_no")


def as_of(lookups: DataFrame, spans: DataFrame, key: str, t: str, payload: list[str], first_if_before: bool = False, tasks: int | None = None) -> DataFrame:
    """Each lookup with the payload of the last span of its key that starts at or before t, by one scan of both together.

    spans: key, start, payload. With first_if_before a moment before all spans has the first one.
    """
    item = F.struct("start", *payload)
    both = lookups.select("*", F.col(t).alias("_t"), F.lit(1).alias("_kind"), F.lit(None).cast(spans.select(item.alias("s")).schema["s"].dataType).alias("_s")).unionByName(
        spans.select(key, F.col("start").alias("_t"), F.lit(0).alias("_kind"), item.alias("_s")), allowMissingColumns=True
    )
    both = scans.last_before(both, key, "_t", "_kind", "_s", "_f", first_if_before=first_if_before, tasks=tasks)
    return both.where("_kind = 1").select(*lookups.columns, *[F.col(f"_f.{c}").alias(c) for c in payload])


def span_at(lookups: DataFrame, spans: DataFrame, key: str, t: str, payload: list[str], tasks: int | None = None) -> DataFrame:
    """The span with start <= t <= end, the earlier one where two meet; none in a pause."""
    held = spans.withColumn("_end", F.col("end")).withColumn("_meets", F.struct(key, "start"))
    # Spans don't overlap, so the span that ends at t is the one before the span that starts there.
    ended = spans.where("start < end").select(F.struct(F.col(key), F.col("end").alias("start")).alias("_meets"), "start", *payload)
    ended = dealt(ended, tasks, "_meets").groupBy("_meets").agg(F.min_by(F.struct(*payload), "start").alias("_prior"))
    held = dealt(held, tasks, "_meets").join(ended, "_meets", "left").drop("_meets")
    found = as_of(lookups, held.withColumn("_start", F.col("start")), key, t, ["_start", "_end", "_prior", *payload], tasks=tasks)
    at_start = (F.col(t) == F.col("_start")) & F.col("_prior").isNotNull()
    return found.select(*lookups.columns, *[F.when(at_start, F.col(f"_prior.{c}")).when(F.col(t) <= F.col("_end"), F.col(c)).alias(c) for c in payload])


def read_along(spoken: DataFrame, printed: DataFrame, chapter: str) -> DataFrame:
    """Printed chunks with the times of the spoken ones of equal number; untimed and not aligned where a chapter's counts differ.

    spoken, printed: chapter, ordinal; counts only are compared.
    """
    window = Window.partitionBy(chapter)
    heard = spoken.withColumn("_spoken", F.count("*").over(window)).select(chapter, "ordinal", "start", "end", "_spoken")
    counts = spoken.groupBy(chapter).agg(F.count("*").alias("_spoken"))
    shown = printed.withColumn("_printed", F.count("*").over(window)).join(counts, chapter, "left").withColumn("aligned", F.coalesce(F.col("_printed") == F.col("_spoken"), F.lit(False)))
    timed = shown.drop("_spoken").join(heard.drop("_spoken"), [chapter, "ordinal"], "left")
    return timed.withColumns({c: F.when(F.col("aligned"), F.col(c)) for c in ("start", "end")}).drop("_printed")


def metadata_lines(books: DataFrame, marks: DataFrame, book: str) -> DataFrame:
    """The chapter-metadata text of each book. marks: book, position, title, start_ms, end_ms; books: book, title, artist."""
    from taleweave.functions.speech import escape_metadata as esc

    one = F.concat(F.lit("[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms"), F.lit("\nEND="), F.col("end_ms"), F.lit("\ntitle="), esc(F.col("title")), F.lit("\n"))
    listed = marks.select(book, "position", one.alias("line")).groupBy(book).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "line"))), lambda x: x["line"]), "").alias("body"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), esc(F.col("title")), F.lit("\nartist="), esc(F.col("artist")), F.lit("\nalbum="), esc(F.col("title")), F.lit("\ngenre=Audiobook\n"))
    return books.join(listed, book).select(book, F.concat(head, "body").alias("metadata"))


def timeline_faults(spans: DataFrame, key: str, order: list[str], tasks: int | None = None) -> DataFrame:
    """Spans that start before the one before them, or end before they start."""
    before = F.lag("start").over(Window.partitionBy(key).orderBy(*order))
    spans = dealt(spans, tasks, key).withColumn("_before", before)
    faults = F.array_compact(F.array(F.when(F.col("start") < F.col("_before"), "starts before the last"), F.when(F.col("end") < F.col("start"), "ends before its start")))
    return spans.select(key, *order, F.explode(faults).alias("fault"))
