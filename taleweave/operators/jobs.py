"""Jobs and workers: progress, queues, capacity, validation, retention."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RUNNING = ("parsing", "synthesizing", "assembling")
STALE_SECONDS, NEEDED_REVISION = 30, 3
MODES, CONCURRENCY = ("full", "sample"), (1, 6)


def progress(total: Column, left: Column, done: Column) -> Column:
    """Percent: 5 when parsed, 95 when all is rendered."""
    return 5 + 90 * (total - left + done) / F.greatest(total, F.lit(1))


def estimate(elapsed: Column, done: Column, left: Column) -> Column:
    """Seconds in all, from what this run has done; null until it has done something."""
    return elapsed / F.when(done > 0, done) * left


def realtime_factor(audio: Column, work: Column) -> Column:
    return audio / F.when(work > 0, work)


def section_summary(plan: DataFrame, book: str) -> DataFrame:
    """included, total, flagged (included but not titled by the contents), untitled, and whether anything is included. Missing include is included."""
    include = F.coalesce("include", F.lit(True))
    return plan.groupBy(book).agg(
        F.count_if(include).alias("included"), F.count("*").alias("total"), F.count_if(include & (F.col("source") != "toc")).alias("flagged"),
        F.count_if(F.coalesce(F.trim("title"), F.lit("")) == "").alias("untitled"), F.bool_or(include).alias("startable"),
    )


def library_summary(jobs: DataFrame, online: Column) -> DataFrame:
    """active, waiting, and stalled: something waits and no worker is online. One row."""
    return jobs.agg(F.count_if(F.col("status").isin(*RUNNING)).alias("active"), F.count_if(F.col("status") == "queued").alias("waiting")).withColumn("stalled", ~online & (F.col("waiting") > 0))


def representative(chapters: DataFrame, book: str, size: str, index: str) -> DataFrame:
    """The upper median of each book's chapters by size, ties by index."""
    window = Window.partitionBy(book)
    held = chapters.withColumn("_n", F.count("*").over(window)).withColumn("_at", F.row_number().over(window.orderBy(size, index)))
    return held.where(F.col("_at") == F.floor(F.col("_n") / 2) + 1).drop("_n", "_at")


def projection(wall: Column, chunk_chars: Column, total_chars: Column) -> Column:
    """Seconds for a whole book at the measured rate."""
    return wall / F.when(chunk_chars > 0, chunk_chars) * total_chars


def mixed_formats(files: DataFrame, book: str, format_: str, wanted: str) -> DataFrame:
    """formats, mixed, and how many files of each book must be converted to the wanted format."""
    return files.groupBy(book).agg(F.count_distinct(format_).alias("formats"), (F.count_distinct(format_) > 1).alias("mixed"), F.count_if(F.col(format_) != wanted).alias("to_convert"))


def capacity(ram: Column, free: Column, asked: Column) -> Column:
    """Renderers a machine can run: at least one, at most asked for; unmeasured memory is estimated from RAM."""
    headroom = F.coalesce(free - 2.5, 0.74 * 0.92 * ram - 8)
    fits = F.least(F.floor((ram - 8) / 7), F.floor(headroom / 5.5))
    return F.least(F.greatest(F.lit(1), fits), asked)


def newest_jobs(jobs: DataFrame, n: int = 100) -> DataFrame:
    return jobs.where("mode = 'full'").orderBy(F.desc("created_at"), F.desc("id")).limit(n)


def next_jobs(jobs: DataFrame, per: str, slots: int) -> DataFrame:
    """The oldest queued jobs of each queue, as many as it has slots."""
    order = Window.partitionBy(per).orderBy("created_at", "id")
    return jobs.where("status = 'queued'").withColumn("turn", F.row_number().over(order)).where(F.col("turn") <= slots)


def latest_per(rows: DataFrame, key: str, at: str, columns: list[str]) -> DataFrame:
    """Each key's row with the latest time, by one aggregation."""
    return rows.groupBy(key).agg(F.max(F.struct(at, *columns)).alias("_l")).select(key, F.col(f"_l.{at}").alias(at), *[F.col(f"_l.{c}").alias(c) for c in columns])


def newest_sample(jobs: DataFrame, parent: str) -> DataFrame:
    order = Window.partitionBy(parent).orderBy(F.desc("created_at"), F.desc("id"))
    return jobs.where("mode = 'sample'").withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def request_faults(requests: DataFrame, key: str) -> DataFrame:
    """What is wrong with start requests (mode, concurrency, included, status), a row for each fault."""
    low, high = CONCURRENCY
    faults = F.array_compact(F.array(
        F.when(~F.coalesce(F.col("mode").isin(*MODES), F.lit(False)), "unknown mode"), F.when(~F.coalesce(F.col("concurrency").between(low, high), F.lit(False)), "concurrency out of range"),
        F.when(F.coalesce("included", F.lit(0)) < 1, "nothing included"), F.when(~F.col("status").eqNullSafe("draft"), "not a draft"),
    ))
    return requests.select(key, F.explode(faults).alias("fault"))


def repeated_keys(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def live_workers(workers: DataFrame, now: Column, stale: float = STALE_SECONDS) -> DataFrame:
    """Workers seen less than `stale` seconds before now."""
    return workers.where(F.unix_micros(now) - F.unix_micros("last_seen") < int(stale * 1e6))


def orphans(jobs: DataFrame, live: DataFrame, worker: str | None = "worker") -> DataFrame:
    """Running jobs whose worker isn't live: cancelled if that was asked for, else queued again.

    worker: the column that says whose a job is; None where one worker does all jobs: then all are orphans while none is live.
    """
    running = jobs.where(F.col("status").isin(*RUNNING))
    if worker:
        lost = running.join(live.select(F.col("id").alias(worker)), worker, "left_anti")
    else:
        anyone = F.broadcast(live.select(F.lit(1).alias("_one")).limit(1))
        lost = running.withColumn("_one", F.lit(1)).join(anyone, "_one", "left_anti").drop("_one")
    return lost.withColumn("becomes", F.when(F.col("cancel_requested"), "cancelled").otherwise("queued"))


def outdated(workers: DataFrame, needed: int = NEEDED_REVISION) -> DataFrame:
    return workers.where(F.coalesce("revision", F.lit(1)) < needed)


def without_children(jobs: DataFrame, gone: DataFrame, key: str = "id", parent: str = "parent_id") -> DataFrame:
    """Jobs that stay when `gone` are removed with their samples."""
    left = jobs.join(gone.select(F.col(key)), key, "left_anti")
    return left.join(gone.select(F.col(key).alias(parent)), parent, "left_anti").select(jobs.columns)
