"""Event streams of workers and jobs: Structured Streaming forms of the operators whose batch forms are in twins and jobs.

All time is event time. State is keyed by worker or job and bounded by watermarks and timeouts; events later than the
watermark are dropped by Spark and counted in the query's progress.
"""

import json
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from taleweave.operators import jobs
from taleweave.sources.archives import DRAFTS, LARGEST, drafts, judge, listing
from taleweave.streaming.lifecycle import FOLDED, fold_rows

LATE = "1 hour"


def table_stream(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A Parquet table (a file, or a folder of files) read as a stream."""
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    folder, _, name = path.rpartition("/")
    return reader.parquet(f"{folder}/[{name[0]}]{name[1:]}")  # as a pattern, a single file may be a stream too


def once_each(events: DataFrame, time: str = "ts", key: str = "event_id", late: str = LATE) -> DataFrame:
    """Each event once, within the watermark."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def latest_heartbeats(events: DataFrame, key: str, time: str, columns: list[str]) -> DataFrame:
    """The latest attributes of each worker; update or complete mode."""
    return jobs.latest_per(events, key, time, columns)


def liveness_changes(heartbeats: DataFrame, key: str, time: str, stale_seconds: float) -> DataFrame:
    """(worker, at, online): a row when a worker comes online, and one when it has been silent for stale_seconds of event time."""

    def run(k, frames, state):
        rows = []
        if state.hasTimedOut:
            (last,) = state.get
            rows.append((k[0], pd.Timestamp(int(last + stale_seconds * 1e6), unit="us"), False))
            state.remove()
        else:
            last = state.get[0] if state.exists else None
            for at in sorted(int(x.value // 1000) for f in frames for x in f["at"]):
                if last is not None and at <= last:
                    continue
                if last is not None and at - last >= stale_seconds * 1e6:
                    rows.append((k[0], pd.Timestamp(int(last + stale_seconds * 1e6), unit="us"), False))
                    last = None
                if last is None:
                    rows.append((k[0], pd.Timestamp(at, unit="us"), True))
                last = at
            state.update((last,))
            end = int(last / 1000 + stale_seconds * 1000)
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["worker", "at", "online"]).astype({"at": "datetime64[ns]"})

    held = heartbeats.select(F.col(key).alias("worker"), F.col(time).cast("timestamp").alias("at")).withWatermark("at", LATE)
    return held.groupBy("worker").applyInPandasWithState(run, "worker long, at timestamp, online boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def job_states(commands: DataFrame, keep: str = "90 days", late: str = LATE) -> DataFrame:
    """A row of FOLDED for each command (commands: event_id, ts, job, command, online), accepted or not; append mode.

    Commands wait in the job's state until the watermark, `late` behind the latest of all, has passed them, and are folded in the order of
    (ts, event_id) then: those that arrive in a later micro-batch than their successors still come in their place. Commands older than the watermark are
    dropped by Spark, which counts them in the query's progress. A job's state goes when it is deleted, or when no command has come for
    `keep` of event time: then it counts as gone.
    """
    names = [c.split()[0] for c in FOLDED.split(", ")]
    idle = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key, frames, state):
        status, cancel, claims, rejected, last, waiting = state.get if state.exists else (None, False, 0, 0, 0, "[]")
        held, buffer = {"status": status, "cancel": cancel, "claims": claims, "rejected": rejected}, json.loads(waiting)
        for frame in () if state.hasTimedOut else frames:
            buffer += zip(frame["ts"].astype("datetime64[us]").astype("int64").tolist(), frame["event_id"].tolist(), frame["command"].tolist(), frame["online"].tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        buffer = sorted(map(tuple, buffer), key=lambda c: c[:2])
        ready = [c for c in buffer if c[0] <= passed]
        buffer = buffer[len(ready) :]
        held, rows = fold_rows(held, key[0], [c[1:] for c in ready])
        last = max([last, *(c[0] for c in ready)])
        gone = held["status"] is None and not held["rejected"]
        if not buffer and (gone or passed >= last + idle * 1000):
            if state.exists:
                state.remove()
        else:
            state.update((held["status"], held["cancel"], held["claims"], held["rejected"], last, json.dumps(buffer)))
            next_at = buffer[0][0] // 1000 + 1 if buffer else last // 1000 + idle
            state.setTimeoutTimestamp(max(next_at, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=names)

    timed = commands.withWatermark("ts", late)
    kept = "status string, cancel boolean, claims long, rejected long, last long, waiting string"
    return timed.groupBy("job").applyInPandasWithState(run, FOLDED, kept, "append", GroupStateTimeout.EventTimeTimeout)


def back_off(outcomes: DataFrame, forget: float = 900, free: int = 5, longest: float = 30) -> DataFrame:
    """(key, event_id, failures, wait_seconds) of each failure (outcomes: key, event_id, ts, failed). A key's state is its failures since
    the last success and the last one's time; a pause of more than `forget` seconds begins anew, so the state goes then. Append mode."""

    def run(key, frames, state):
        names = ["key", "event_id", "failures", "wait_seconds"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        failures, last = state.get if state.exists else (0, 0)
        rows = []
        held = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for event, at, failed in zip(held["event_id"], held["ts"].astype("datetime64[us]").astype("int64"), held["failed"]):
            if not failed:
                failures = 0
                continue
            failures = 1 if failures and at - last > forget * 1e6 else failures + 1
            last = int(at)
            rows.append((key[0], event, failures, float(min(longest, 2.0 ** (failures - free))) if failures > free else 0.0))
        if failures:
            state.update((failures, last))
            state.setTimeoutTimestamp(max(last // 1000 + int(forget * 1000) + 1, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(rows, columns=names).astype({"key": "int64", "event_id": "int64", "failures": "int64", "wait_seconds": "float64"})

    timed = outcomes.withWatermark("ts", LATE)
    return timed.groupBy("key").applyInPandasWithState(run, "key long, event_id long, failures long, wait_seconds double", "failures long, last long", "append", GroupStateTimeout.EventTimeTimeout)


def late_counts(events: DataFrame, late: float, keep: str = "90 days") -> DataFrame:
    """(key, late, events) of each micro-batch: events (key, event_id, ts) that came more than `late` seconds behind the latest of their key.

    Spark drops what is behind its watermark, which is of all keys; so that late events are counted instead, the watermark only ends
    the state of keys that were silent for `keep`. Append mode.
    """
    idle = int(pd.Timedelta(keep).total_seconds() * 1000)

    def run(key, frames, state):
        names = ["key", "late", "events"]
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([], columns=names)
            return
        latest, behind, n = (state.get[0] if state.exists else None), 0, 0
        for at in pd.concat(list(frames)).sort_values("event_id")["ts"].astype("datetime64[us]").astype("int64").tolist():
            n += 1
            behind += latest is not None and latest - at > late * 1e6
            latest = at if latest is None else max(latest, at)
        state.update((latest,))
        state.setTimeoutTimestamp(max(latest // 1000 + idle, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame([(key[0], behind, n)], columns=names)

    timed = events.withWatermark("ts", keep)
    return timed.groupBy("key").applyInPandasWithState(run, "key long, late long, events long", "latest long", "append", GroupStateTimeout.EventTimeTimeout)


#: What a rescue stream reads: a worker's heartbeat, its claim and its end of a job, and a wish to cancel one.
SIGNS = "worker long, ts timestamp, sign string, job long"
RESCUED = "job long, worker long, at timestamp, becomes string"


def rescues(signs: DataFrame, stale_seconds: float, late: str = LATE) -> DataFrame:
    """A row of RESCUED for each running job whose worker fell silent: queued again, or cancelled if that was wished; append mode.

    signs (SIGNS: beat, claim, end, cancel) are joined in the state of their worker: when it was last seen, and what it is running. All but a
    wish to cancel are signs of life. A timer ends stale_seconds after the last one; then, or when a later sign shows the gap, the worker's jobs are
    given back, each once, with the moment the worker went. A job that has ended, or was given back, isn't given back again unless it is claimed anew.
    Within a micro-batch signs are taken in time order; one that comes later than its successors counts when it comes.
    """
    stale = int(stale_seconds * 1_000_000)
    rank = {"beat": 0, "claim": 1, "cancel": 2, "end": 3}

    def run(key, frames, state):
        last, running = state.get if state.exists else (None, "{}")
        running, rows = json.loads(running), []  # job -> whether a wish to cancel it has come

        def give_back():
            rows.extend((int(job), key[0], pd.Timestamp(last + stale, unit="us"), "cancelled" if wished else "queued") for job, wished in running.items())
            running.clear()

        if state.hasTimedOut:
            give_back()
            state.remove()
        else:
            told = [x for f in frames for x in zip(f["ts"].astype("datetime64[us]").astype("int64").tolist(), f["sign"].tolist(), f["job"].tolist())]
            for at, sign, job in sorted(told, key=lambda x: (x[0], rank.get(x[1], 9), str(x[2]))):
                if last is not None and at - last >= stale:
                    give_back()
                name = None if job is None or job != job else str(int(job))
                if sign == "cancel":
                    if name in running:
                        running[name] = True
                    continue
                if sign == "claim":
                    running[name] = False
                elif sign == "end":
                    running.pop(name, None)
                last = at if last is None else max(last, at)
            if last is not None:
                state.update((last, json.dumps(running)))
                state.setTimeoutTimestamp(max((last + stale) // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["job", "worker", "at", "becomes"]).astype({"job": "int64", "worker": "int64", "at": "datetime64[ns]"})

    timed = signs.where("worker is not null").withWatermark("ts", late)
    return timed.groupBy("worker").applyInPandasWithState(run, RESCUED, "last long, running string", "append", GroupStateTimeout.EventTimeTimeout)


def archive_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(book_id, content) of the .epub files that land in a folder, each once."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.epub").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]*$", 1).alias("book_id"), "content")


def new_books(archives: DataFrame, out: str, largest: int = LARGEST, plans: bool = True) -> tuple[DataFrame, DataFrame]:
    """(drafts, rejected) of all archives of a stream (book_id, content) that are there now, written under the folder `out`, where its progress is kept too.

    Each micro-batch writes both of its outputs: the draft plans of the books that were accepted, and the verdicts (book_id, unpacked, verdict)
    on those that weren't. A batch that runs again after a failure replaces its own rows; called again, the stream goes on with what has landed
    since. A book that lands again, changed, is read again: its rows of the latest batch count. Without `plans` each book is judged
    alone: the rejected are the same, and no drafts are made.
    """
    spark, verdict = archives.sparkSession, f"book_id {archives.schema['book_id'].dataType.simpleString()}, unpacked long, verdict string"

    def put(rows, number):
        if plans:
            drafts(rows, largest).write.mode("overwrite").parquet(f"{out}/drafts/batch={number}")
        judge(listing(rows), largest).write.mode("overwrite").parquet(f"{out}/judged/batch={number}")
        judged = spark.read.schema(verdict).parquet(f"{out}/judged/batch={number}")
        judged.where("verdict <> 'accepted'").write.mode("overwrite").parquet(f"{out}/rejected/batch={number}")
        judged.select("book_id").write.mode("overwrite").parquet(f"{out}/read/batch={number}")

    query = archives.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    latest = spark.read.schema(f"{verdict.split(',')[0]}, batch long").parquet(f"{out}/read").groupBy("book_id").agg(F.max("batch").alias("batch"))
    if not plans:
        spark.createDataFrame([], DRAFTS).write.mode("overwrite").parquet(f"{out}/drafts/batch=0")
    put_out = (spark.read.schema(f"{schema}, batch long").parquet(f"{out}/{name}") for name, schema in (("drafts", DRAFTS), ("rejected", verdict)))
    made, refused = (rows.join(latest, ["book_id", "batch"], "left_semi").drop("batch") for rows in put_out)
    return made, refused


def drain(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there now and returns what it put out, by way of the folder.

    In complete mode each micro-batch replaces the last one's rows; otherwise they are appended, once each: a batch that runs
    again after a failure replaces its own rows.
    """
    run = uuid.uuid4().hex
    out, spark = f"{folder.rstrip('/')}/stream-{run}", stream.sparkSession

    def put(rows, number):
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={0 if mode == 'complete' else number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    made = spark.read.schema(stream.schema).parquet(f"{out}/rows")
    return made.drop("batch")
