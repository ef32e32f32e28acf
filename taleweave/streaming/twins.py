"""Batch twins of the streams: the same folds over all events at once, with windows."""

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from taleweave.streaming.lifecycle import FOLDED, fold_rows


def runs(events: DataFrame, key: str, claim: str) -> DataFrame:
    """(key, run, seconds): a run begins at each claim and lasts to its last event."""
    order = Window.partitionBy(key).orderBy("ts", "event_id")
    held = events.withColumn("run", F.sum((F.col("event_type") == claim).cast("long")).over(order)).where("run > 0")
    micros = lambda x: F.unix_micros(x.cast("timestamp"))
    return held.groupBy(key, "run").agg(((F.max(micros(F.col("ts"))) - F.min(micros(F.col("ts")))) / 1e6).alias("seconds"))


def progress_sums(events: DataFrame, key: str) -> DataFrame:
    """What each job's finished segments add up to. The same aggregation runs on a stream."""
    done = F.col("event_type") == "view"
    return events.groupBy(key).agg(F.coalesce(F.sum(F.when(done, F.col("value"))), F.lit(0.0)).alias("done_seconds"), F.count_if(done).alias("segments"))


def back_off(events: DataFrame, key: str, failed: Column, succeeded: Column, forget: float = 900, free: int = 5, longest: float = 30) -> DataFrame:
    """Failures since the last success of a key, forgotten after a pause, and the wait they cost."""
    order = ["ts", "event_id"]
    held = events.where(failed | succeeded).withColumn("_wins", F.sum(succeeded.cast("int")).over(Window.partitionBy(key).orderBy(*order)))
    held = held.where(failed).withColumn("_us", F.unix_micros(F.col("ts").cast("timestamp")))
    since = Window.partitionBy(key, "_wins").orderBy(*order)
    held = held.withColumn("_forgot", F.coalesce((F.col("_us") - F.lag("_us").over(since) > int(forget * 1e6)).cast("int"), F.lit(0)))
    held = held.withColumn("_fresh", F.sum("_forgot").over(since))
    held = held.withColumn("failures", F.row_number().over(Window.partitionBy(key, "_wins", "_fresh").orderBy(*order)))
    wait = F.when(F.col("failures") > free, F.least(F.lit(float(longest)), F.pow(F.lit(2.0), F.col("failures") - free))).otherwise(0.0)
    return held.withColumn("wait_seconds", wait).drop("_wins", "_us", "_forgot", "_fresh")


#: Commands that events stand for, by event_id modulo their number; an event's worker is online unless its id divides by four.
COMMANDS = ("analyze", "start", "claim", "planned", "rendered", "uploaded", "error", "cancel", "flag_seen", "resume", "analyze", "start", "claim", "planned", "reassemble", "rescue", "cancel", "start", "claim", "delete", "rendered", "planned", "nonsense")


def commands_of(events: DataFrame) -> DataFrame:
    """Job commands read from the events table: event_id, ts, job, command, online."""
    command = F.element_at(F.array(*map(F.lit, COMMANDS)), (F.col("event_id") % len(COMMANDS) + 1).cast("int"))
    return events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.col("user_id").alias("job"), command.alias("command"), (F.col("event_id") % 4 != 0).alias("online"))


def fold_commands(commands: DataFrame) -> DataFrame:
    """A row of FOLDED for each command, a job's in time order; a job's commands are few."""

    def run(frame):
        ordered = frame.sort_values(["ts", "event_id"])
        _, rows = fold_rows(None, int(frame["job"].iloc[0]), zip(ordered["event_id"], ordered["command"], ordered["online"]))
        return pd.DataFrame(rows, columns=[c.split()[0] for c in FOLDED.split(", ")])

    return commands.groupBy("job").applyInPandas(run, FOLDED)


def last_states(folded: DataFrame, order: DataFrame) -> DataFrame:
    """The state of each job after its last command (order: event_id, ts); a job that is gone has status null."""
    state = F.struct("status", "cancel_requested", "claims", "rejected")
    return folded.join(order.select("event_id", "ts"), "event_id").groupBy("job").agg(F.max_by(state, F.struct("ts", "event_id")).alias("s")).select("job", "s.*")


def rejected_commands(folded: DataFrame) -> DataFrame:
    """The commands that weren't allowed, with the status in which they came."""
    return folded.where(~F.col("accepted")).select("event_id", "job", "command", "status")


def late_counts(events: DataFrame, late: float) -> DataFrame:
    """(key, late, events): how many of a key's events (key, event_id in the order they came, ts) came more than `late` seconds behind its latest."""
    before = Window.partitionBy("key").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    held = events.withColumn("_at", F.unix_micros("ts"))
    behind = F.coalesce(F.max("_at").over(before) - F.col("_at") > int(late * 1e6), F.lit(False))
    return held.withColumn("_late", behind).groupBy("key").agg(F.count_if("_late").alias("late"), F.count("*").alias("events"))
