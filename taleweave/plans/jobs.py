"""Queries of jobs and workers: `orders` stands for jobs, `events` for heartbeats, commands and outcomes."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from taleweave.functions import speech as S
from taleweave.operators import catalog, jobs
from taleweave.plans.registry import BOOK, book_key, query
from taleweave.streaming import twins

JOBS = """j AS (SELECT o_orderkey AS id, o_custkey AS parent_id, CASE WHEN o_orderkey % 4 = 0 THEN 'sample' ELSE 'full' END AS mode, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'done' ELSE 'synthesizing' END AS status,
  o_orderdate AS created_at, o_totalprice AS audio_seconds, o_orderkey % 6 = 0 AS cancel_requested, o_custkey % 150 AS worker FROM orders)"""
NOW = "TIMESTAMP '2024-01-31 00:00:00'"
SEEN = "h AS (SELECT user_id AS id, max(ts) AS last_seen FROM events GROUP BY user_id)"
_STALE = 6 * 3600


def job_rows(t):
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "done").otherwise("synthesizing")
    return t("orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_id"), F.when(F.col("o_orderkey") % 4 == 0, "sample").otherwise("full").alias("mode"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), F.col("o_totalprice").alias("audio_seconds"), (F.col("o_orderkey") % 6 == 0).alias("cancel_requested"), (F.col("o_custkey") % 150).alias("worker"),
    )


def now(t):
    return F.lit("2024-01-31 00:00:00").cast("timestamp")


def seen(t):
    return t("events").groupBy(F.col("user_id").alias("id")).agg(F.max(F.col("ts").cast("timestamp")).alias("last_seen"))


@query(
    "a03_section_summary",
    """SELECT source AS book, count_if(coalesce(l.quality = 1, true)) AS included, count(*) AS total, count_if(coalesce(l.quality = 1, true)
      AND d.doc_id % 4 <> 0) AS flagged, count_if(d.doc_id % 10 = 0) AS untitled, bool_or(coalesce(l.quality = 1, true)) AS startable FROM documents d LEFT
      JOIN labels l ON l.doc_id = d.doc_id GROUP BY source""",
)
def a03(t):
    plan = t("documents").join(t("labels"), "doc_id", "left").select(F.col("source").alias("book"), (F.col("quality") == 1).alias("include"), F.when(F.col("doc_id") % 10 == 0, " ").otherwise("A title").alias("title"), F.when(F.col("doc_id") % 4 == 0, "toc").otherwise("heading").alias("source"))
    return jobs.section_summary(plan, "book")


@query("a06_progress", f"WITH {JOBS} SELECT id, round(5 + 90 * (audio_seconds - audio_seconds / 2 + audio_seconds / 8) / greatest(audio_seconds, 1), 6) AS progress FROM j")
def a06(t):
    a = F.col("audio_seconds")
    return job_rows(t).select("id", F.round(jobs.progress(a, a / 2, a / 8), 6).alias("progress"))


_RUNS = """r AS (SELECT user_id AS job, ts, event_type, sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events)"""


@query("st06_run_accounting", f"WITH {_RUNS} SELECT job, run::BIGINT AS run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM r WHERE run > 0 GROUP BY job, run")
def st06(t):
    return twins.runs(t("events"), "user_id", "signup").select(F.col("user_id").alias("job"), "run", "seconds")


@query(
    "a07_work_seconds",
    f"""WITH {_RUNS}, s AS (SELECT job, run, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS seconds FROM r WHERE run > 0 GROUP BY job, run)
      SELECT job, round(sum(seconds), 3) AS work_seconds, count(*) AS runs FROM s GROUP BY job""",
)
def a07(t):
    held = twins.runs(t("events"), "user_id", "signup")
    return held.groupBy(F.col("user_id").alias("job")).agg(F.round(F.sum("seconds"), 3).alias("work_seconds"), F.count("*").alias("runs"))


@query(
    "st05_live_progress",
    """SELECT user_id AS job, round(coalesce(sum(CASE WHEN event_type = 'view' THEN value END), 0),
      3) AS done_seconds, count_if(event_type = 'view') AS segments FROM events GROUP BY user_id""",
)
def st05(t):
    return twins.progress_sums(t("events"), "user_id").select(F.col("user_id").alias("job"), F.round("done_seconds", 3).alias("done_seconds"), "segments")


@query(
    "a08_time_left",
    f"""WITH {JOBS}, e AS (SELECT id, CASE WHEN id % 5 > 0 THEN 600 / (id % 5) * (audio_seconds / 100) END AS estimate FROM j)
      SELECT id, round(estimate, 6) AS estimate, CASE WHEN estimate IS NULL THEN 'calculating' WHEN estimate - 600 <= 5 THEN 'almost done'
      WHEN estimate - 600 < 60 THEN floor(estimate - 600 + 0.5)::BIGINT || 's left'
      WHEN floor((estimate - 600) / 60 + 0.5)::BIGINT >= 60 THEN (floor((estimate - 600) / 60 + 0.5)::BIGINT // 60) || 'h ' || (floor((estimate - 600) / 60 + 0.5)::BIGINT % 60) || 'm left'
      ELSE floor((estimate - 600) / 60 + 0.5)::BIGINT || 'm left' END AS label FROM e""",
)
def a08(t):
    left = jobs.estimate(F.lit(600.0), F.col("id") % 5, F.col("audio_seconds") / 100)
    return job_rows(t).select("id", F.round(left, 6).alias("estimate"), S.time_left_label(left - 600).alias("label"))


@query(
    "a09_library_summary",
    f"""WITH {JOBS}, {SEEN} SELECT count_if(status = 'synthesizing') AS active, count_if(status = 'queued') AS waiting, count_if(status = 'queued') > 0
      AND NOT EXISTS (SELECT 1 FROM h WHERE epoch_us({NOW}) - epoch_us(last_seen) < {_STALE} * 1000000::BIGINT) AS stalled FROM j""",
)
def a09(t):
    live = jobs.live_workers(seen(t), now(t), _STALE).agg((F.count("*") > 0).alias("online"))
    return jobs.library_summary(job_rows(t), F.lit(False)).join(F.broadcast(live)).select("active", "waiting", (~F.col("online") & (F.col("waiting") > 0)).alias("stalled"))


@query(
    "a10_representative_chapters",
    f"""SELECT book, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY n_chars, doc_id) AS nth, count(*)
      OVER (PARTITION BY book) AS n FROM (SELECT *, {BOOK} AS book FROM documents)) WHERE nth = n // 2 + 1""",
)
def a10(t):
    return jobs.representative(t("documents").select(book_key(), "doc_id", "n_chars"), "book", "n_chars", "doc_id")


@query("a11_projection", "SELECT doc_id, round(12.5 / nullif(n_chars, 0) * 1000000, 6) AS seconds, 12.5 / nullif(n_chars, 0) * 1000000 <= 86400 AS within_a_day FROM documents")
def a11(t):
    whole = jobs.projection(F.lit(12.5), F.col("n_chars"), F.lit(1000000))
    return t("documents").select("doc_id", F.round(whole, 6).alias("seconds"), (whole <= 86400).alias("within_a_day"))


@query(
    "a12_match_coverage",
    """SELECT user_id AS block, count_if(event_type = 'view') AS matched, count(*) AS spoken, count_if(event_type = 'view') >= 0.6 * count(*) AS accepted
      FROM events GROUP BY user_id""",
)
def a12(t):
    matched, spoken = F.count_if(F.col("event_type") == "view"), F.count("*")
    return t("events").groupBy(F.col("user_id").alias("block")).agg(matched.alias("matched"), spoken.alias("spoken"), (matched >= 0.6 * spoken).alias("accepted"))


@query(
    "a13_mixed_formats",
    """SELECT l_orderkey AS book, count(DISTINCT l_returnflag) AS formats, count(DISTINCT l_returnflag) > 1 AS mixed, count_if(l_returnflag <> 'N') AS to_convert
      FROM lineitem GROUP BY l_orderkey""",
)
def a13(t):
    return jobs.mixed_formats(t("lineitem").select(F.col("l_orderkey").alias("book"), "l_returnflag"), "book", "l_returnflag", "N")


_CAPACITY = "least(greatest(1, least(floor((ram - 8) / 7), floor(coalesce(free - 2.5, 0.74 * 0.92 * ram - 8) / 5.5))), asked)::BIGINT"
_MACHINES = "w AS (SELECT s_suppkey AS id, s_nationkey AS fleet, (16 + s_suppkey % 5 * 24)::DOUBLE AS ram, CASE WHEN s_suppkey % 3 > 0 THEN s_suppkey % 40 + 0.5 END::DOUBLE AS free, s_suppkey % 6 + 1 AS asked FROM supplier)"


@query("a16_capacity", f"WITH {_MACHINES} SELECT fleet, count(*) AS workers, sum({_CAPACITY})::BIGINT AS capacity FROM w GROUP BY fleet")
def a16(t):
    k = F.col("s_suppkey")
    machine = t("supplier").select(F.col("s_nationkey").alias("fleet"), (16 + k % 5 * 24).cast("double").alias("ram"), F.when(k % 3 > 0, k % 40 + 0.5).cast("double").alias("free"), (k % 6 + 1).alias("asked"))
    return machine.groupBy("fleet").agg(F.count("*").alias("workers"), F.sum(jobs.capacity(F.col("ram"), F.col("free"), F.col("asked")).cast("long")).alias("capacity"))


@query("l01_newest_jobs", f"WITH {JOBS} SELECT id, created_at FROM j WHERE mode = 'full' ORDER BY created_at DESC, id DESC LIMIT 100")
def l01(t):
    return jobs.newest_jobs(job_rows(t)).select("id", "created_at")


@query("l02_next_jobs", f"WITH {JOBS} SELECT worker, id, turn FROM (SELECT *, row_number() OVER (PARTITION BY worker ORDER BY created_at, id) AS turn FROM j WHERE status = 'queued') WHERE turn <= 2")
def l02(t):
    return jobs.next_jobs(job_rows(t), "worker", 2).select("worker", "id", F.col("turn").cast("long"))


@query("l03_latest_worker", "SELECT user_id AS id, ts, event_type FROM (SELECT *, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def l03(t):
    top = t("events").agg(F.max(F.struct("ts", "event_id", "user_id", "event_type")).alias("l"))
    return top.select(F.col("l.user_id").alias("id"), F.col("l.ts").alias("ts"), F.col("l.event_type").alias("event_type"))


@query(
    "st01_latest_heartbeats",
    """SELECT user_id AS id, ts AS last_seen, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id
      ORDER BY ts DESC, event_type DESC, value DESC) AS n FROM events) WHERE n = 1""",
)
def st01(t):
    return jobs.latest_per(t("events"), "user_id", "ts", ["event_type", "value"]).select(F.col("user_id").alias("id"), F.col("ts").alias("last_seen"), "event_type", "value")


@query("st02_liveness", f"WITH {SEEN} SELECT id, epoch_us({NOW}) - epoch_us(last_seen) < {_STALE} * 1000000::BIGINT AS online FROM h")
def st02(t):
    return seen(t).select("id", (F.unix_micros(now(t)) - F.unix_micros("last_seen") < _STALE * 1_000_000).alias("online"))


@query("l04_first_chunks", "SELECT conv_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS n FROM conversations) WHERE n < 2")
def l04(t):
    return t("conversations").withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).where("n < 2").select("conv_id", "turn")


@query(
    "j12_orphans",
    f"""WITH {JOBS}, {SEEN} SELECT id, CASE WHEN cancel_requested THEN 'cancelled' ELSE 'queued' END AS becomes FROM j WHERE status = 'synthesizing'
      AND worker NOT IN (SELECT id FROM h WHERE epoch_us({NOW}) - epoch_us(last_seen) < {_STALE} * 1000000::BIGINT)""",
)
def j12(t):
    return jobs.orphans(job_rows(t), jobs.live_workers(seen(t), now(t), _STALE)).select("id", "becomes")


_LATER = "TIMESTAMP '2024-02-01 00:00:00'"


@query(
    "j12_orphans_of_one_worker",
    f"""WITH {JOBS}, {SEEN} SELECT id, CASE WHEN cancel_requested THEN 'cancelled' ELSE 'queued' END AS becomes FROM j WHERE status = 'synthesizing'
      AND NOT EXISTS (SELECT 1 FROM h WHERE epoch_us({_LATER}) - epoch_us(last_seen) < {_STALE} * 1000000::BIGINT)""",
)
def j12b(t):
    later = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return jobs.orphans(job_rows(t), jobs.live_workers(seen(t), later, _STALE), None).select("id", "becomes")


@query(
    "st04_rescued_jobs",
    f"""WITH {JOBS}, {SEEN} SELECT worker, count_if(NOT cancel_requested)::BIGINT AS queued, count_if(cancel_requested)::BIGINT AS cancelled FROM j
      WHERE status = 'synthesizing' AND worker NOT IN (SELECT id FROM h WHERE epoch_us({NOW}) - epoch_us(last_seen) < {_STALE} * 1000000::BIGINT)
      GROUP BY worker""",
)
def st04(t):
    lost = jobs.orphans(job_rows(t), jobs.live_workers(seen(t), now(t), _STALE))
    return lost.groupBy("worker").agg(F.count_if(F.col("becomes") == "queued").alias("queued"), F.count_if(F.col("becomes") == "cancelled").alias("cancelled"))


@query(
    "w08_newest_samples",
    f"""WITH {JOBS} SELECT parent_id, id FROM (SELECT *, row_number() OVER (PARTITION BY parent_id ORDER BY created_at DESC, id DESC) AS n FROM j
      WHERE mode = 'sample') WHERE n = 1""",
)
def w08(t):
    return jobs.newest_sample(job_rows(t), "parent_id").select("parent_id", "id")


@query("j16_without_children", f"WITH {JOBS} SELECT id FROM j WHERE id NOT IN (SELECT id FROM j WHERE id % 5 = 0) AND parent_id NOT IN (SELECT id FROM j WHERE id % 5 = 0)")
def j16(t):
    held = job_rows(t)
    return jobs.without_children(held, held.where("id % 5 = 0")).select("id")


@query(
    "j17_outdated_workers",
    """SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END AS revision FROM supplier WHERE coalesce(CASE
      WHEN s_suppkey % 4 > 0 THEN s_suppkey % 4 END, 1) < 3""",
)
def j17(t):
    k = F.col("s_suppkey")
    return jobs.outdated(t("supplier").select(k.alias("id"), F.when(k % 4 > 0, k % 4).alias("revision")))


@query(
    "c01_request_faults",
    """WITH r AS (SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'preview' WHEN 1 THEN NULL ELSE 'full' END AS mode, o_orderkey % 9 AS concurrency, o_orderkey % 3 AS included, CASE WHEN o_orderkey % 2 = 0 THEN 'draft' ELSE 'done' END AS status FROM orders)
    SELECT id, 'unknown mode' AS fault FROM r WHERE NOT coalesce(mode IN ('full', 'sample'), false) UNION ALL SELECT id, 'concurrency out of range' FROM r WHERE concurrency NOT BETWEEN 1 AND 6
    UNION ALL SELECT id, 'nothing included' FROM r WHERE included < 1 UNION ALL SELECT id, 'not a draft' FROM r WHERE status <> 'draft'""",
)
def c01(t):
    k = F.col("o_orderkey")
    asked = t("orders").select(k.alias("id"), F.when(k % 5 == 0, "preview").when(k % 5 > 1, "full").alias("mode"), (k % 9).alias("concurrency"), (k % 3).alias("included"), F.when(k % 2 == 0, "draft").otherwise("done").alias("status"))
    return jobs.request_faults(asked, "id")


@query("c03_repeated_keys", "SELECT l_orderkey, l_linenumber, count(*) AS rows FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def c03(t):
    return jobs.repeated_keys(t("lineitem"), ["l_orderkey", "l_linenumber"])


@query("s05_job_table", f"WITH {JOBS} SELECT id, status, mode, audio_seconds FROM j")
def s05(t):
    return job_rows(t).select("id", "status", "mode", "audio_seconds")


@query("s13_job_list", f"WITH {JOBS} SELECT id, status, id % 3 <> 0 AS has_timings, status = 'done' AS has_output FROM j")
def s13(t):
    held = job_rows(t).withColumn("timings", F.when(F.col("id") % 3 != 0, F.struct(F.array(F.col("audio_seconds")).alias("chapters")))).withColumn("output_path", F.when(F.col("status") == "done", F.concat(F.lit("out/"), F.col("id").cast("string"))))
    return catalog.job_list(held, ["id", "status"])


@query("s14_timed_chapters", f"WITH {JOBS} SELECT id, CASE WHEN id % 3 <> 0 THEN [audio_seconds, audio_seconds * 2] ELSE [] END AS chapters FROM j")
def s14(t):
    held = job_rows(t).withColumn("timings", F.when(F.col("id") % 3 != 0, F.struct(F.array(F.col("audio_seconds"), F.col("audio_seconds") * 2).alias("chapters"), F.lit("x").alias("chunks"))))
    return catalog.timed_chapters(held, "id")


@query(
    "st07_back_off",
    """WITH f AS (SELECT user_id, event_id, ts, event_type, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS wins FROM events WHERE event_type IN ('error', 'purchase')),
    g AS (SELECT *, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id, wins ORDER BY ts, event_id)) > 10800::BIGINT * 10 * 1000000 THEN 1 ELSE 0 END AS forgot FROM f WHERE event_type = 'error'),
    h AS (SELECT *, sum(forgot) OVER (PARTITION BY user_id, wins ORDER BY ts, event_id) AS fresh FROM g),
    n AS (SELECT *, row_number() OVER (PARTITION BY user_id, wins, fresh ORDER BY ts, event_id) AS failures FROM h)
    SELECT user_id, event_id, failures, CASE WHEN failures > 2 THEN least(30.0, power(2.0, failures - 2)) ELSE 0.0 END::DOUBLE AS wait_seconds FROM n""",
)
def st07(t):
    return twins.back_off(t("events"), "user_id", F.col("event_type") == "error", F.col("event_type") == "purchase", forget=108_000, free=2).select("user_id", "event_id", F.col("failures").cast("long"), "wait_seconds")


# The life-cycle as a recursion over each job's commands; '' stands for a job that isn't there.
_MOVES = """('analyze', '', 'draft'), ('start', 'draft', 'queued'), ('claim', 'queued', 'parsing'), ('planned', 'parsing', 'synthesizing'), ('rendered', 'synthesizing', 'assembling'), ('uploaded', 'assembling', 'done'),
  ('error', 'parsing', 'failed'), ('error', 'synthesizing', 'failed'), ('error', 'assembling', 'failed'), ('flag_seen', 'parsing', 'cancelled'), ('flag_seen', 'synthesizing', 'cancelled'), ('flag_seen', 'assembling', 'cancelled'),
  ('resume', 'cancelled', 'queued'), ('resume', 'failed', 'queued'), ('reassemble', 'draft', 'queued'), ('reassemble', 'queued', 'queued'), ('reassemble', 'done', 'queued'), ('reassemble', 'failed', 'queued'), ('reassemble', 'cancelled', 'queued'),
  ('rescue', 'parsing', 'queued'), ('rescue', 'synthesizing', 'queued'), ('rescue', 'assembling', 'queued'),
  ('delete', 'draft', ''), ('delete', 'queued', ''), ('delete', 'done', ''), ('delete', 'failed', ''), ('delete', 'cancelled', '')"""
_COMMAND = "[" + ", ".join(f"'{c}'" for c in twins.COMMANDS) + f"][event_id % {len(twins.COMMANDS)} + 1]"
_RUNNING = "'parsing', 'synthesizing', 'assembling'"
FOLD = f"""WITH RECURSIVE c AS (SELECT user_id AS job, event_id, {_COMMAND} AS command, event_id % 4 <> 0 AS online, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  moves(command, was, becomes) AS (VALUES {_MOVES}),
  r AS (
    SELECT DISTINCT job, 0::BIGINT AS n, 0::BIGINT AS event_id, '' AS command, true AS accepted, '' AS status, false AS cancel_requested, 0::BIGINT AS claims, 0::BIGINT AS rejected FROM c
    UNION ALL
    SELECT c.job, c.n, c.event_id, c.command,
      CASE WHEN c.command = 'cancel' THEN r.status = 'queued' OR r.status IN ({_RUNNING}) ELSE m.becomes IS NOT NULL END,
      CASE WHEN c.command = 'cancel' THEN (CASE WHEN r.status = 'queued' OR (r.status IN ({_RUNNING}) AND NOT c.online) THEN 'cancelled' ELSE r.status END) ELSE coalesce(m.becomes, r.status) END,
      CASE WHEN c.command = 'cancel' THEN (CASE WHEN r.status = 'queued' THEN false WHEN r.status IN ({_RUNNING}) THEN c.online ELSE r.cancel_requested END)
        WHEN m.becomes IS NOT NULL AND c.command IN ('claim', 'start', 'resume', 'flag_seen', 'rescue', 'delete') THEN false ELSE r.cancel_requested END,
      CASE WHEN m.becomes IS NOT NULL AND c.command = 'delete' THEN 0 ELSE r.claims + (CASE WHEN m.becomes IS NOT NULL AND c.command = 'claim' THEN 1 ELSE 0 END) END,
      CASE WHEN m.becomes IS NOT NULL AND c.command = 'delete' THEN 0
        WHEN c.command = 'cancel' THEN r.rejected + (CASE WHEN r.status = 'queued' OR r.status IN ({_RUNNING}) THEN 0 ELSE 1 END) ELSE r.rejected + (CASE WHEN m.becomes IS NULL THEN 1 ELSE 0 END) END
    FROM r JOIN c ON c.job = r.job AND c.n = r.n + 1 LEFT JOIN moves m ON m.command = c.command AND m.was = r.status)"""
_LAST = " SELECT job, nullif(arg_max(status, n), '') AS status, arg_max(cancel_requested, n) AS cancel_requested, arg_max(claims, n) AS claims, arg_max(rejected, n) AS rejected FROM r WHERE n > 0 GROUP BY job"
#: A stream has folded what its watermark has passed; two hours before its end is surely behind that.
FOLDED_SQL = FOLD.replace("FROM events)", "FROM events WHERE ts <= (SELECT max(ts) - INTERVAL 2 HOURS FROM events))", 1)
_REFUSED = " SELECT event_id, job, command, nullif(status, '') AS status FROM r WHERE n > 0 AND NOT accepted"


STATES, REJECTED = FOLD + _LAST, FOLD + _REFUSED
STATES_THEN, REJECTED_THEN = FOLDED_SQL + _LAST, FOLDED_SQL + _REFUSED


@query("st03_job_states", STATES)
def st03(t):
    """Each job's state after its commands, folded in time order."""
    return twins.last_states(twins.fold_commands(twins.commands_of(t("events"))), twins.commands_of(t("events")))


@query("st03_rejected_commands", REJECTED)
def st03_rejected(t):
    return twins.rejected_commands(twins.fold_commands(twins.commands_of(t("events"))))
