"""Queries on the job queue and its crons."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators import queue
from loomlake.registry import query
from loomlake.sources.tables import JOBS_SQL, LEASES_SQL, NOW_MS, jobs, leases, table

J = f"WITH {JOBS_SQL}, {LEASES_SQL}"


@query(f"""{J}, c AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY priority_rank, enqueued_seq, job_id) AS turn FROM jobs WHERE state = 'queued' AND run_at_ts_ms <= {NOW_MS} AND NOT EXISTS (SELECT 1 FROM leases l WHERE l.job_id = jobs.job_id))
SELECT job_id, class, priority_rank, CAST(turn AS INTEGER) AS turn FROM c WHERE (class = 'io' AND turn <= 4) OR (class = 'cpu' AND turn <= 2) OR (class = 'gpu' AND turn <= 1)""")
def claim_anti_join_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many jobs per class as it has slots."""
    best = queue.claims(jobs(spark, sf_dir), leases(spark, sf_dir), NOW_MS, max(queue.SLOTS.values()))
    slots = F.lit(0)
    for name, n in queue.SLOTS.items():
        slots = F.when(F.col("class") == name, n).otherwise(slots)
    return best.where(F.col("turn") <= slots).select("job_id", "class", "priority_rank", "turn")


@query(f"""{J} SELECT class, live_state, count(*) AS n FROM (SELECT jobs.*, CASE WHEN state IN ('done', 'dead') THEN state WHEN l.job_id IS NOT NULL THEN 'running' WHEN attempt_count > 0 THEN 'failed' ELSE 'queued' END AS live_state
FROM jobs LEFT JOIN (SELECT * FROM leases WHERE expires_ts_ms > {NOW_MS}) l ON jobs.job_id = l.job_id) GROUP BY ALL""")
def live_state_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queue.live_state(jobs(spark, sf_dir), leases(spark, sf_dir), NOW_MS).groupBy("class", "live_state").agg(F.count("*").alias("n"))


@query(f"""{J}, x AS (SELECT job_id + CASE WHEN job_id % 7 = 0 THEN 100000000 ELSE 0 END AS job_id, worker FROM leases WHERE expires_ts_ms <= {NOW_MS})
SELECT x.job_id, worker, CASE WHEN state IS NULL OR state IN ('done', 'dead') THEN 'release' WHEN attempt_count + 1 > 3 THEN 'dead' ELSE 'retry' END AS action FROM x LEFT JOIN jobs ON x.job_id = jobs.job_id""")
def reap_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = leases(spark, sf_dir).withColumn("job_id", F.col("job_id") + F.when(F.col("job_id") % 7 == 0, 100000000).otherwise(0))
    return queue.reap(jobs(spark, sf_dir), held, NOW_MS)


@query(f"""{J}, r AS (SELECT job_id, project, row_number() OVER (PARTITION BY project ORDER BY priority_rank, enqueued_seq) AS round FROM jobs WHERE state = 'queued')
SELECT job_id, project, CAST(round AS INTEGER) AS round, row_number() OVER (ORDER BY round, project) AS position FROM r ORDER BY round, project LIMIT 100""")
def fair_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 100 claims when projects take turns."""
    rounds = queue.interleaved(jobs(spark, sf_dir).where("state = 'queued'")).select("job_id", "project", "round").where("round <= 100")  # the bound cuts before the shuffle
    first = rounds.orderBy("round", "project").limit(100)
    return first.withColumn("position", F.row_number().over(Window.orderBy("round", "project")).cast("long"))


@query(f"{J} SELECT job_id, attempt_count, CAST(least(2000 * pow(2, attempt_count - 1), 900000) AS BIGINT) AS window_ms FROM jobs WHERE attempt_count > 0")
def backoff_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    j = jobs(spark, sf_dir).where("attempt_count > 0")
    return j.select("job_id", "attempt_count", queue.backoff_window(F.col("attempt_count")).alias("window_ms"))


@query(f"""{J} SELECT job_id, attempt_count, attempt_count >= 3 AS stage_dead, attempt_count > 3 AS job_dead, CASE WHEN job_id % 13 = 0 THEN 'permanent' WHEN attempt_count > 3 THEN 'attempts_exhausted' ELSE 'retry' END AS verdict FROM jobs WHERE state = 'queued'""")
def failure_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stage dies at its last attempt, a job after it; permanent failures die at once."""
    j, n = jobs(spark, sf_dir).where("state = 'queued'"), F.col("attempt_count")
    verdict = F.when(F.col("job_id") % 13 == 0, "permanent").when(n > 3, "attempts_exhausted").otherwise("retry")
    return j.select("job_id", "attempt_count", (n >= 3).alias("stage_dead"), (n > 3).alias("job_dead"), verdict.alias("verdict"))


@query(f"{J}, n AS (SELECT md5(project || ':' || class || ':' || (job_id % 500)) AS job_key, job_id FROM jobs) SELECT job_key, min(job_id) AS job_id, count(*) - 1 AS duplicates FROM n GROUP BY job_key")
def enqueue_idempotent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs of the same derived id are one job: the first that came."""
    key = F.md5(F.concat_ws(":", "project", "class", (F.col("job_id") % 500).cast("string")))
    return jobs(spark, sf_dir).groupBy(key.alias("job_key")).agg(F.min("job_id").alias("job_id"), (F.count("*") - 1).alias("duplicates"))


@query(f"""{J}, q AS (SELECT * FROM jobs WHERE state = 'queued' AND class = 'io' ORDER BY enqueued_seq DESC, job_id LIMIT 50)
SELECT q.job_id, project, CASE WHEN l.job_id IS NOT NULL THEN 'running' WHEN attempt_count > 0 THEN 'failed' ELSE 'queued' END AS live_state, (SELECT count(*) FROM jobs WHERE state = 'queued' AND class = 'io') AS depth
FROM q LEFT JOIN (SELECT * FROM leases WHERE expires_ts_ms > {NOW_MS}) l ON q.job_id = l.job_id""")
def job_list_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest jobs of a class with live state and the depth of its queue: the page first, then its leases."""
    mine = jobs(spark, sf_dir).where("state = 'queued' AND class = 'io'")
    page = mine.orderBy(F.desc("enqueued_seq"), "job_id").limit(50)
    depth = mine.agg(F.count("*").alias("depth"))
    return queue.live_state(page, leases(spark, sf_dir), NOW_MS).join(F.broadcast(depth)).select("job_id", "project", "live_state", "depth")


@query("""WITH c AS (SELECT c_custkey AS cron_id, 60000 * (5 + c_custkey % 50) AS every_ms, 1700000000000 + c_custkey * 1000 AS last_ms FROM customer)
SELECT cron_id, last_ms + every_ms * least((1700010000000 - last_ms) // every_ms, 512) AS fire_ms, least((1700010000000 - last_ms) // every_ms, 512) - 1 AS missed FROM c WHERE (1700010000000 - last_ms) // every_ms >= 1""")
def missed_firing_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all firings since the watermark only the latest fires; the others are counted as missed. The scan is bounded by 512."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("cron_id"), (60000 * (5 + F.col("c_custkey") % 50)).alias("every_ms"), (1700000000000 + F.col("c_custkey") * 1000).alias("last_ms"))
    due = F.least(F.floor((1700010000000 - F.col("last_ms")) / F.col("every_ms")), F.lit(512))
    fired = c.where(due >= 1).select("cron_id", F.explode(F.sequence(F.lit(1).cast("long"), due)).alias("k"), "last_ms", "every_ms")
    return fired.groupBy("cron_id").agg(F.max(F.col("last_ms") + F.col("every_ms") * F.col("k")).alias("fire_ms"), (F.count("*") - 1).alias("missed"))


@query(f"""{J}, f AS (SELECT DISTINCT project, CASE WHEN substr(project, 2) IN ('1', '2', '3', '4', '5') THEN 'skip' WHEN substr(project, 2) IN ('6', '7', '8') THEN 'queue' ELSE 'cancel_previous' END AS policy FROM jobs),
r AS (SELECT project, min(jobs.job_id) AS live FROM jobs JOIN leases ON jobs.job_id = leases.job_id WHERE expires_ts_ms > {NOW_MS} AND jobs.job_id % 50 = 0 GROUP BY project)
SELECT f.project, policy, CASE WHEN live IS NULL THEN 'enqueue' WHEN policy = 'skip' THEN 'skip' WHEN policy = 'queue' THEN 'enqueue' ELSE 'cancel_and_enqueue' END AS action, live FROM f LEFT JOIN r ON f.project = r.project""")
def cron_overlap_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a firing does where the cron's previous job is still alive."""
    j = jobs(spark, sf_dir)
    number = F.substring("project", 2, 10)
    policy = F.when(number.isin("1", "2", "3", "4", "5"), "skip").when(number.isin("6", "7", "8"), "queue").otherwise("cancel_previous")
    firing = j.select("project").distinct().withColumn("policy", policy)
    live = j.join(leases(spark, sf_dir).where(F.col("expires_ts_ms") > NOW_MS), "job_id").where("job_id % 50 = 0").groupBy("project").agg(F.min("job_id").alias("live"))
    action = F.when(F.col("live").isNull(), "enqueue").when(F.col("policy") == "skip", "skip").when(F.col("policy") == "queue", "enqueue").otherwise("cancel_and_enqueue")
    return firing.join(live, "project", "left").select("project", "policy", action.alias("action"), "live")


#: The crons of the query and what their fields allow (months and days of the week: all, if empty), as the SQL reads it: fixed values.
ZONES = ("UTC", "Europe/Berlin", "America/New_York", "Asia/Kolkata", "Australia/Lord_Howe")
CRONS = {
    "30 2 * * *": "minute = 30 AND hour = 2",
    "*/15 9-17 * * 1-5": "minute % 15 = 0 AND hour BETWEEN 9 AND 17 AND isodow <= 5",
    "0 0 1,15 * *": "minute = 0 AND hour = 0 AND day IN (1, 15)",
    "5 4 * * 7": "minute = 5 AND hour = 4 AND isodow = 7",
    "0 12 29 2 *": "minute = 0 AND hour = 12 AND day = 29 AND month = 2",
}
CRON_AFTER_MS = 1711700000000
_FITS = " ".join(f"WHEN {k} THEN {fits}" for k, fits in enumerate(CRONS.values()))


@query(f"""WITH c AS (SELECT CAST(n_nationkey AS BIGINT) AS cron_id, n_nationkey % 5 AS which, [{', '.join(map(repr, ZONES))}][n_nationkey // 5 + 1] AS tz FROM nation),
d AS (SELECT CAST(d AS DATE) AS d, isodow(d) AS isodow, day(d) AS day, month(d) AS month FROM (SELECT unnest(generate_series(DATE '2024-03-28', DATE '2064-03-28', INTERVAL 1 DAY)) AS d)),
h AS (SELECT h.hour, m.minute FROM range(0, 24) h(hour), range(0, 60, 5) m(minute)),
l AS (SELECT cron_id, tz, d + to_hours(hour) + to_minutes(minute) AS local FROM c, d, h WHERE (which = 4 OR d < DATE '2024-08-28') AND CASE which {_FITS} END),
u AS (SELECT cron_id, tz, local, timezone(tz, local) AS t FROM l),
f AS (SELECT DISTINCT cron_id, epoch_ms(CASE WHEN timezone(tz, t - INTERVAL 60 MINUTE) = local THEN t - INTERVAL 60 MINUTE WHEN timezone(tz, t - INTERVAL 30 MINUTE) = local THEN t - INTERVAL 30 MINUTE ELSE t END) AS fire_ms FROM u)
SELECT cron_id, CAST(row_number() OVER (PARTITION BY cron_id ORDER BY fire_ms) AS INTEGER) AS turn, fire_ms FROM f WHERE fire_ms > {CRON_AFTER_MS} QUALIFY turn <= 8""")
def cron_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next eight firings of each nation's cron in its time zone, clock changes included; a leap day's take 28 years."""
    n = table(spark, sf_dir, "nation")
    pick = lambda values, k: F.get(F.array(*map(F.lit, values)), k.cast("int"))
    crons = n.select(F.col("n_nationkey").cast("long").alias("cron_id"), pick(CRONS, F.col("n_nationkey") % 5).alias("expr"), pick(ZONES, F.floor(F.col("n_nationkey") / 5)).alias("tz"), F.lit(CRON_AFTER_MS).alias("after_ms"))
    return queue.cron_preview(crons)
