"""The job queue: claims, live state, reaping, fairness, retries, cron."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BACKOFF_BASE_MS, BACKOFF_CAP_MS = 2_000, 900_000
#: Slots of the worker classes; fixed values.
SLOTS = {"io": 4, "cpu": 2, "gpu": 1}


def claimable(jobs: DataFrame, leases: DataFrame, now_ms: int) -> DataFrame:
    """Queued jobs that are due and not leased; a lease that has expired still blocks until it is reaped."""
    due = jobs.where((F.col("state") == "queued") & (F.col("run_at_ts_ms") <= now_ms))
    return due.join(leases.select("job_id"), "job_id", "left_anti")


def claims(jobs: DataFrame, leases: DataFrame, now_ms: int, per_class: int = 1) -> DataFrame:
    """The next jobs of each class by priority, then age.

    row_number with a small bound is planned as a per-partition top-k before the shuffle, so a class of millions
    sends a few rows.
    """
    w = Window.partitionBy("class").orderBy("priority_rank", "enqueued_seq", "job_id")
    return claimable(jobs, leases, now_ms).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= per_class)


def live_state(jobs: DataFrame, leases: DataFrame, now_ms: int) -> DataFrame:
    """jobs with what they are doing: a lease counts only while it lasts."""
    held = leases.where(F.col("expires_ts_ms") > now_ms).select(F.col("job_id").alias("leased"))
    joined = jobs.join(held, F.col("job_id") == F.col("leased"), "left")
    state = F.when(F.col("state").isin("done", "dead"), F.col("state")).when(F.col("leased").isNotNull(), "running").when(F.col("attempt_count") > 0, "failed").otherwise("queued")
    return joined.withColumn("live_state", state).drop("leased")


def reap(jobs: DataFrame, leases: DataFrame, now_ms: int, attempts_max: int = 3) -> DataFrame:
    """What to do with each expired lease: release it where there is no job, else retry or bury the job."""
    expired = leases.where(F.col("expires_ts_ms") <= now_ms)
    joined = expired.join(jobs.select("job_id", "state", "attempt_count"), "job_id", "left")
    action = F.when(F.col("state").isNull() | F.col("state").isin("done", "dead"), "release").when(F.col("attempt_count") + 1 > attempts_max, "dead").otherwise("retry")
    return joined.select("job_id", "worker", action.alias("action"))


def lease_rows(claimed: DataFrame, worker: Column, now_ms: int, ttl_ms: int) -> DataFrame:
    """The leases that claims insert: job_id, worker, expires_ts_ms. Claims hold no leased job, so the insert is strict by construction."""
    return claimed.select("job_id", worker.alias("worker"), (F.lit(now_ms) + ttl_ms).alias("expires_ts_ms"))


def settled(jobs: DataFrame, leases: DataFrame, reports: DataFrame, now_ms: int, attempts_max: int = 3) -> DataFrame:
    """reports (job_id, worker, outcome: complete or fail) with the job's new state and attempt_count, and whether its lease is released.

    A report counts only if its worker holds the job's lease and the lease is alive; else it is refused and nothing changes.
    """
    live = leases.where(F.col("expires_ts_ms") > now_ms).select(F.col("job_id").alias("_job"), F.col("worker").alias("_worker"))
    joined = reports.join(jobs.select("job_id", "attempt_count"), "job_id").join(live, (F.col("job_id") == F.col("_job")) & (F.col("worker") == F.col("_worker")), "left")
    heard, tried = F.col("_job").isNotNull(), F.col("attempt_count") + 1
    state = F.when(~heard, "refused").when(F.col("outcome") == "complete", "done").when(tried > attempts_max, "dead").otherwise("queued")
    return joined.select("job_id", state.alias("state"), F.when(heard, tried).otherwise(F.col("attempt_count")).alias("attempt_count"), heard.alias("released"))


def superseded(waiting: DataFrame, work: list[str], order: str) -> DataFrame:
    """waiting jobs with superseded: all but the newest for the same work. The newest is an aggregate joined back, so that a hot key can be split."""
    newest = waiting.groupBy(*(F.col(c).alias(f"_{c}") for c in work)).agg(F.max(order).alias("_newest"))
    same = F.lit(True)
    for c in work:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return waiting.join(newest, same).withColumn("superseded", F.col(order) < F.col("_newest")).drop("_newest", *(f"_{c}" for c in work))


def backoff_window(attempt: Column) -> Column:
    """Milliseconds up to which a retry may wait: doubling from the base, capped."""
    return F.least(F.lit(BACKOFF_BASE_MS) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30)) - 1), F.lit(float(BACKOFF_CAP_MS))).cast("long")


def interleaved(jobs: DataFrame) -> DataFrame:
    """A fair order over projects: each project's first job before any second one."""
    own = Window.partitionBy("project").orderBy("priority_rank", "enqueued_seq")
    return jobs.withColumn("round", F.row_number().over(own))


# Cron: five fields; lists, ranges and steps; Sunday is 0 or 7.
FIELDS = ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))


def parse_cron(text: str) -> tuple[frozenset[int], ...]:
    parts = text.split()
    if len(parts) != 5:
        raise ValueError(f"five fields are needed: {text!r}")
    out = []
    for part, (low, high) in zip(parts, FIELDS, strict=True):
        values: set[int] = set()
        for item in part.split(","):
            span, _, step = item.partition("/")
            a, _, b = span.partition("-")
            first, last = (low, high) if span == "*" else (int(a), int(b) if b else (high if step else int(a)))
            if not low <= first <= last <= high or (step and int(step) < 1):
                raise ValueError(f"out of range: {item!r}")
            values |= set(range(first, last + 1, int(step or 1)))
        out.append(frozenset(values))
    return (*out[:4], frozenset(v % 7 for v in out[4]))


#: Years that the search for one firing goes ahead: no two leap days are further apart.
CRON_YEARS_MAX = 8


def next_minute(fields: tuple[frozenset[int], ...], days_both: bool, at: datetime) -> datetime | None:
    """The first minute at or after a local time that fits the fields: what does not fit carries into the next month, day, hour or minute.

    days_both: the day fits by the month or the week (both are restricted), else by both.
    """
    minutes, hours, days, months, week = fields
    last = at.year + CRON_YEARS_MAX
    while at.year <= last:
        in_month, in_week = at.day in days, at.isoweekday() % 7 in week
        if at.month not in months:
            at = (at.replace(day=1, hour=0, minute=0) + timedelta(days=32)).replace(day=1)
        elif not (in_month or in_week if days_both else in_month and in_week):
            at = at.replace(hour=0, minute=0) + timedelta(days=1)
        elif at.hour not in hours:
            at = at.replace(minute=0) + timedelta(hours=1)
        elif at.minute not in minutes:
            at += timedelta(minutes=1)
        else:
            return at
    return None


def firings(cron: str, zone: str, after_ms: int, limit: int) -> Iterator[int]:
    """The next firings in Unix ms, each searched anew from the one before. A local time that a clock change skips fires as much later as the change skips; one that it repeats fires the first time."""
    fields, tz = parse_cron(cron), ZoneInfo(zone)
    days_both = cron.split()[2] != "*" and cron.split()[4] != "*"
    found = 0
    while found < limit:
        local = datetime.fromtimestamp(after_ms / 1000, tz).replace(tzinfo=None, second=0, microsecond=0, fold=0)
        fire_ms = after_ms
        while fire_ms <= after_ms:  # minutes that the clock repeats have fired already
            local = next_minute(fields, days_both, local + timedelta(minutes=1))
            if local is None:
                return
            fire_ms = int(local.replace(tzinfo=tz).timestamp()) * 1000
        yield fire_ms
        after_ms, found = fire_ms, found + 1


def cron_preview(crons: DataFrame, limit: int = 8) -> DataFrame:
    """cron_id, turn, fire_ms: the next firings of each cron (cron_id, expr, tz, after_ms); a few rows per cron."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            rows = [(r.cron_id, k, ms) for r in pdf.itertuples() for k, ms in enumerate(firings(r.expr, r.tz, r.after_ms, limit), 1)]
            yield pd.DataFrame(rows, columns=["cron_id", "turn", "fire_ms"])

    return crons.select("cron_id", "expr", "tz", "after_ms").mapInPandas(run, "cron_id long, turn int, fire_ms long")
