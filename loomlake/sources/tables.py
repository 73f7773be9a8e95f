"""Tables, and the roles that they play: event log, cost ledger, queue, evidence, threads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_us(ts: Column) -> Column:
    """Microseconds since 1970 of a time without zone, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def micros(amount: Column) -> Column:
    """Money as integer millionths, so that sums do not depend on order."""
    return F.floor(amount * 1000000 + 0.5).cast("long")


def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The append-only log: seq from 1, device, ts_ms, kind, entity (the user), body and amount in micros."""
    events = table(spark, sf_dir, "events")
    return events.select(
        (F.col("event_id") + 1).alias("seq"),
        (F.col("user_id") % 3).alias("device"),
        F.floor(epoch_us(F.col("ts")) / 1000).cast("long").alias("ts_ms"),
        F.col("event_type").alias("kind"),
        F.col("user_id").alias("entity"),
        F.col("props").alias("body"),
        micros(F.col("value")).alias("amount"),
    )


#: The same in DuckDB's SQL, as a common table expression named log.
LOG_SQL = """log AS (SELECT event_id + 1 AS seq, user_id % 3 AS device, epoch_us(ts) // 1000 AS ts_ms, event_type AS kind, user_id AS entity, props AS body,
  CAST(floor(value * 1000000 + 0.5) AS BIGINT) AS amount FROM events)"""


def model_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost ledger: one row per model call."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    joined = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.select(
        F.col("o_orderpriority").alias("project"),
        F.col("l_returnflag").alias("feature"),
        F.nullif(F.col("l_linestatus"), F.lit("O")).alias("agent"),
        F.col("o_orderstatus").alias("model"),
        F.when(F.col("l_tax") >= 0.04, "customer_billed").otherwise("metered").alias("cost_kind"),
        F.floor("l_quantity").cast("long").alias("tokens_in"),
        F.col("l_linenumber").cast("long").alias("tokens_out"),
        (F.col("l_partkey") % 1000).alias("wall_ms"),
        micros(F.col("l_extendedprice")).alias("usd_micros"),
    )


CALLS_SQL = """calls AS (SELECT o_orderpriority AS project, l_returnflag AS feature, nullif(l_linestatus, 'O') AS agent, o_orderstatus AS model,
  CASE WHEN l_tax >= 0.04 THEN 'customer_billed' ELSE 'metered' END AS cost_kind, CAST(floor(l_quantity) AS BIGINT) AS tokens_in, CAST(l_linenumber AS BIGINT) AS tokens_out,
  l_partkey % 1000 AS wall_ms, CAST(floor(l_extendedprice * 1000000 + 0.5) AS BIGINT) AS usd_micros FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job queue: orders as jobs."""
    orders = table(spark, sf_dir, "orders")
    rank = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.select(
        F.col("o_orderkey").alias("job_id"),
        F.concat(F.lit("p"), F.col("o_custkey") % 20).alias("project"),
        F.when(F.col("o_orderstatus") == "F", "done").when(F.col("o_orderstatus") == "P", "dead").otherwise("queued").alias("state"),
        F.when(F.col("o_orderkey") % 7 < 4, "io").when(F.col("o_orderkey") % 7 < 6, "cpu").otherwise("gpu").alias("class"),
        rank.alias("priority_rank"),
        F.col("o_orderkey").alias("enqueued_seq"),
        F.floor(epoch_us(F.col("o_orderdate")) / 1000).cast("long").alias("run_at_ts_ms"),
        (F.col("o_custkey") % 5).alias("attempt_count"),
    )


JOBS_SQL = """jobs AS (SELECT o_orderkey AS job_id, 'p' || (o_custkey % 20) AS project, CASE o_orderstatus WHEN 'F' THEN 'done' WHEN 'P' THEN 'dead' ELSE 'queued' END AS state,
  CASE WHEN o_orderkey % 7 < 4 THEN 'io' WHEN o_orderkey % 7 < 6 THEN 'cpu' ELSE 'gpu' END AS class, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_rank,
  o_orderkey AS enqueued_seq, epoch_us(o_orderdate) // 1000 AS run_at_ts_ms, o_custkey % 5 AS attempt_count FROM orders)"""

#: Order dates end here; the queue's "now" and its leases.
NOW_MS = 870_000_000_000


def leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leases held on some jobs; some have expired."""
    some = jobs(spark, sf_dir).where("state = 'queued' AND job_id % 3 = 0")
    return some.select("job_id", (F.col("job_id") % 4).alias("worker"), (F.lit(NOW_MS) + (F.col("job_id") % 11 - 5) * 60000).alias("expires_ts_ms"))


LEASES_SQL = f"leases AS (SELECT job_id, job_id % 4 AS worker, {NOW_MS} + (job_id % 11 - 5) * 60000 AS expires_ts_ms FROM jobs WHERE state = 'queued' AND job_id % 3 = 0)"


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech segments per conversation: index, times in ms that advance by words, speaker, text."""
    c = table(spark, sf_dir, "conversations")
    return c.select(F.col("conv_id").alias("evidence_id"), F.col("turn").alias("segment_index"), F.col("role").alias("speaker"), F.col("text").alias("asr_text"), F.char_length("text").cast("long").alias("span_ms"))


TRANSCRIPTS_SQL = "transcripts AS (SELECT conv_id AS evidence_id, turn AS segment_index, role AS speaker, text AS asr_text, length(text) AS span_ms FROM conversations)"
