"""Stages in a chain, runs with all their kinds of events, budgets, leases, and rendered artifacts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import queue
from loomlake.plans import fold, stages
from loomlake.queries.logs import USERS
from loomlake.queries.texts import _chunk_sql, threads
from loomlake.registry import query
from loomlake.sources.tables import JOBS_SQL, LEASES_SQL, LOG_SQL, NOW_MS, event_log, jobs, leases, table

CHUNKS_SQL = _chunk_sql("(w.b - w.a >= 1200)").rsplit("\nSELECT conv_id, row_number()", 1)[0]


@query(f"""{CHUNKS_SQL}, ch AS (SELECT p.conv_id AS item, row_number() OVER (PARTITION BY p.conv_id ORDER BY byte_start) - 1 AS ordinal, substr(hex(encode(t.text)), CAST(2 * byte_start + 1 AS BIGINT), CAST(2 * (least(byte_start + 1600, b) - byte_start) AS BIGINT)) AS content FROM p JOIN threads t ON p.conv_id = t.conv_id),
hs AS (SELECT item, ordinal, sha256(content) AS content_hash, list_transform(range(0, 8), lambda k: CAST(CAST('0x' || substr(md5(content), CAST(4 * k + 1 AS BIGINT), 4) AS BIGINT) + 1 AS DOUBLE)) AS v FROM ch)
SELECT item, ordinal, content_hash, CASE WHEN content_hash IN (SELECT content_hash FROM hs WHERE item % 2 = 0) THEN 'reused' ELSE 'computed' END AS outcome, round(v[1] / sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS first FROM hs""")
def ingest_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalise, segment, chunk and embed in one chain; what an earlier run embedded (here every second item) is reused by content."""
    items = threads(spark, sf_dir).select(F.col("conv_id").alias("item"), "text")
    chunks = stages.DEFAULT.run(items, ["normalize", "chunk"])
    known = stages.hashed_embedder(stages.DEFAULT.run(items.where("item % 2 = 0"), ["normalize", "chunk"]).select("content_hash", "content").dropDuplicates(["content_hash"]))
    return stages.embed(chunks, known).select("item", "ordinal", "content_hash", "outcome", F.round(F.get("vector", 0), 6).alias("first"))


@query(f"""{CHUNKS_SQL}, loc_sp AS (SELECT conv_id, unnest(string_split(text, chr(10) || chr(10))) AS part, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS k FROM threads),
loc_sl AS (SELECT *, coalesce(sum(length(part) - length(replace(part, chr(10), '')) + 2) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line, regexp_extract(part, '^\\s*') AS lead, regexp_replace(part, '\\s*$', '') AS body FROM loc_sp),
loc_sk AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY k) - 1 AS idx, CAST(line + length(lead) - length(replace(lead, chr(10), '')) AS BIGINT) AS first, CAST(line + length(body) - length(replace(body, chr(10), '')) AS BIGINT) AS last FROM loc_sl WHERE trim(part) <> '')
SELECT p.conv_id AS item, row_number() OVER (PARTITION BY p.conv_id ORDER BY byte_start) - 1 AS ordinal, 'line' AS locator_kind, a.first AS locator_first, z.last AS locator_last FROM p JOIN loc_sk a ON a.conv_id = p.conv_id AND a.idx = p.i JOIN loc_sk z ON z.conv_id = p.conv_id AND z.idx = p.j""")
def chunk_locators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where in its item every chunk of the chain comes from."""
    items = threads(spark, sf_dir).select(F.col("conv_id").alias("item"), "text")
    return stages.DEFAULT.run(items, ["normalize", "chunk"]).select("item", "ordinal", "locator_kind", "locator_first", "locator_last")


#: Kinds of a run's events, in the order in which the queries deal them out.
RUN_KINDS = ("RunStarted", "RunStepCommitted", "RunToolEffectRecorded", "RunCheckpointSaved", "RunValidationRecorded", "RunPauseRequested", "RunPaused", "RunResumed", "RunCancelRequested", "RunCanceled", "RunTaintRaised", "RunQuestionAsked", "RunQuestionAnswered", "RunFinished")
NULL_TEXT = "CAST(NULL AS STRING)"
#: A run's row: the state machine as columns, all kinds of events.
RUNS = fold.Table(
    key=("run",),
    columns={
        "status": fold.Last({"RunStarted": "'running'", "RunStepCommitted": "CASE seq % 3 WHEN 0 THEN 'preflight' WHEN 1 THEN 'running' ELSE 'validating' END", "RunPaused": "'paused'", "RunResumed": "'running'", "RunCanceled": "'canceled'", "RunQuestionAsked": "'waiting_input'", "RunQuestionAnswered": "'running'", "RunFinished": "CASE seq % 2 WHEN 0 THEN 'finished' ELSE 'failed' END"}),
        "pending_control": fold.Last({"RunPauseRequested": "'pause'", "RunCancelRequested": "'cancel'", "RunPaused": NULL_TEXT, "RunResumed": NULL_TEXT, "RunCanceled": NULL_TEXT}),
        "committed_step_count": fold.Total({"RunStepCommitted": "CAST(1 AS BIGINT)"}, nulls_as_zero=True),
        "checkpointed_step_count": fold.Total({"RunCheckpointSaved": "CAST(1 AS BIGINT)"}, nulls_as_zero=True),
        "checkpoint_seq": fold.Last({"RunCheckpointSaved": "seq"}),
        "validation_seq": fold.Last({"RunValidationRecorded": "seq"}),
        "tainted": fold.Last({"RunStarted": "CAST(0 AS BIGINT)", "RunTaintRaised": "CAST(1 AS BIGINT)"}),
        "question_seq": fold.Last({"RunQuestionAsked": "seq", "RunQuestionAnswered": "CAST(NULL AS BIGINT)"}),
        "finished_seq": fold.Last({"RunCanceled": "seq", "RunFinished": "seq"}),
        "spent_tokens": fold.Total({"RunToolEffectRecorded": "amount"}, nulls_as_zero=True),
        "spent_tool_calls": fold.Total({"RunToolEffectRecorded": "CAST(1 AS BIGINT)"}, nulls_as_zero=True),
    },
    creates=("RunStarted",),
)
_PICK = "CAST('0x' || substr(md5(CAST(seq AS VARCHAR)), 1, 7) AS BIGINT)"


def run_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of runs: users as runs, kinds dealt out by a hash of seq."""
    pick = F.conv(F.substring(F.md5(F.col("seq").cast("string")), 1, 7), 16, 10).cast("long") % len(RUN_KINDS)
    return event_log(spark, sf_dir).select(F.col("entity").alias("run"), "seq", "amount", F.get(F.array(*map(F.lit, RUN_KINDS)), pick.cast("int")).alias("kind"))


def _last(values: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v.replace('STRING', 'VARCHAR')}" for k, v in values.items())
    return f"max_by(struct_pack(v := CASE kind {cases} END), seq) FILTER (kind IN ({', '.join(repr(k) for k in values)}))"


def _runs_sql() -> str:
    cols = []
    for name, c in RUNS.columns.items():
        if isinstance(c, fold.Total):
            (kind, delta), = c.kinds.items()
            cols.append(f"CAST(coalesce(sum({delta}) FILTER (kind = '{kind}'), 0) AS BIGINT) AS {name}")
        else:
            cols.append(f"struct_extract({_last(c.kinds)}, 'v') AS {name}")
    kinds = ", ".join(repr(k) for k in RUN_KINDS)
    return f"""WITH {LOG_SQL}, r AS (SELECT entity AS run, seq, amount, [{kinds}][{_PICK} % {len(RUN_KINDS)} + 1] AS kind FROM log), b AS (SELECT run, min(seq) AS born FROM r WHERE kind = 'RunStarted' GROUP BY run)
SELECT r.run, {', '.join(cols)} FROM r JOIN b ON r.run = b.run WHERE seq >= born GROUP BY r.run"""


@query(_runs_sql())
def run_state_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs as they stand, from all fourteen kinds of their events in one aggregation."""
    return fold.fold(run_log(spark, sf_dir), RUNS)


#: Dimensions of a run's budget in the order in which they are checked, with the limits of the queries; fixed order.
BUDGET = {"tokens": 45_000, "usd_micros": 60_000_000, "wall_ms": 950, "storage_bytes": 2_100, "tool_calls": 6, "retries": 7, "steps": 46}
_USED = {"tokens": "l_orderkey % 50000", "usd_micros": "CAST(floor(l_extendedprice) AS BIGINT) * 1000", "wall_ms": "l_partkey % 1000", "storage_bytes": "l_partkey % 2200", "tool_calls": "CAST(l_linenumber AS BIGINT)", "retries": "CAST(floor(l_discount * 100) AS BIGINT)", "steps": "CAST(floor(l_quantity) AS BIGINT)"}


def _first_over(total: str) -> str:
    return "CASE " + " ".join(f"WHEN {total.format(d=d)} > {limit} THEN '{d}'" for d, limit in BUDGET.items()) + " ELSE 'admitted' END"


@query(f"""WITH u AS (SELECT {', '.join(f'{e} AS {d}' for d, e in _USED.items())} FROM lineitem) SELECT {_first_over('{d} + ({d} // 20)')} AS outcome, count(*) AS n FROM u GROUP BY 1""")
def budget_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven dimensions in fixed order: what is spent and what is asked for (a twentieth more) against the limit; the first that it exceeds names the refusal, an overflow refuses."""
    u = table(spark, sf_dir, "lineitem").select(*(F.expr(e).alias(d) for d, e in _USED.items()))
    outcome = F.lit("admitted")
    for d, limit in reversed(BUDGET.items()):
        total = F.try_add(F.col(d), F.floor(F.col(d) / 20))
        outcome = F.when(F.coalesce(total > limit, F.lit(True)), d).otherwise(outcome)
    return u.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT l_linenumber % 2 AS half, CAST(floor(l_quantity) AS BIGINT) AS tokens, l_partkey % 1000 AS wall_ms, CAST(l_linenumber AS BIGINT) AS tool_calls, 20 + l_suppkey % 40 AS reserved_tokens, 500 + l_suppkey % 500 AS reserved_wall_ms, 1 + l_suppkey % 7 AS reserved_tool_calls FROM lineitem)
SELECT CASE WHEN tokens > reserved_tokens THEN 'tokens' WHEN wall_ms > reserved_wall_ms THEN 'wall_ms' WHEN tool_calls > reserved_tool_calls THEN 'tool_calls' ELSE 'within' END AS outcome, count(*) AS n FROM r GROUP BY 1""")
def reservation_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call used against what had been reserved for it, by dimension; the first that it exceeds is named."""
    used = {"tokens": F.floor("l_quantity").cast("long"), "wall_ms": F.col("l_partkey") % 1000, "tool_calls": F.col("l_linenumber").cast("long")}
    reserved = {"tokens": 20 + F.col("l_suppkey") % 40, "wall_ms": 500 + F.col("l_suppkey") % 500, "tool_calls": 1 + F.col("l_suppkey") % 7}
    outcome = F.coalesce(*(F.when(used[d] > reserved[d], d) for d in used), F.lit("within"))
    return table(spark, sf_dir, "lineitem").groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"))


#: Rows of calls and ledger that one task counts, about.
CALLS = 1_000_000


@query("""WITH c AS (SELECT l_orderkey * 8 + l_linenumber AS call, l_returnflag AS feature, l_partkey FROM lineitem), d AS (SELECT call, any_value(feature) AS feature, count(*) AS calls FROM c GROUP BY call),
l AS (SELECT call, sum(CASE WHEN l_partkey % 97 = 0 THEN 0 WHEN l_partkey % 101 = 0 THEN 2 ELSE 1 END) AS entries FROM c GROUP BY call)
SELECT CASE WHEN l.entries < d.calls THEN 'missing' WHEN l.entries > d.calls THEN 'surplus' ELSE 'balanced' END AS verdict, count(*) AS calls FROM d JOIN l ON d.call = l.call GROUP BY 1""")
def dispatch_ledger_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dispatched call has exactly one ledger row; here a ledger that lost some rows and wrote others twice."""
    call = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("call")
    lines = table(spark, sf_dir, "lineitem")
    dispatched = lines.select(call, F.lit(1).alias("calls"), F.lit(0).alias("entries"))
    copies = F.when(F.col("l_partkey") % 97 == 0, 0).when(F.col("l_partkey") % 101 == 0, 2).otherwise(1)
    ledger = lines.select(call, F.explode(F.array_repeat(F.lit(1), copies)).alias("row")).select("call", F.lit(0).alias("calls"), F.lit(1).alias("entries"))
    # Both sides are counted in one aggregation, of about CALLS rows a task whatever the size; a call without a number equals none.
    tasks = max(1, -(-2 * lines.count() // CALLS))
    both = dispatched.unionByName(ledger).where("call IS NOT NULL").repartition(tasks, "call")
    both = both.groupBy("call").agg(F.sum("calls").alias("calls"), F.sum("entries").alias("entries"))
    verdict = F.when(F.col("entries") < F.col("calls"), "missing").when(F.col("entries") > F.col("calls"), "surplus").otherwise("balanced")
    return both.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("calls"))


@query(f"""WITH {JOBS_SQL}, {LEASES_SQL}, r AS (SELECT job_id, (worker + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS worker, CASE WHEN job_id % 4 = 0 THEN 'fail' ELSE 'complete' END AS outcome FROM leases WHERE job_id % 2 = 0)
SELECT r.job_id, CASE WHEN l.job_id IS NULL THEN 'refused' WHEN outcome = 'complete' THEN 'done' WHEN attempt_count + 1 > 3 THEN 'dead' ELSE 'queued' END AS state, CASE WHEN l.job_id IS NULL THEN attempt_count ELSE attempt_count + 1 END AS attempt_count, l.job_id IS NOT NULL AS released
FROM r JOIN jobs ON r.job_id = jobs.job_id LEFT JOIN leases l ON r.job_id = l.job_id AND r.worker = l.worker AND l.expires_ts_ms > {NOW_MS}""")
def job_settlement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workers report what became of their jobs; only who holds a live lease is heard, and the lease is released."""
    worker = (F.col("worker") + F.when(F.col("job_id") % 5 == 0, 1).otherwise(0)) % 4
    held = leases(spark, sf_dir)
    reports = held.where("job_id % 2 = 0").select("job_id", worker.alias("worker"), F.when(F.col("job_id") % 4 == 0, "fail").otherwise("complete").alias("outcome"))
    return queue.settled(jobs(spark, sf_dir), held, reports, NOW_MS).select("job_id", "state", "attempt_count", "released")


@query(f"""WITH {JOBS_SQL}, {LEASES_SQL}, c AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY priority_rank, enqueued_seq, job_id) AS turn FROM jobs WHERE state = 'queued' AND run_at_ts_ms <= {NOW_MS} AND NOT EXISTS (SELECT 1 FROM leases l WHERE l.job_id = jobs.job_id))
SELECT job_id, class || '-' || turn AS worker, {NOW_MS} + 60000 AS expires_ts_ms FROM c WHERE turn <= 2""")
def claim_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lease rows that claims insert: two workers of each class."""
    best = queue.claims(jobs(spark, sf_dir), leases(spark, sf_dir), NOW_MS, 2)
    return queue.lease_rows(best, F.concat_ws("-", "class", "turn"), NOW_MS, 60_000)


@query(f"""WITH {JOBS_SQL}, q AS (SELECT job_id, project, class, row_number() OVER (PARTITION BY project, class, job_id % 50 ORDER BY enqueued_seq DESC) AS age FROM jobs WHERE state = 'queued') SELECT job_id, age > 1 AS superseded FROM q""")
def supersede_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of queued jobs for the same work only the newest stays."""
    waiting = jobs(spark, sf_dir).where("state = 'queued'").withColumn("slot", F.col("job_id") % 50)
    return queue.superseded(waiting, ["project", "class", "slot"], "enqueued_seq").select("job_id", "superseded")


@query(f"""WITH {LOG_SQL} SELECT 'users' AS name, 'CREATE TABLE users (entity BIGINT, last_view BIGINT, last_touch BIGINT, first_purchase BIGINT, spent BIGINT, errors BIGINT) USING PARQUET' AS ddl, count(DISTINCT entity) AS rows FROM log WHERE kind IN ('view', 'click', 'purchase', 'error')""")
def ddl_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The definition of a folded table, from its schema, and the rows that it is for."""
    users = fold.fold(event_log(spark, sf_dir), USERS)
    return users.agg(F.lit("users").alias("name"), F.lit(fold.ddl("users", users)).alias("ddl"), F.count("*").alias("rows"))


@query("""WITH c AS (SELECT lang AS suite, contains(lower(text), 'license') = contains(text, 'License') AS same FROM documents), s AS (SELECT suite, count(*) FILTER (same) AS passed, count(*) FILTER (NOT same) AS failed FROM c GROUP BY suite)
SELECT suite, '{"suite":"' || suite || '","passed":' || passed || ',"failed":' || failed || '}' AS json, '| ' || suite || ' | ' || passed || ' | ' || failed || ' |' AS markdown FROM s""")
def eval_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An evaluation's report, a line of JSON and of a markdown table for each suite."""
    c = table(spark, sf_dir, "documents").select(F.col("lang").alias("suite"), (F.contains(F.lower("text"), F.lit("license")) == F.contains("text", F.lit("License"))).alias("same"))
    s = c.groupBy("suite").agg(F.count_if("same").alias("passed"), F.count_if(~F.col("same")).alias("failed"))
    return s.select("suite", F.to_json(F.struct("suite", "passed", "failed")).alias("json"), F.concat(F.lit("| "), F.concat_ws(" | ", "suite", "passed", "failed"), F.lit(" |")).alias("markdown"))
