"""Runs under guard, and their counters with overwrites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import log as log_ops
from loomlake.operators import runs as ops
from loomlake.plans import fold
from loomlake.queries.chain import _PICK, run_log
from loomlake.registry import query
from loomlake.sources.tables import LOG_SQL

#: What an event spends or overwrites, by dimension of a run's budget.
USED = {"tokens": "amount % 50000", "usd_micros": "amount", "wall_ms": "amount % 1000", "storage_bytes": "amount % 2200", "tool_calls": "CAST(1 AS BIGINT)", "retries": "seq % 2", "steps": "CAST(1 AS BIGINT)"}
OVERWRITES = ("RunPaused", "RunFinished")
#: A run's seven counters: effects add to them, pauses and ends overwrite them.
SPENT = fold.Table(
    key=("run",),
    columns={f"spent_{d}": fold.Reset({"RunToolEffectRecorded": e}, {k: f"({e}) * 2" for k in OVERWRITES}, nulls_as_zero=True) for d, e in USED.items()},
    creates=("RunStarted",),
)
_KINDS = "[" + ", ".join(repr(k) for k in ops.KINDS) + "]"
_RUNS = f"r AS (SELECT entity AS run, seq, amount, {_KINDS}[{_PICK} % {len(ops.KINDS)} + 1] AS kind FROM log)"


def _spent_sql() -> str:
    sets = ", ".join(repr(k) for k in OVERWRITES)
    columns = ", ".join(f"CAST(coalesce(max_by(({e}) * 2, seq) FILTER (kind IN ({sets})), 0) + coalesce(sum({e}) FILTER (kind = 'RunToolEffectRecorded' AND seq > last), 0) AS BIGINT) AS spent_{d}" for d, e in USED.items())
    return f"""WITH {LOG_SQL}, {_RUNS}, b AS (SELECT run, min(seq) AS born FROM r WHERE kind = 'RunStarted' GROUP BY run),
l AS (SELECT r.*, coalesce(max(CASE WHEN kind IN ({sets}) THEN seq END) OVER (PARTITION BY r.run), 0) AS last FROM r JOIN b ON r.run = b.run WHERE seq >= born)
SELECT run, {columns} FROM l WHERE kind IN ('RunStarted', 'RunToolEffectRecorded', {sets}) GROUP BY run"""


@query(_spent_sql())
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven counters of every run, folded in three parts of the log, each absorbed by the state before."""
    log = run_log(spark, sf_dir)
    top = log.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    state = fold.state(log.where(F.col("seq") <= top // 3), SPENT)
    for a, b in ((top // 3, 2 * top // 3), (2 * top // 3, top)):
        state = fold.absorb(state, log.where((F.col("seq") > a) & (F.col("seq") <= b)), SPENT)
    return fold.finish(state, SPENT)


LIMITS = {"tokens": 90_000, "tool_calls": 3}


def guard_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of runs as its guards read it: a step names its index (every eighth a wrong one), effects spend, pauses and ends overwrite."""
    log = run_log(spark, sf_dir)
    steps = log_ops.numbered(log.where("kind = 'RunStepCommitted'").select("run", "seq"), "seq", by=("run",), name="n")
    index = steps.select(F.col("seq").alias("of"), (F.col("n") - 1 + (F.col("seq") % 8 == 0).cast("long")).alias("step_index"))
    log = log.join(index, F.col("seq") == F.col("of"), "left").drop("of")
    spends = {f"used_{d}": F.when(F.col("kind") == "RunToolEffectRecorded", F.expr(USED[d])) for d in LIMITS}
    sets = {f"set_{d}": F.when(F.col("kind").isin(*OVERWRITES), F.expr(f"({USED[d]}) * 2")) for d in LIMITS}
    return log.withColumns({**spends, **sets}).drop("amount")


def _guards_sql() -> str:
    sets = ", ".join(repr(k) for k in OVERWRITES)
    spent = {d: f"coalesce(first_value(CASE WHEN kind IN ({sets}) THEN ({e}) * 2 END) OVER (PARTITION BY run, era ORDER BY seq), 0) + coalesce(sum(CASE WHEN kind = 'RunToolEffectRecorded' THEN {e} END) OVER (PARTITION BY run, era ORDER BY seq), 0)" for d, e in USED.items() if d in LIMITS}
    over = "CASE " + " ".join(f"WHEN lag(s_{d}) OVER w > {limit} THEN '{d}'" for d, limit in LIMITS.items()) + " END"
    problem = """CASE
 WHEN kind = 'RunStarted' THEN CASE WHEN status <> 'absent' THEN 'started already' END
 WHEN status = 'absent' THEN 'not started'
 WHEN status = 'ended' THEN CASE WHEN kind <> 'RunFinished' THEN 'ended' END
 WHEN kind = 'RunStepCommitted' THEN CASE WHEN status <> 'running' THEN status WHEN gap = 1 THEN 'a step is outstanding' WHEN control <> 'none' THEN 'a control is pending' WHEN step_index <> committed THEN 'not the next step' WHEN over IS NOT NULL THEN 'over budget' END
 WHEN kind IN ('RunToolEffectRecorded', 'RunCheckpointSaved') THEN CASE WHEN gap = 0 THEN 'no step is outstanding' END
 WHEN kind = 'RunPauseRequested' THEN CASE WHEN control = 'cancel' AND status <> 'paused' THEN 'another control is pending' END
 WHEN kind = 'RunCancelRequested' THEN CASE WHEN control = 'pause' THEN 'another control is pending' END
 WHEN kind = 'RunPaused' THEN CASE WHEN gap = 1 THEN 'not at a checkpoint' WHEN control = 'pause' OR (control = 'none' AND over IS NOT NULL AND status <> 'paused') THEN NULL ELSE 'no cause to pause' END
 WHEN kind = 'RunResumed' THEN CASE WHEN status <> 'paused' OR control <> 'none' THEN 'not fully paused' END
 WHEN kind = 'RunCanceled' THEN CASE WHEN gap = 1 THEN 'not at a checkpoint' WHEN control <> 'cancel' THEN 'no cancel is pending' END
 WHEN kind = 'RunQuestionAsked' THEN CASE WHEN status <> 'running' THEN status WHEN gap = 1 THEN 'a step is outstanding' END
 WHEN kind = 'RunQuestionAnswered' THEN CASE WHEN status <> 'waiting' THEN 'not waiting' END
 WHEN kind = 'RunFinished' THEN CASE WHEN gap = 1 THEN 'a step is outstanding' WHEN control <> 'none' THEN 'a control is pending' WHEN status = 'paused' THEN 'paused' END END"""
    moved = lambda column, cases: f"CASE WHEN problem IS NOT NULL OR status = 'ended' THEN {column} {cases} ELSE {column} END AS next_{column}"
    return f"""WITH RECURSIVE {LOG_SQL}, {_RUNS},
e AS (SELECT *, count(*) FILTER (kind IN ({sets})) OVER (PARTITION BY run ORDER BY seq) AS era, count(*) FILTER (kind = 'RunStepCommitted') OVER (PARTITION BY run ORDER BY seq) - CASE WHEN kind = 'RunStepCommitted' THEN 1 ELSE 0 END AS committed FROM r),
s AS (SELECT *, {', '.join(f'{x} AS s_{d}' for d, x in spent.items())} FROM e),
n AS (SELECT run, seq, kind, committed, CASE WHEN kind = 'RunStepCommitted' THEN committed + CASE WHEN seq % 8 = 0 THEN 1 ELSE 0 END END AS step_index, {over} AS over, row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY run ORDER BY seq)),
g AS (
  SELECT CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, run, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS committed, CAST(NULL AS VARCHAR) AS over, CAST(NULL AS VARCHAR) AS status, CAST(NULL AS VARCHAR) AS control, CAST(NULL AS INTEGER) AS gap, CAST(NULL AS VARCHAR) AS problem, 'absent' AS next_status, 'none' AS next_control, CAST(0 AS INTEGER) AS next_gap FROM (SELECT DISTINCT run FROM n)
  UNION ALL
  SELECT seq, kind, run, i, committed, over, status, control, gap, problem,
    {moved('status', "WHEN kind IN ('RunStarted', 'RunResumed', 'RunQuestionAnswered') THEN 'running' WHEN kind = 'RunPaused' THEN 'paused' WHEN kind IN ('RunCanceled', 'RunFinished') THEN 'ended' WHEN kind = 'RunQuestionAsked' THEN 'waiting'")},
    {moved('control', "WHEN kind IN ('RunPaused', 'RunCanceled') THEN 'none' WHEN kind = 'RunPauseRequested' AND control = 'none' AND status <> 'paused' THEN 'pause' WHEN kind = 'RunCancelRequested' AND control = 'none' THEN 'cancel'")},
    {moved('gap', "WHEN kind = 'RunStepCommitted' THEN 1 WHEN kind = 'RunCheckpointSaved' THEN 0")}
  FROM (SELECT *, {problem} AS problem FROM (SELECT n.*, g.next_status AS status, g.next_control AS control, g.next_gap AS gap FROM g JOIN n ON n.run = g.run AND n.i = g.i + 1)))
SELECT run, seq, kind, committed, over, status, control, gap, problem FROM g WHERE i > 0"""


@query(_guards_sql())
def run_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event of every run with the state that its guard is in, and why it is refused."""
    return ops.guarded(guard_log(spark, sf_dir), LIMITS).select("run", "seq", "kind", "committed", "over", "status", "control", "gap", "problem")
