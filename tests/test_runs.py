"""Run guards against a plain replay, event by event; the automaton's parts on their own."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import runs

SCHEMA = "run string, seq long, kind string, step_index long, used_tokens long, set_tokens long, used_tool_calls long, set_tool_calls long"
LIMITS = {"tokens": 60, "tool_calls": 50}
LIKELY = ("RunStepCommitted", "RunToolEffectRecorded", "RunCheckpointSaved")


def events(seed, n=400, keys=("a",) * 8 + ("b", "c", None)):
    """Runs that mostly go on step by step, with anything in between."""
    rng, commits, turns, out = random.Random(seed), {}, {}, []
    for seq in range(1, n + 1):
        run = rng.choice(keys)
        turn = turns.get(run, -1)
        rare = [k for k in runs.KINDS if k not in ("RunFinished", "RunCanceled") or rng.random() < 0.1]
        if rng.random() < 0.75:
            kind, turns[run] = ("RunStarted" if turn < 0 else LIKELY[turn % 3]), turn + 1
        else:
            kind = rng.choice([*rare, "Noise", "RunPaused", "RunResumed", "RunQuestionAnswered"])
        index = None
        if kind == "RunStepCommitted":
            index = commits.get(run, 0) + (rng.random() < 0.1)
            commits[run] = commits.get(run, 0) + 1
        effect, over = kind == "RunToolEffectRecorded", kind in ("RunPaused", "RunFinished")
        out.append((run, seq, kind, index, *(x for _ in LIMITS for x in (rng.randrange(12) if effect else None, rng.randrange(20) if over else None))))
    return out


def replay(log):
    """By the rules as they read, with a run's state as a dictionary."""
    state, out = {}, []
    for run, seq, kind, index, used_t, set_t, used_c, set_c in log:
        if kind == "Noise":
            continue
        s = state.setdefault(run, {"status": "absent", "control": "none", "gap": 0, "committed": 0, "tokens": 0, "tool_calls": 0})
        over = next((d for d, limit in LIMITS.items() if s[d] > limit), None)
        now, problem = dict(s), None
        if kind == "RunStarted":
            problem = "started already" if s["status"] != "absent" else None
            if not problem:
                s["status"] = "running"
        elif s["status"] == "absent":
            problem = "not started"
        elif s["status"] == "ended":
            problem = None if kind == "RunFinished" else "ended"
        elif kind == "RunStepCommitted":
            checks = [(s["status"] != "running", s["status"]), (s["gap"], "a step is outstanding"), (s["control"] != "none", "a control is pending"), (index != s["committed"], "not the next step"), (over, "over budget")]
            problem = next((why for bad, why in checks if bad), None)
            if not problem:
                s["gap"] = 1
        elif kind in ("RunToolEffectRecorded", "RunCheckpointSaved"):
            problem = None if s["gap"] else "no step is outstanding"
            if kind == "RunCheckpointSaved":
                s["gap"] = 0
        elif kind in ("RunPauseRequested", "RunCancelRequested"):
            asked = {"RunPauseRequested": "pause", "RunCancelRequested": "cancel"}[kind]
            if not (asked == "pause" and s["status"] == "paused"):
                if s["control"] == "none":
                    s["control"] = asked
                elif s["control"] != asked:
                    problem = "another control is pending"
        elif kind == "RunPaused":
            if s["gap"]:
                problem = "not at a checkpoint"
            elif s["control"] == "pause" or (s["control"] == "none" and over and s["status"] != "paused"):
                s["status"], s["control"] = "paused", "none"
            else:
                problem = "no cause to pause"
        elif kind == "RunResumed":
            if s["status"] == "paused" and s["control"] == "none":
                s["status"] = "running"
            else:
                problem = "not fully paused"
        elif kind == "RunCanceled":
            if s["gap"]:
                problem = "not at a checkpoint"
            elif s["control"] == "cancel":
                s["status"], s["control"] = "ended", "none"
            else:
                problem = "no cancel is pending"
        elif kind == "RunQuestionAsked":
            problem = s["status"] if s["status"] != "running" else "a step is outstanding" if s["gap"] else None
            if not problem:
                s["status"] = "waiting"
        elif kind == "RunQuestionAnswered":
            problem = None if s["status"] == "waiting" else "not waiting"
            if not problem:
                s["status"] = "running"
        elif kind == "RunFinished":
            problem = "a step is outstanding" if s["gap"] else "a control is pending" if s["control"] != "none" else "paused" if s["status"] == "paused" else None
            if not problem:
                s["status"] = "ended"
        out.append((run, seq, kind, now["committed"], over, now["status"], now["control"], now["gap"], problem))
        s["committed"] += kind == "RunStepCommitted"
        for d, used, put in (("tokens", used_t, set_t), ("tool_calls", used_c, set_c)):
            s[d] = put if put is not None else s[d] + (used or 0)
    return out


@pytest.mark.parametrize("seed,block", [(1, 256), (2, 3), (3, 1)])
def test_guards_equal_a_replay(spark, monkeypatch, seed, block):
    """One run in most events, over several partitions and many blocks."""
    monkeypatch.setattr(runs, "BLOCK", block)
    log = events(seed)
    df = spark.createDataFrame(log, SCHEMA).repartition(5)
    got = runs.guarded(df, LIMITS).select("run", "seq", "kind", "committed", "over", "status", "control", "gap", "problem").collect()
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == replay(log)
    assert len({r.problem for r in got}) > 10


def test_every_state_is_reached_from_the_first():
    """Each state that events can lead to has a way on or is an end; refused events change nothing."""
    reached, open_ = set(), [runs.GUARD.states[0]]
    while open_:
        s = open_.pop()
        if s in reached:
            continue
        reached.add(s)
        for x in runs.GUARD.symbols:
            to, problem = runs.guard(s, x)
            assert problem is None or to == s
            open_.append(to)
    assert {s[0] for s in reached} == set(runs.STATUSES)
    assert not [s for s in reached if s[0] in ("paused", "waiting", "ended", "absent") and s[2]]


def test_counters_before_each_row(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xy"), k, rng.choice([None, rng.randrange(9)]), rng.choice([None] * 9 + [rng.randrange(50)])) for k in range(200)]
    df = runs.placed(spark.createDataFrame(rows, "key string, seq long, add long, put long").repartition(4), ("key",), "seq")
    got = {r.seq: r.n for r in runs.spent_before(df, {"n": F.col("add")}, {"n": F.col("put")}).collect()}
    now = {"x": 0, "y": 0}
    for key, seq, add, put in rows:
        assert got[seq] == now[key]
        now[key] = put if put is not None else now[key] + (add or 0)


def test_no_events(spark):
    assert runs.guarded(spark.createDataFrame([], SCHEMA), LIMITS).count() == 0
