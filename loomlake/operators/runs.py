"""Guards of runs: an automaton over each run's events, and counters before each event, both by ranges.

The log of a run is read in order, and each event is taken or refused by what has been taken before. Whether an event
fits is a finite matter (status, pending control, whether a step is outstanding), so the events of any stretch of a
run are a function from states to states, and stretches compose: events are sorted by range over run and order and
written; blocks of events become functions, the blocks of a partition compose to one, the partitions of a run are followed
from its first state, and the states then go back down to blocks and events. A run that holds a third of the log lies in
many partitions and is folded in all of them at once; what is composed in one place is one function per partition.

The two things that are not finite, numbers of steps and sums of what was spent, are facts of the log whatever the
guard says of it: they are added up over all of a run's events and enter the automaton as yes or no.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import bound
from loomlake.plans.ranges import BOUNDS_MAX, before, placed
from loomlake.session import checkpointed, sized

#: Events that one function stands for at the lowest level.
BLOCK = 256


@dataclass(frozen=True)
class Automaton:
    """states, the first being where every key begins; step(state, symbol) gives the next state and what is wrong, or None."""

    states: tuple
    symbols: tuple
    step: Callable

    def moves(self) -> list[list[int]]:
        at = {s: k for k, s in enumerate(self.states)}
        return [[at[self.step(s, x)[0]] for s in self.states] for x in self.symbols]

    def problems(self) -> list[list[str | None]]:
        return [[self.step(s, x)[1] for s in self.states] for x in self.symbols]

    def symbol(self, *parts: Column) -> Column:
        """The number of the symbol that these columns make up, each a value of the tuple's place."""
        pairs = [x for k, s in enumerate(self.symbols) for x in (F.lit("|".join(map(str, s))), F.lit(k))]
        return F.element_at(F.create_map(*pairs), F.concat_ws("|", *(p.cast("string") for p in parts)))


def table(rows: list[list]) -> Column:
    return F.array(*(F.array(*map(F.lit, r)) for r in rows))


def spent_before(rows: DataFrame, deltas: dict[str, Column], sets: dict[str, Column]) -> DataFrame:
    """placed rows with each counter as it stands before the row: its last overwrite (sets, null where there is none) and the deltas since."""
    rows = before(rows, {f"_all_{n}": F.coalesce(d, F.lit(0)) for n, d in deltas.items()})
    # An overwrite shifts the running total from there on.
    shifts = {f"_shift_{n}": sets[n] - F.col(f"_all_{n}") - F.coalesce(deltas[n], F.lit(0)) for n in deltas}
    rows = before(rows, {}, shifts)
    counted = rows.withColumns({n: F.col(f"_all_{n}") + F.coalesce(f"_shift_{n}", F.lit(0)) for n in deltas})
    return counted.drop(*(f"_all_{n}" for n in deltas), *shifts)


def states_before(rows: DataFrame, symbol: Column, automaton: Automaton, name: str = "state") -> DataFrame:
    """placed rows with the number of the automaton's state before each; every key begins in the first."""
    moves, columns = table(automaton.moves()), rows.columns
    identity = F.array(*map(F.lit, range(len(automaton.states))))
    then = lambda f, own: bound(own, lambda m: F.transform(f, lambda s: F.get(m, s)))
    gathered = lambda *c: F.array_sort(F.collect_list(F.struct(*c)))

    def states(items: Column, start: Column, own: Callable[[Column], Column]) -> Column:
        """The state before each of items, from start on."""
        zero = F.struct(start.alias("s"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(items, zero, lambda acc, x: F.struct(F.get(own(x), acc["s"]).alias("s"), F.concat(acc["out"], F.array(acc["s"])).alias("out")), lambda acc: acc["out"])

    place = F.floor((F.col("_at") % (1 << 33)) / BLOCK).alias("_block")
    blocks = rows.select("_key", "_part", place, "_at", symbol.alias("_symbol"), F.struct(*columns).alias("_row")).groupBy("_key", "_part", "_block").agg(gathered("_at", "_symbol", "_row").alias("_events"))
    of_event = lambda e: F.get(moves, e["_symbol"])
    blocks = checkpointed(blocks.withColumn("_moves", F.aggregate("_events", identity, lambda f, e: then(f, of_event(e)))))
    parts = blocks.groupBy("_key", "_part").agg(gathered("_block", "_moves").alias("_blocks"))
    parts = checkpointed(parts.withColumn("_moves", F.aggregate("_blocks", identity, lambda f, b: then(f, b["_moves"]))))
    runs = parts.groupBy("_key").agg(gathered("_part", "_moves").alias("_parts"))
    starts = lambda items, start, of: F.inline(F.zip_with(items, states(items, start, lambda x: x["_moves"]), lambda x, s: F.struct(x[of].alias(of), s.alias("_start"))))
    of_parts = runs.select("_key", starts("_parts", F.lit(0), "_part"))
    of_blocks = parts.join(of_parts, ["_key", "_part"]).select("_key", "_part", starts("_blocks", F.col("_start"), "_block"))
    joined = blocks.join(sized(of_blocks, BOUNDS_MAX), ["_key", "_part", "_block"])
    found = F.zip_with("_events", states("_events", F.col("_start"), of_event), lambda e, s: F.struct(e["_row"].alias("row"), s.alias("state")))
    return joined.select(F.explode(found).alias("x")).select(*(F.col("x.row")[c].alias(c) for c in columns), F.col("x.state").alias(name))


STATUSES, CONTROLS = ("absent", "running", "waiting", "paused", "ended"), ("none", "pause", "cancel")
KINDS = ("RunStarted", "RunStepCommitted", "RunToolEffectRecorded", "RunCheckpointSaved", "RunValidationRecorded", "RunPauseRequested", "RunPaused", "RunResumed", "RunCancelRequested", "RunCanceled", "RunTaintRaised", "RunQuestionAsked", "RunQuestionAnswered", "RunFinished")


def guard(state: tuple, symbol: tuple) -> tuple[tuple, str | None]:
    """What a run's guard makes of one event: the state after it, and why it is refused (which leaves the state as it was).

    state: status, pending control, steps committed but not checkpointed; symbol: kind, whether the event's step index is
    the number of steps committed, whether the budget is exceeded. What is asked for twice, and what an ended run hears of its end, is nothing.
    """
    (status, control, gap), (kind, in_turn, over) = state, symbol
    to = lambda status=status, control=control, gap=gap: ((status, control, gap), None)
    no = lambda why: (state, why)
    if kind == "RunStarted":
        return to("running") if status == "absent" else no("started already")
    if status == "absent":
        return no("not started")
    if status == "ended":
        return to() if kind == "RunFinished" else no("ended")
    if kind == "RunStepCommitted":
        if status != "running":
            return no(status)
        if gap:
            return no("a step is outstanding")
        if control != "none":
            return no("a control is pending")
        if not in_turn:
            return no("not the next step")
        return no("over budget") if over else to(gap=1)
    if kind == "RunToolEffectRecorded":
        return to() if gap else no("no step is outstanding")
    if kind == "RunCheckpointSaved":
        return to(gap=0) if gap else no("no step is outstanding")
    if kind in ("RunPauseRequested", "RunCancelRequested"):
        asked = "pause" if kind == "RunPauseRequested" else "cancel"
        if control == asked or (status == "paused" and asked == "pause"):
            return to()
        return to(control=asked) if control == "none" else no("another control is pending")
    if kind == "RunPaused":
        if gap:
            return no("not at a checkpoint")
        return to("paused", "none") if control == "pause" or (control == "none" and over and status != "paused") else no("no cause to pause")
    if kind == "RunResumed":
        return to("running") if status == "paused" and control == "none" else no("not fully paused")
    if kind == "RunCanceled":
        if gap:
            return no("not at a checkpoint")
        return to("ended", "none") if control == "cancel" else no("no cancel is pending")
    if kind == "RunQuestionAsked":
        if status != "running":
            return no(status)
        return no("a step is outstanding") if gap else to("waiting")
    if kind == "RunQuestionAnswered":
        return to("running") if status == "waiting" else no("not waiting")
    if kind == "RunFinished":
        if gap:
            return no("a step is outstanding")
        if control != "none":
            return no("a control is pending")
        return no("paused") if status == "paused" else to("ended")
    return to()  # validations and taints


GUARD = Automaton(tuple(product(STATUSES, CONTROLS, (0, 1))), tuple(product(KINDS, (False, True), (False, True))), guard)


def guarded(log: DataFrame, limits: dict[str, int]) -> DataFrame:
    """log (run, seq, kind, step_index, and for each dimension of limits what it spends, used_*, or overwrites, set_*) with what its guard says.

    committed: steps of the run committed before; over: the first dimension over its limit; status, control and gap before
    the event; problem: why it is refused, null if it is taken. Kinds that runs don't know are left out.
    """
    rows = placed(log.where(F.col("kind").isin(*KINDS)), ("run",), "seq")
    rows = before(rows, {"committed": (F.col("kind") == "RunStepCommitted").cast("long")})
    rows = spent_before(rows, {f"spent_{d}": F.col(f"used_{d}") for d in limits}, {f"spent_{d}": F.col(f"set_{d}") for d in limits})
    over = F.coalesce(*(F.when(F.col(f"spent_{d}") > limit, d) for d, limit in limits.items()))
    rows = rows.withColumn("over", over)
    symbol = GUARD.symbol(F.col("kind"), F.initcap((F.coalesce(F.col("step_index") == F.col("committed"), F.lit(False))).cast("string")), F.initcap(F.col("over").isNotNull().cast("string")))
    rows = rows.withColumn("_symbol_of", symbol)
    found = states_before(rows, F.col("_symbol_of"), GUARD)
    parts = F.array(*(F.struct(F.lit(a).alias("status"), F.lit(b).alias("control"), F.lit(c).alias("gap")) for a, b, c in GUARD.states))
    found = found.withColumns({"_now": F.get(parts, F.col("state")), "problem": F.get(F.get(table(GUARD.problems()), F.col("_symbol_of")), F.col("state"))})
    return found.select(*log.columns, "committed", "over", "_now.status", "_now.control", "_now.gap", "problem")
