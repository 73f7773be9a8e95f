"""Folds of an event log into state tables, declared by column and compiled to aggregations.

A table names the kinds of event that create, change and delete its rows; each column says how events change it:
the last assignment wins, the first wins, deltas add up, or deltas add up to the last overwrite. All of a table's columns come from one grouping by
key, partially aggregated before the shuffle, so a key that holds a third of the log is summed where it lies.

Where rows are created leniently (changes before creation are no-ops) or deleted, the bounds of a row's life are
grouped first and joined back, rather than looked up in a window: the join can be split at a hot key.

A state can be kept between the two halves of a log: state() keeps each assigned value with its seq, merge()
puts two states together, finish() drops the bookkeeping. finish(state(all)) equals finish(merge(state(head), state(tail))).
A table whose rows are deleted or leniently created needs to know of the tail whether a row lived before it: absorb() folds the
events of the tail onto a state, for tables of any kind.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.plans import ranges


@dataclass(frozen=True)
class Last:
    """The value (a SQL expression) assigned by the latest of these kinds; a null assignment counts."""

    kinds: dict[str, str]


@dataclass(frozen=True)
class First:
    """The value assigned by the earliest of these kinds."""

    kinds: dict[str, str]


@dataclass(frozen=True)
class Total:
    """The sum of deltas; null until the first, zero if nulls_as_zero."""

    kinds: dict[str, str]
    nulls_as_zero: bool = False


@dataclass(frozen=True)
class Reset:
    """A counter: the value assigned by the latest of sets and the sum of the deltas after it (of all, before the first)."""

    kinds: dict[str, str]
    sets: dict[str, str]
    nulls_as_zero: bool = False


@dataclass(frozen=True)
class Table:
    key: tuple[str, ...]
    columns: dict[str, Last | First | Total | Reset]
    creates: tuple[str, ...] = ()
    deletes: tuple[str, ...] = ()
    order: str = "seq"
    kinds: tuple[str, ...] = field(default=())

    def wanted(self) -> tuple[str, ...]:
        """Kinds that the table looks at; all others are pruned at the scan."""
        sets = {k for c in self.columns.values() if isinstance(c, Reset) for k in c.sets}
        return tuple(sorted({k for c in self.columns.values() for k in c.kinds} | sets | set(self.creates) | set(self.deletes) | set(self.kinds)))

    def resets(self) -> dict[str, Reset]:
        return {name: c for name, c in self.columns.items() if isinstance(c, Reset)}

    def order_free(self) -> bool:
        """Whether states of any two sets of events can be merged, whichever came first."""
        return not (self.creates or self.deletes or self.resets())


def _value(kinds: dict[str, str]) -> Column:
    out = F.lit(None)
    for kind, value in kinds.items():
        out = F.when(F.col("kind") == kind, F.struct(F.expr(value).alias("v"))).otherwise(out)
    return out


def _delta(kinds: dict[str, str]) -> Column:
    out = F.lit(None).cast("long")
    for kind, value in kinds.items():
        out = F.when(F.col("kind") == kind, F.expr(value)).otherwise(out)
    return out


def _same(t: Table, mark: str = "_") -> Column:
    same = F.lit(True)
    for k in t.key:
        same = same & F.col(k).eqNullSafe(F.col(f"{mark}{k}"))
    return same


def _keys(t: Table, mark: str = "_") -> list[Column]:
    return [F.col(k).alias(f"{mark}{k}") for k in t.key]


def deleted(log: DataFrame, t: Table) -> DataFrame:
    """The keys that a log deletes, each marked with an underscore, and when last (_gone)."""
    return log.where(F.col("kind").isin(*t.deletes)).groupBy(*_keys(t)).agg(F.max(t.order).alias("_gone"))


def living(log: DataFrame, t: Table, alive: DataFrame | None = None) -> DataFrame:
    """Events that count: after the key's last delete, and from the first create on where creates are named, or all of a key that is alive before."""
    log = log.where(F.col("kind").isin(*t.wanted()))
    if t.deletes:
        log = log.join(deleted(log, t), _same(t), "left").where(F.col("_gone").isNull() | (F.col(t.order) > F.col("_gone"))).drop("_gone", *(f"_{k}" for k in t.key))
    if t.creates:
        born = log.where(F.col("kind").isin(*t.creates)).groupBy(*_keys(t)).agg(F.min(t.order).alias("_born"))
        if alive is None:
            log = log.join(born, _same(t)).where(F.col(t.order) >= F.col("_born"))
        else:
            lived = alive.select(*_keys(t, "_was_"), F.lit(True).alias("_lived"))
            log = log.join(born, _same(t), "left").join(lived, _same(t, "_was_"), "left")
            log = log.where(F.col("_lived") | (F.col(t.order) >= F.col("_born"))).drop("_lived", *(f"_was_{k}" for k in t.key))
        log = log.drop("_born", *(f"_{k}" for k in t.key))
    return log


def _at(t: Table, kinds: dict[str, str]) -> Column:
    return F.when(F.col("kind").isin(*kinds), F.col(t.order))


def state(log: DataFrame, t: Table, alive: DataFrame | None = None) -> DataFrame:
    """One row per key: every column with the seq that set it. alive: keys whose rows exist before this log."""
    log, aggs = living(log, t, alive), []
    if resets := t.resets():
        # When each counter was last overwritten is grouped first and joined back, as the bounds of a row's life are.
        last = log.groupBy(*_keys(t)).agg(*(F.max(_at(t, c.sets)).alias(f"_{name}_at") for name, c in resets.items()))
        log = log.join(last, _same(t), "left")
    for name, c in t.columns.items():
        if isinstance(c, Total):
            aggs.append(F.sum(_delta(c.kinds)).alias(name))
        elif isinstance(c, Reset):
            after = F.col(f"_{name}_at").isNull() | (F.col(t.order) > F.col(f"_{name}_at"))
            aggs += [F.max_by(_value(c.sets), _at(t, c.sets)).alias(name), F.max(_at(t, c.sets)).alias(f"{name}_at"), F.sum(F.when(after, _delta(c.kinds))).alias(f"{name}_added")]
        else:
            pick = F.max if isinstance(c, Last) else F.min
            best = F.max_by if isinstance(c, Last) else F.min_by
            aggs += [best(_value(c.kinds), _at(t, c.kinds)).alias(name), pick(_at(t, c.kinds)).alias(f"{name}_at")]
    return log.groupBy(*t.key).agg(*aggs)


def merge(head: DataFrame, tail: DataFrame, t: Table) -> DataFrame:
    """The state of two halves of a log, head first; for tables without deletes and lenient creates, which are refused (absorb() takes them)."""
    if t.deletes or t.creates:
        raise ValueError("states of tables with deletes or creates can't be merged: absorb the events of the tail")
    return _merged(head, tail, t)


def _merged(head: DataFrame, tail: DataFrame, t: Table) -> DataFrame:
    both = head.withColumn("_tail", F.lit(0)).unionByName(tail.withColumn("_tail", F.lit(1)))
    aggs, read = [], []
    for name, c in t.columns.items():
        if isinstance(c, Total):
            aggs.append(F.sum(name).alias(name))
            read.append(F.col(name))
            continue
        best, pick = (F.min_by, F.min) if isinstance(c, First) else (F.max_by, F.max)
        aggs += [best(name, f"{name}_at").alias(name), pick(f"{name}_at").alias(f"{name}_at")]
        read += [F.col(name), F.col(f"{name}_at")]
        if isinstance(c, Reset):
            # What the head added counts only if the tail did not overwrite it.
            own = lambda half, x: F.when(F.col("_tail") == half, F.col(x))
            aggs += [F.max(own(1, f"{name}_at")).alias(f"_{name}_set"), F.sum(own(1, f"{name}_added")).alias(f"_{name}_later"), F.sum(f"{name}_added").alias(f"_{name}_all")]
            read.append(F.when(F.col(f"_{name}_set").isNotNull(), F.col(f"_{name}_later")).otherwise(F.col(f"_{name}_all")).alias(f"{name}_added"))
    return both.groupBy(*t.key).agg(*aggs).select(*t.key, *read)


def absorb(head: DataFrame, log: DataFrame, t: Table) -> DataFrame:
    """A state with the events that come after it folded onto it: rows that they delete go, those that live on take them all, new ones are born."""
    log = log.where(F.col("kind").isin(*t.wanted()))
    if t.deletes:
        head = head.join(deleted(log, t), _same(t), "left_anti")
    return _merged(head, state(log, t, head.select(*t.key)), t)


def finish(states: DataFrame, t: Table) -> DataFrame:
    """The table as it is read."""
    cols = []
    for name, c in t.columns.items():
        if isinstance(c, Reset):
            value = F.coalesce(F.col(f"{name}.v"), F.lit(0)) + F.coalesce(f"{name}_added", F.lit(0))
            cols.append((value if c.nulls_as_zero else F.when(F.col(f"{name}_at").isNotNull() | F.col(f"{name}_added").isNotNull(), value)).alias(name))
        elif isinstance(c, Total):
            cols.append(F.coalesce(name, F.lit(0)).alias(name) if c.nulls_as_zero else F.col(name))
        else:
            cols.append(F.col(f"{name}.v").alias(name))
    return states.select(*t.key, *cols)


def fold(log: DataFrame, t: Table) -> DataFrame:
    return finish(state(log, t), t)


def strict_violations(log: DataFrame, t: Table) -> DataFrame:
    """Events that a strict reading refuses: creates of a key that lives, changes of a key that does not; key, seq, problem."""
    log = log.where(F.col("kind").isin(*t.wanted())).select(*t.key, t.order, "kind")
    mark = F.when(F.col("kind").isin(*t.creates), 1).when(F.col("kind").isin(*t.deletes), 0)
    log = ranges.running(log, t.key, t.order, lasts={"_alive": mark})
    alive = F.coalesce("_alive", F.lit(0))
    problem = F.when(F.col("kind").isin(*t.creates) & (alive == 1), "duplicate").when(~F.col("kind").isin(*t.creates) & (alive == 0), "missing")
    return log.select(*t.key, t.order, "kind", problem.alias("problem")).where("problem IS NOT NULL")


def ddl(name: str, df: DataFrame) -> str:
    """The statement that makes an empty table of df's schema."""
    return f"CREATE TABLE {name} ({', '.join(f'{f.name} {f.dataType.simpleString().upper()}' for f in df.schema)}) USING PARQUET"
