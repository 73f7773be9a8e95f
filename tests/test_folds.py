"""Folds on random logs: incremental, rebuilt, and snapshot plus tail must agree with a plain replay."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from loomlake.operators import log as log_ops
from loomlake.plans import fold

SCHEMA = "seq long, kind string, entity string, amount long"
T = fold.Table(("entity",), {"last": fold.Last({"set": "amount", "clear": "CAST(NULL AS BIGINT)"}), "first": fold.First({"set": "amount"}), "total": fold.Total({"add": "amount"})})


def rows(seed, n=120):
    rng = random.Random(seed)
    return [(k, rng.choice(["set", "clear", "add", "noise"]), rng.choice("abcdef"), rng.randrange(100)) for k in range(1, n + 1)]


def replay(events):
    out = {}
    for _, kind, entity, amount in events:
        if kind == "noise":
            continue
        row = out.setdefault(entity, {"last": None, "first": None, "total": None, "was_set": False})
        if kind in ("set", "clear"):
            row["last"] = amount if kind == "set" else None
        if kind == "set" and not row["was_set"]:
            row["first"], row["was_set"] = amount, True
        if kind == "add":
            row["total"] = (row["total"] or 0) + amount
    return {(e, r["last"], r["first"], r["total"]) for e, r in out.items()}


def read(df):
    return {tuple(r) for r in df.select("entity", "last", "first", "total").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_fold_equals_replay_on_three_paths(spark, seed):
    events = rows(seed)
    log = spark.createDataFrame(events, SCHEMA)
    expected, cut = replay(events), random.Random(seed).randrange(1, len(events))
    assert read(fold.fold(log, T)) == expected
    merged = fold.merge(fold.state(log.where(F.col("seq") <= cut), T), fold.state(log.where(F.col("seq") > cut), T), T)
    assert read(fold.finish(merged, T)) == expected


def test_lenient_updates_and_deletes(spark):
    log = spark.createDataFrame([(1, "add", "a", 5), (2, "new", "a", 0), (3, "add", "a", 7), (4, "gone", "a", 0), (5, "add", "a", 9), (6, "new", "a", 0), (7, "add", "a", 1), (8, "add", "b", 3)], SCHEMA)
    t = fold.Table(("entity",), {"total": fold.Total({"add": "amount"}, nulls_as_zero=True)}, creates=("new",), deletes=("gone",))
    assert [tuple(r) for r in fold.fold(log, t).collect()] == [("a", 1)]
    found = {(r.seq, r.problem) for r in fold.strict_violations(log, t).collect()}
    assert found == {(1, "missing"), (5, "missing"), (8, "missing")}


LIVES = fold.Table(
    ("entity",),
    {
        "last": fold.Last({"set": "amount", "clear": "CAST(NULL AS BIGINT)"}),
        "first": fold.First({"set": "amount"}),
        "total": fold.Total({"add": "amount"}),
        "spent": fold.Reset({"add": "amount", "set": "CAST(1 AS BIGINT)"}, {"clear": "amount", "new": "CAST(0 AS BIGINT)"}),
    },
    creates=("new",),
    deletes=("gone",),
)
COUNTS = fold.Table(("entity",), {"spent": fold.Reset({"add": "amount"}, {"set": "amount"}), "zero": fold.Reset({"add": "amount"}, {"set": "amount"}, nulls_as_zero=True), "last": fold.Last({"clear": "seq"})})


def lives(seed, n=150, keys="abcdef"):
    rng = random.Random(seed)
    return [(k, rng.choice(["set", "clear", "add", "add", "noise", "new", "gone"]), rng.choice(keys) if rng.random() < 0.95 else None, rng.randrange(100)) for k in range(1, n + 1)]


def replay_lives(events):
    out = {}
    for _, kind, entity, amount in events:
        if kind == "new" and entity not in out:
            out[entity] = {"last": None, "first": None, "total": None, "spent": None, "was_set": False}
        if kind == "gone":
            out.pop(entity, None)
        if entity not in out:
            continue
        row = out[entity]
        if kind in ("set", "clear"):
            row["last"] = amount if kind == "set" else None
        if kind == "set" and not row["was_set"]:
            row["first"], row["was_set"] = amount, True
        if kind == "add":
            row["total"] = (row["total"] or 0) + amount
        if kind in ("clear", "new"):
            row["spent"] = amount if kind == "clear" else 0
        if kind in ("add", "set"):
            row["spent"] = (row["spent"] or 0) + (amount if kind == "add" else 1)
    return {(e, r["last"], r["first"], r["total"], r["spent"]) for e, r in out.items()}


@pytest.mark.parametrize("seed", range(4))
def test_lives_and_resets_on_three_paths(spark, seed):
    """Folded at once, a tail absorbed by a head, and three parts absorbed in turn: deletes, rebirths and overwritten counters."""
    events = lives(seed)
    log = spark.createDataFrame(events, SCHEMA)
    expected = replay_lives(events)
    got = lambda states: {tuple(r) for r in fold.finish(states, LIVES).collect()}
    assert got(fold.state(log, LIVES)) == expected
    for cuts in ((40,), (30, 90)):
        state, before = fold.state(log.where(F.col("seq") <= cuts[0]), LIVES), cuts[0]
        for cut in (*cuts[1:], len(events)):
            state = fold.absorb(state, log.where((F.col("seq") > before) & (F.col("seq") <= cut)), LIVES)
            before = cut
        assert got(state) == expected


def test_counters_that_are_overwritten(spark):
    log = spark.createDataFrame([(1, "add", "a", 5), (2, "set", "a", 100), (3, "add", "a", 7), (4, "add", "b", 1), (5, "clear", "c", 0), (6, "set", "d", 3), (7, "set", "d", 4)], SCHEMA)
    expected = {("a", 107, 107, None), ("b", 1, 1, None), ("c", None, 0, 5), ("d", 4, 4, None)}
    assert {tuple(r) for r in fold.fold(log, COUNTS).collect()} == expected
    for cut in range(8):
        merged = fold.merge(fold.state(log.where(F.col("seq") <= cut), COUNTS), fold.state(log.where(F.col("seq") > cut), COUNTS), COUNTS)
        assert {tuple(r) for r in fold.finish(merged, COUNTS).collect()} == expected


def test_states_that_cannot_be_merged_are_refused(spark):
    log = spark.createDataFrame(lives(1), SCHEMA)
    with pytest.raises(ValueError, match="absorb"):
        fold.merge(fold.state(log, LIVES), fold.state(log, LIVES), LIVES)
    assert T.order_free() and not LIVES.order_free() and not COUNTS.order_free()


def requests(spark, n, width=2):
    body = F.repeat(F.lit("x"), width)
    return spark.range(n).select(F.col("id").alias("at"), (F.col("id") % 3).alias("device"), F.concat(F.lit("Kind"), "id").alias("kind"), body.alias("body"), F.array().cast("array<string>").alias("refs"))


def test_append_numbers_and_refuses(spark, tmp_path):
    path = str(tmp_path / "log")
    assert log_ops.append(spark, path, requests(spark, 5), "at") == 5
    assert log_ops.append(spark, path, requests(spark, 3), "at", expected_head=5) == 8
    with pytest.raises(log_ops.HeadChanged):
        log_ops.append(spark, path, requests(spark, 1), "at", expected_head=5)
    # One bad request refuses the whole batch.
    bad = requests(spark, 9).withColumn("kind", F.when(F.col("at") == 4, "not a kind").otherwise(F.col("kind")))
    with pytest.raises(log_ops.InvalidBatch, match="1 x kind"):
        log_ops.append(spark, path, bad, "at")
    log = spark.read.parquet(path)
    assert [r.seq for r in log.orderBy("seq").collect()] == list(range(1, 9))
    assert [r.lamport for r in log.where("device = 0").orderBy("seq").collect()] == [1, 2, 3]
    assert log_ops.gaps(log).count() == 0
    assert log_ops.append(spark, path, requests(spark, 0), "at") == 8


@pytest.mark.parametrize("adaptive", ["true", "false"])
def test_append_of_wide_rows_over_many_partitions(spark, tmp_path, adaptive):
    """Sorts that sample their bounds apart, or are coalesced apart, must not lose or repeat a row."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "32")
    spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    try:
        path, n = str(tmp_path / "log"), 100_000
        batch = requests(spark, n, 384).withColumn("at", F.xxhash64("at")).repartition(13)
        assert log_ops.append(spark, path, batch, "at") == n
        log = spark.read.parquet(path)
        w = Window.orderBy("at")
        checked = log.withColumns({"s": F.row_number().over(w), "l": F.row_number().over(Window.partitionBy("device").orderBy("at"))})
        assert checked.agg(F.count("*"), F.count_if((F.col("s") != F.col("seq")) | (F.col("l") != F.col("lamport"))), F.count_distinct("seq")).first() == (n, 0, n)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_snapshots_are_written_pruned_and_restored(spark, tmp_path):
    folder, digest = str(tmp_path), log_ops.schema_digest({"t": T})
    log = spark.createDataFrame(rows(9), SCHEMA)
    for cut in (20, 40, 80):
        log_ops.write_snapshot(fold.state(log.where(F.col("seq") <= cut), T), folder, digest, cut, keep=2)
    assert log_ops.snapshot_seqs(spark, folder, digest) == [40, 80]
    assert log_ops.newest_snapshot(spark, folder, "other", 100) is None
    assert log_ops.newest_snapshot(spark, folder, digest, 79)[0] == 40
    (tmp_path / f"digest={digest}" / "snapshot_seq=80" / "_SUCCESS").unlink()  # a write that was cut off
    assert log_ops.newest_snapshot(spark, folder, digest, 100)[0] == 40
    assert read(fold.finish(log_ops.restored(spark, log, folder, T, 120), T)) == replay(rows(9))
    assert read(fold.finish(log_ops.restored(spark, log, folder, T, 30), T)) == replay([e for e in rows(9) if e[0] <= 30])


def test_numbering_is_contiguous_over_partitions(spark):
    df = spark.range(1000).withColumn("o", F.xxhash64("id")).repartition(7)
    out = log_ops.numbered(df, "o", 10).orderBy("o").select("seq").collect()
    assert [r.seq for r in out] == list(range(11, 1011))
