"""Running values by ranges against plain loops over each key."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import text
from loomlake.plans import fold, ranges
from loomlake.streaming import stream

SCHEMA = "key string, at long, n long"


@pytest.fixture
def parts(spark):
    """Small data in many partitions, which would be coalesced otherwise."""
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "11"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def events(count, seed=5):
    """A key with a third of all rows, some with a few, one null; numbers of which some are null."""
    rng = random.Random(seed)
    rows = [("hot" if k % 3 == 0 else rng.choice(["a", "b", "c", None, *(f"k{j}" for j in range(40))]), k, rng.choice([None, *range(-9, 10)])) for k in range(count)]
    rng.shuffle(rows)
    return rows


def plain(rows):
    out, seen = {}, {}
    for key, at, n in sorted(rows, key=lambda r: r[1]):
        before = seen.setdefault(key, [])
        known = [x for x in before if x is not None]
        out[at] = (sum(known), known[-1] if known else None, max(known, default=None), len(before))
        before.append(n)
    return out


def test_every_kind_of_value(spark, parts):
    rows = events(900)
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = ranges.running(df, ("key",), "at", {"total": F.col("n"), "count": F.lit(1)}, {"last": F.col("n")}, {"top": F.col("n")})
    assert got.columns == ["key", "at", "n", "total", "count", "last", "top"]
    assert {r.at: (r.total, r["last"], r.top, r["count"]) for r in got.collect()} == plain(rows)


def test_a_hot_key_lies_in_many_partitions(spark, parts):
    df = spark.createDataFrame(events(900), SCHEMA)
    places = ranges.placed(df, ("key",), "at").where("key = 'hot'").groupBy("_part").count().collect()
    assert len(places) > 2 and max(r["count"] for r in places) < 200


def test_ties_repeats_and_none(spark, parts):
    df = spark.createDataFrame([("a", 1, 2)] * 3 + [(None, 1, None)] * 2, SCHEMA)
    got = ranges.running(df, ("key",), ("at", "n"), {"total": F.col("n"), "count": F.lit(1)}, {"last": F.col("n")})
    assert sorted((r.key or "", r["count"], r.total, r["last"]) for r in got.where("key = 'a'").collect()) == [("a", 0, 0, None), ("a", 1, 2, 2), ("a", 2, 4, 2)]
    assert sorted((r["count"], r.total, r["last"]) for r in got.where("key IS NULL").collect()) == [(0, 0, None), (1, 0, None)]
    assert ranges.running(df.where("false"), ("key",), "at", tops={"top": F.col("n")}).count() == 0


def test_cues_and_turns_of_a_hot_item(spark, parts):
    rng = random.Random(2)
    rows = [("hot" if k % 3 else f"k{k % 7}", k, k * 100 + rng.randrange(90), k * 100 + rng.randrange(900)) for k in range(600)]
    df = spark.createDataFrame(rows, "key string, i long, a long, b long").repartition(5)
    kept, marks, done, last = set(), {}, {}, {}
    for key, i, a, b in rows:
        if b > done.get(key, 0):
            kept.add((key, i, max(a, done.get(key, 0)), b))
        done[key] = max(done.get(key, 0), b)
        marks[i] = key not in last or max(a - last[key], 0) >= text.TURN_GAP_MS
        last[key] = b
    assert {tuple(r) for r in text.clamp_cues(df, "key", "i", "a", "b").collect()} == kept and len(kept) < 600
    assert {r.i: r.starts_turn for r in text.turn_marks(df, "key", "i", "a", "b").collect()} == marks and len(set(marks.values())) == 2


def test_strict_violations_of_a_hot_key(spark, parts):
    rng = random.Random(4)
    log = [(k, "hot" if k % 3 else f"k{k % 5}", rng.choice(["born", "changed", "gone"])) for k in range(600)]
    table = fold.Table(key=("entity",), columns={"n": fold.Total({"changed": "CAST(1 AS BIGINT)"})}, creates=("born",), deletes=("gone",))
    alive, wrong = set(), set()
    for seq, entity, kind in log:
        if kind == "born" and entity in alive:
            wrong.add((entity, seq, kind, "duplicate"))
        if kind != "born" and entity not in alive:
            wrong.add((entity, seq, kind, "missing"))
        alive = alive | {entity} if kind == "born" else alive - {entity} if kind == "gone" else alive
    df = spark.createDataFrame(log, "seq long, entity string, kind string").repartition(5)
    assert {tuple(r) for r in fold.strict_violations(df, table).collect()} == wrong and wrong


def test_settled_frames_of_streams_with_a_null_name(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "x"), ("b", 1, "end"), (None, 1, "x"), (None, 2, "x")], "run string, seq long, kind string")
    got = stream.settled(df, "run", "seq", F.col("kind") == "end").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, [("a", 1, "x"), ("b", 1, "end"), (None, 1, "x")]))
