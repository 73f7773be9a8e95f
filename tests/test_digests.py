"""Trees of digests: what they compare, and what they find, against plain comparisons."""

import random

import pytest
from pyspark.sql import functions as F

from loomlake.operators import digests

SCHEMA = "k long, v string"


def tables(spark, seed, n=3000):
    rng = random.Random(seed)
    rows = {k: str(rng.randrange(100)) for k in rng.sample(range(2 * n), n)}
    other = dict(rows)
    for k in rng.sample(sorted(rows), 6):
        other[k] = None if rng.random() < 0.3 else "changed"
    for k in rng.sample(sorted(rows), 3):
        del other[k]
    other[2 * n + 77] = "surplus"
    df = lambda d, parts: spark.createDataFrame(sorted(d.items()), SCHEMA).repartition(parts)
    problems = {(k, "missing" if k not in other else "surplus" if k not in rows else "changed") for k in rows.keys() | other.keys() if k not in rows or k not in other or rows[k] != other[k]}
    return df(other, 3), df(rows, 5), problems


@pytest.mark.parametrize("leaf,key", [(lambda: digests.by_range("k", 16), "k"), (lambda: digests.by_range("k", 16), None), (lambda: digests.by_hash("k", bits=9), None)])
def test_what_differs_is_found(spark, leaf, key):
    stored, derived, problems = tables(spark, 5)
    got = digests.verified(stored, derived, ["k"], leaf(), 2, key, 16)
    assert {tuple(r) for r in got.collect()} == problems


def test_equal_tables_cost_one_comparison_and_others_few(spark):
    stored, derived, problems = tables(spark, 6)
    leaf = digests.by_range("k", 4)
    a, b = digests.tree(stored, ["k"], leaf, 3), digests.tree(derived, ["k"], leaf, 3)
    wanted, compared = digests.differing(b, digests.tree(derived.repartition(7), ["k"], leaf, 3), 3)
    assert wanted.count() == 0 and compared == [1, 0, 0, 0]
    wanted, compared = digests.differing(a, b, 3)
    changed = {k // 4 for k, _ in problems}
    assert {r.node for r in wanted.collect()} == changed
    assert compared[0] == 1 and compared[-1] <= 32 * len(changed)
    # The ranges reach a scan as filters on the key.
    read = digests.within(derived, leaf, wanted, "k", 4)
    assert {r.k // 4 for r in read.collect()} <= changed and read.count() <= 4 * len(changed)


def test_ranges_are_pushed_to_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).select(F.col("id").alias("k"), F.lit("x").alias("v")).write.parquet(path)
    wanted = spark.createDataFrame([(3,), (9,)], "node long")
    plan = digests.within(spark.read.parquet(path), digests.by_range("k", 16), wanted, "k", 16)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "GreaterThanOrEqual(k,48)" in plan


def test_order_and_partitions(spark):
    df = spark.range(1000).select(F.col("id").alias("k"), (F.col("id") % 7).cast("string").alias("v"))
    first = digests.ordered_digest(df, "k", 16).first()
    assert digests.ordered_digest(df.repartition(9), "k", 16).first() == first and first.n == 1000
    changed = df.withColumn("v", F.when(F.col("k") == 500, "other").otherwise(F.col("v")))
    assert digests.ordered_digest(changed, "k", 16).first().digest != first.digest
    assert digests.ordered_digest(df.limit(0), "k").count() == 0
