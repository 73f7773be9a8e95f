"""Cells against brute force, and packed vectors."""

import hashlib
import random
import struct

import pytest
from pyspark.sql import functions as F

from loomlake.operators import vectors

SCHEMA = "vec_id long, embedding array<float>"


def rows(n, dim=8, seed=2, copies=0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    out = [(k, [x + rng.gauss(0, 0.3) for x in rng.choice(middles)]) for k in range(n)]
    return out + [(n + k, out[0][1]) for k in range(copies)]


@pytest.mark.parametrize("n,copies,cells,probes", [(600, 0, 25, 2), (200, 100, 14, 1), (12, 0, 5, 1)])
def test_exact_search_by_cells(spark, n, copies, cells, probes):
    """Every query gets what brute force gives: clusters, a third of all rows equal, fewer rows than neighbours."""
    df = spark.createDataFrame(rows(n, copies=copies), SCHEMA).repartition(4)
    q = df.where("vec_id % 10 = 0")
    read = lambda d: sorted((r.query_id, r.rank, r.vec_id, round(r.d2, 9)) for r in d.collect())
    assert read(vectors.knn_exact(vectors.cell_index(df, cells), q, 15, probes)) == read(vectors.knn(df, q, 15))


def test_recall_grows_with_the_cells_looked_into(spark):
    df = spark.createDataFrame(rows(1500), SCHEMA).repartition(4)
    q, index = df.where("vec_id % 10 = 0"), vectors.cell_index(df)
    true = {(r.query_id, r.vec_id) for r in vectors.knn(df, q, 10).collect()}
    recall = [len(true & {(r.query_id, r.vec_id) for r in vectors.knn_cells(index, q, 10, p).collect()}) / len(true) for p in (2, 10, len(index[1].centres))]
    assert recall == sorted(recall) and recall[1] >= 0.9 and recall[2] == 1
    assert index[0].count() == 1500


def test_recall_of_the_query(spark):
    from loomlake.queries.vectors import knn_cell_recall

    got = knn_cell_recall(spark, "/root/testdata/sf0.1").agg(F.sum("true").alias("t"), F.sum("found").alias("f")).first()
    assert got.f / got.t >= 0.9


def test_packed_vectors(spark, monkeypatch):
    monkeypatch.setattr(vectors, "BATCH", 4)
    values = [(3, [0.1, -0.0]), (1, [float("inf"), 1e-45]), (2, None), (9, [3.5]), (7, []), (5, [0.1, -0.0]), (4, [2.0, float("nan")])]
    blobs, directory = vectors.packed(spark.createDataFrame(values, SCHEMA))
    names = {r.name: bytes(r.content) for r in blobs.collect()}
    assert all(hashlib.sha256(c).hexdigest() == n for n, c in names.items()) and len(names) == 2
    bits = lambda v: struct.pack(f"<{len(v)}f", *v)
    got = {r.vec_id: r for r in vectors.unpacked(blobs, directory).collect()}
    assert {k: bits(r.embedding) for k, r in got.items()} == {k: bits(v) for k, v in values if v is not None}
    assert [(got[k].batch, got[k].byte_start, got[k].n_bytes) for k in sorted(got)] == [(0, 0, 8), (0, 8, 8), (0, 16, 8), (0, 24, 8), (1, 0, 0), (1, 0, 4)]
    bad = blobs.withColumn("content", F.encode(F.lit("other"), "UTF-8"))
    with pytest.raises(Exception, match="not what its name says"):
        vectors.unpacked(bad, directory).collect()


def test_search_without_a_row_a_pair(spark):
    """Pairs are never rows: what the plan hands on is at most k rows a query and task. Odd vectors, copies and far-off ranges against the plain expression."""
    values = rows(300, copies=150) + [(900, None), (901, [1.0]), (902, [None] * 8), (903, [float("nan")] * 8), (904, [1e19] * 8), (None, [0.0] * 8)]
    df = spark.createDataFrame(values, SCHEMA).repartition(3)
    q = df.where("vec_id % 10 = 0 AND vec_id < 450")
    plan = vectors.knn(df, q, 5)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    pairs = q.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query")).join(df, F.col("query_id") != F.col("vec_id"))
    pairs = pairs.select("query_id", "vec_id", vectors.squared_distance(F.col("embedding"), F.col("query")).alias("d2")).where("d2 IS NOT NULL")
    want = {}
    for r in pairs.collect():
        want.setdefault(r.query_id, []).append((r.d2 != r.d2, r.d2, r.vec_id))
    want = {k: [(d, v) for _, d, v in sorted(x)[:5]] for k, x in want.items()}
    got = {}
    for r in sorted(vectors.knn(df, q, 5, block=16).collect(), key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.d2, r.vec_id))
    assert got == want
