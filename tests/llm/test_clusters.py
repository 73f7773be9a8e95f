import hashlib
import math
import random

import numpy as np
import pytest

from loomlake.llm import clusters

SCHEMA = "vec_id long, embedding array<double>, label int"


def brute(rows, k=16, rounds=3, scale=64):
    """The contract in exact fractions, one vector at a time."""
    kept = []
    for d, e in rows:
        if e is not None and len(e) == 64 and all(x is not None and math.isfinite(x) for x in e):
            kept.append((d, [int(x) * scale if abs(x) >= 2**53 else math.floor(scale * x) for x in e]))
    named = lambda d: hashlib.sha256(f"1:{'null' if d is None else d}".encode()).hexdigest()
    centroids = [x for _, x in sorted(kept, key=lambda r: (named(r[0]), r[1]))[:k]]

    def nearest(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        members = {}
        for _, x in kept:
            members.setdefault(nearest(x)[1], []).append(x)
        centroids = [[sum(col) // len(members[n]) for col in zip(*members[n], strict=True)] if n in members else c for n, c in enumerate(centroids)]
    found = [(d, *nearest(x)) for d, x in kept]
    own = {n: sum(a for _, a, m in found if m == n) for _, _, n in found}
    cut = lambda v: min(v, 2**63 - 1)
    return sorted(((d, n, cut(a), cut(own[n]), cut(sum(own.values())), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for d, a, n in found), key=str)


def clustered(spark, rows, parts=3):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA).repartition(parts)
    return sorted((tuple(r) for r in clusters.cluster(df).collect()), key=str)


def vectors(n, size, seed=1):
    rng = random.Random(seed)
    middles = [[rng.uniform(-size, size) for _ in range(64)] for _ in range(5)]
    return [(d, [x + rng.uniform(-size, size) / 3 for x in rng.choice(middles)]) for d in range(n)]


@pytest.mark.parametrize("size", [0.1, 3.0, 1e6, 1e8, 1e12, 1e30])
def test_equals_brute_force_at_every_magnitude(spark, monkeypatch, size):
    """From bytes in float64 products over 64-bit integers to Python's."""
    monkeypatch.setattr(clusters, "BLOCK", 16)
    rows = vectors(90, size)
    assert clustered(spark, rows) == brute(rows)


def test_the_three_ways_agree():
    rng = np.random.default_rng(3)
    x, c = rng.integers(-60, 60, (50, 64)), rng.integers(-60, 60, (7, 64))
    plain = ((x[:, None, :] - c[None]) ** 2).sum(2)
    assert (clusters.distances(x.astype(np.int8), c.astype(object)) == plain).all()
    big = 2**27
    assert (clusters.distances(x * big, c.astype(object) * big) == plain.astype(object) * big * big).all()
    assert (clusters.distances(x.astype(object) * 2**40, c.astype(object) * 2**40) == plain.astype(object) * 2**80).all()


def test_guard_holds_at_its_edge():
    """The largest components that the product is trusted with, and one more."""
    edge = math.isqrt((2**53 - 1) // 64) // 2
    for e in (edge, edge + 1):
        x, c = np.full((2, 64), e), np.full((1, 64), -e).astype(object)
        assert clusters.distances(x, c).tolist() == [[64 * 4 * e * e]] * 2


def test_the_smallest_number_of_a_narrow_type_counts_for_the_guard():
    for kind in (np.int8, np.int16, np.int32, np.int64):
        low = int(np.iinfo(kind).min)
        x = np.array([[low, 1, *[0] * 62]], kind)
        assert clusters.magnitude(x) == -low
        assert clusters.distances(x, np.zeros((1, 64), object)).tolist() == [[low * low + 1]]


def test_odd_vectors(spark):
    one = [0.5] * 64
    rows = [(1, one), (1, one), (None, [-0.01] * 64), (2, None), (3, []), (4, one[:63]), (5, [*one, 0.5]), (6, [None, *one[1:]]), (7, [math.nan, *one[1:]]), (8, [math.inf, *one[1:]]), (9, [1.0] * 64)]
    got = clustered(spark, rows)
    assert got == brute(rows) and len(got) == 4
    assert clustered(spark, [(2, None)]) == [] == clustered(spark, [])
    assert [c for c in clusters.cluster(spark.createDataFrame([], SCHEMA)).columns] == [x.split()[0] for x in clusters.RESULT.split(", ")]


def test_kinds_of_blocks():
    for peak, kind in ((100, "|i1"), (128, "|i1"), (200, "<i2"), (40_000, "<i4"), (2**40, "<i8"), (2**70, "text")):
        x = np.array([[-peak / 64, (peak - 1) / 64, 0.0]])
        y = clusters.whole(x, 64)
        assert clusters.packed(y)[0] == kind and clusters.unpacked(*clusters.packed(y), 3).tolist() == y.tolist()
        assert y.tolist()[0][0] == -peak
    assert clusters.whole(np.array([[2.0, 0.0]]), 64).tolist() == [[128, 0]]
