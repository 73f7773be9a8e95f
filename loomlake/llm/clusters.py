"""Centroid clustering by exact integer k-means.

Vectors are kept as blocks: the whole numbers floor(scale * x) of some thousand vectors, packed in the narrowest type that
holds them, written once to the shared folder. Each round hands the centroids to all tasks (k rows, a bound known beforehand),
takes the distances of a block as |x|^2 - 2 x.c + |c|^2, the middle term as one product of matrices in float64 BLAS, and adds up counts
and sums by cluster; RDD.treeAggregate combines the tasks' sums, so the driver gets k rows of sums, whatever the number of vectors.
There is no other exchange: vectors never move.

Results are exact. All terms of a distance are integers of at most 64 (|x| + |c|)^2 (for 64 components, by the largest
component of block and centroids); while that is below 2^53, float64 holds every partial sum exactly, in any order. A block for which it isn't
is computed in 64-bit integers, and beyond 2^63 in Python's integers. Sums are combined as Python's integers.

Edge cases: vectors that are null, have another number of components, or a component that is null or not finite are left out;
repeated rows are vectors of their own; a null id is hashed as `null`; rows whose hashes tie as seeds are ordered by their components; with fewer vectors than
centroids, each vector is a centroid; equal centroids stay, the later ones empty; an empty table gives an empty result; distances
and inertia beyond a long are given as the largest long; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Vectors of a block.
BLOCK = 4096
EXACT, LONG = 2**53, 2**63
BLOCKS = "ids array<long>, kind string, data binary"
RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def usable(vector: Column, size: int) -> Column:
    """Whether a vector has so many components, all of them finite."""
    return F.coalesce((F.size(vector) == size) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))), F.lit(False))


def whole(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), scale a power of two, in the narrowest type that holds it; as Python's integers if none does."""
    peak = np.abs(x).max(initial=0.0)
    if scale * float(peak) >= 2.0**62:
        return np.array([math.floor(scale * v) if abs(v) < EXACT else scale * int(v) for v in x.ravel().tolist()], object).reshape(x.shape)
    y = np.floor(scale * x)
    low, high = y.min(initial=0.0), y.max(initial=0.0)
    return y.astype(next(kind for kind in ("i1", "i2", "i4", "i8") if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max))


def packed(x: np.ndarray) -> tuple[str, bytes]:
    return ("text", ",".join(map(str, x.ravel().tolist())).encode()) if x.dtype == object else (x.dtype.str, x.tobytes())


def unpacked(kind: str, data: bytes, size: int) -> np.ndarray:
    flat = np.array([int(v) for v in bytes(data).decode().split(",")], object) if kind == "text" else np.frombuffer(data, kind)
    return flat.reshape(-1, size)


def blocks(vectors: DataFrame, size: int, scale: int, ident: str = "vec_id", column: str = "embedding") -> DataFrame:
    """BLOCKS of the usable vectors, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, size)
            for at in range(0, len(x), BLOCK):
                kind, data = packed(whole(x[at : at + BLOCK], scale))
                ids = pa.array([batch.column(0).slice(at, BLOCK).to_pylist()], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([kind]), pa.array([data], pa.binary())], ["ids", "kind", "data"])

    rows = vectors.where(usable(vectors[column], size)).select(vectors[ident].cast("long").alias("id"), vectors[column].cast("array<double>").alias("x"))
    return common.checkpointed(rows.mapInArrow(run, BLOCKS))


def magnitude(x: np.ndarray) -> int:
    """The largest absolute value; not by abs(), which leaves the smallest number of a narrow type negative."""
    return max(int(x.max()), -int(x.min()))


def distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of every row of x to every centroid, exact: by matrix product where all terms are below 2^53."""
    peak = magnitude(x) + magnitude(centroids)
    bound = x.shape[1] * peak * peak
    if bound < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        return (np.einsum("ij,ij->i", a, a)[:, None] - 2.0 * (a @ c.T) + np.einsum("ij,ij->i", c, c)).astype(np.int64)
    kind = np.int64 if bound < LONG else object
    a, c = x.astype(kind), centroids.astype(kind)
    return np.stack([((a - own) ** 2).sum(1) for own in c], axis=1)


def block_sums(x: np.ndarray, nearest: np.ndarray, far: np.ndarray, k: int) -> np.ndarray:
    """By cluster: count, inertia and the sum of each component, as Python's integers."""
    if x.dtype != object and len(x) * magnitude(x) < EXACT:
        member = (nearest == np.arange(k)[:, None]).astype(np.float64)
        sums = (member @ x.astype(np.float64)).astype(np.int64).astype(object)
    else:
        sums = np.array([x[nearest == n].astype(object).sum(0) if (nearest == n).any() else [0] * x.shape[1] for n in range(k)], object)
    own = np.array([[int((nearest == n).sum()), sum(far[nearest == n].tolist())] for n in range(k)], object)
    return np.concatenate([own, sums], axis=1)


def assigned(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (of equal ones the first) and distance of every row."""
    d = distances(x, centroids)
    nearest = np.array(d.argmin(1), np.int64)
    return nearest, d[np.arange(len(d)), nearest]


def totals(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Of all blocks, by cluster: count, inertia, sums."""
    k, size = centroids.shape

    def add(total: np.ndarray, row) -> np.ndarray:
        x = unpacked(row[0], row[1], size)
        return total + block_sums(x, *assigned(x, centroids), k)

    return rows.select("kind", "data").rdd.treeAggregate(np.zeros((k, size + 2), object), add, lambda a, b: a + b)


def seeds(vectors: DataFrame, k: int, size: int, scale: int, salt: str, ident: str = "vec_id", column: str = "embedding") -> np.ndarray:
    """The k usable vectors with the smallest SHA-256 of salt and id, as whole numbers."""
    named = F.concat(F.lit(salt), F.coalesce(vectors[ident].cast("long").cast("string"), F.lit("null")))
    rows = vectors.where(usable(vectors[column], size)).select(F.sha2(named, 256).alias("hash"), vectors[column].cast("array<double>").alias("x"))
    first = rows.orderBy("hash", "x").limit(k).collect()
    return np.array([whole(np.array([r.x]), scale)[0].tolist() for r in first], object).reshape(-1, size)


def fit(rows: DataFrame, centroids: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Centroids after so many rounds, and the inertia of each cluster once all vectors are assigned to them."""
    for _ in range(rounds):
        total = totals(rows, centroids)
        centroids = np.array([[s // own[0] for s in own[2:]] if own[0] else old for own, old in zip(total.tolist(), centroids.tolist(), strict=True)], object)
    return centroids, totals(rows, centroids)[:, 1]


def assign(rows: DataFrame, centroids: np.ndarray, inertia: np.ndarray) -> DataFrame:
    """One row per vector of the blocks (RESULT)."""
    size, cut = centroids.shape[1], lambda d: min(int(d), LONG - 1)
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    own, every = [cut(v) for v in inertia], cut(sum(inertia.tolist()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, kind, data in zip(*batch.columns, strict=True):
                nearest, far = assigned(unpacked(kind.as_py(), data.as_py(), size), centroids)
                named = nearest.tolist()
                columns = [ids.values, pa.array(named, pa.int32()), pa.array([cut(d) for d in far.tolist()], pa.int64()), pa.array([own[n] for n in named], pa.int64()), pa.array([every] * len(named), pa.int64()), pa.array([digests[n] for n in named])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in RESULT.split(", ")])

    return rows.mapInArrow(run, RESULT)


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64, salt: str = "1:") -> DataFrame:
    """The contract's columns: every usable vector with its cluster after so many rounds."""
    first = seeds(vectors, k, size, scale, salt)
    if not len(first):
        return vectors.sparkSession.createDataFrame([], RESULT)
    rows = blocks(vectors, size, scale)
    return assign(rows, *fit(rows, first, rounds))


def oracle(k: int = 16, rounds: int = 3, size: int = 64, scale: int = 64) -> str:
    """The same in DuckDB's SQL, each round a table of its own; for components of ordinary size."""
    tables = [
        f"v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0)",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || coalesce(CAST(vec_id AS VARCHAR), 'null')), x) - 1 AS k, x AS c FROM v QUALIFY k < {k})",
    ]
    for n in range(rounds + 1):
        d = "list_inner_product(x, x) - 2 * list_inner_product(x, c) + list_inner_product(c, c)"
        tables.append(f"a{n} AS (SELECT r, any_value(vec_id) AS vec_id, any_value(x) AS x, min({{'d': CAST({d} AS BIGINT), 'k': k}}) AS m FROM v, c{n} GROUP BY r)")
        if n < rounds:
            tables.append(f"s{n} AS (SELECT k, i, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT m.k AS k, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{n}) GROUP BY k, i)")
            tables.append(f"n{n} AS (SELECT k, list(CAST((s - (s % n + n) % n) // n AS DOUBLE) ORDER BY i) AS c FROM s{n} GROUP BY k)")
            tables.append(f"c{n + 1} AS (SELECT k, coalesce(n{n}.c, c{n}.c) AS c FROM c{n} LEFT JOIN n{n} USING (k))")
    return f"""
WITH {", ".join(tables)}
SELECT vec_id, CAST(m.k AS INTEGER) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.k) AS BIGINT) AS cluster_inertia, CAST(sum(m.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON m.k = k"""
