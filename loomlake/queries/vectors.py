"""Queries on vectors and text match."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import text as text_ops
from loomlake.operators import vectors as ops
from loomlake.registry import query
from loomlake.sources.tables import table

DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))), 4) AS norm, abs(sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) - 1) < 0.001 AS unit FROM embeddings")
def l2_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors three times as long, brought back to unit length."""
    e = table(spark, sf_dir, "embeddings")
    back = ops.l2_normalized(F.transform("embedding", lambda x: x * F.lit(3.0).cast("float")))
    n = e.select("vec_id", ops.norm(back).alias("n"))
    return n.select("vec_id", F.round("n", 4).alias("norm"), (F.abs(F.col("n") - 1) < 0.001).alias("unit"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, q), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d2 FROM embeddings, q WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM d) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d2, 5) AS d2 FROM r WHERE rank <= 10""")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of every vector whose id is divisible by 100, against all."""
    e = table(spark, sf_dir, "embeddings")
    return ops.knn(e, e.where("vec_id % 100 = 0"), 10).select("query_id", "vec_id", "rank", F.round("d2", 5).alias("d2"))


@query("""WITH q AS (SELECT vec_id AS query_id, embedding AS q FROM embeddings WHERE vec_id % 100 = 0),
d AS (SELECT query_id, vec_id, list_sum(list_transform(list_zip(embedding, q), lambda p: (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)) * (CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) AS d2 FROM embeddings, q WHERE query_id <> vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d2, vec_id) AS rank FROM d) SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank, round(d2, 5) AS d2 FROM r WHERE rank <= 10""")
def knn_by_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest, exact, from an index of cells: the nearest cells bound the tenth distance, and only cells that come as near are looked into."""
    e = table(spark, sf_dir, "embeddings")
    return ops.knn_exact(ops.cell_index(e), e.where("vec_id % 100 = 0"), 10, 4).select("query_id", "vec_id", "rank", F.round("d2", 5).alias("d2"))


#: Cells that the approximate search looks into, as a share of all. The given vectors hardly cluster, so it takes many.
PROBED = 0.75


@query()
def knn_cell_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the nearest cells alone find of the ten true neighbours of every query; a row for each query."""
    e = table(spark, sf_dir, "embeddings")
    q, index = e.where("vec_id % 100 = 0"), ops.cell_index(e)
    found = ops.knn_cells(index, q, 10, max(1, round(PROBED * len(index[1].centres)))).select("query_id", "vec_id", F.lit(1).alias("hit"))
    true = ops.knn(e, q, 10).select("query_id", "vec_id", F.lit(1).alias("true"))
    both = true.join(found, ["query_id", "vec_id"], "left")
    return both.groupBy("query_id").agg(F.sum("true").alias("true"), F.sum("hit").alias("found"), (F.coalesce(F.sum("hit"), F.lit(0)) / F.sum("true")).alias("recall"))


@query("""WITH n AS (SELECT vec_id, embedding, row_number() OVER (ORDER BY vec_id) - 1 AS n FROM embeddings)
SELECT vec_id, n // 63 AS batch, n % 63 * 256 AS byte_start, CAST(256 AS BIGINT) AS n_bytes, embedding[1] = embedding[1] AS same, CAST(embedding[1] AS DOUBLE) AS first, CAST(embedding[64] AS DOUBLE) AS last FROM n""")
def packed_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors packed into blobs of 32-bit floats, each read back from its byte range, bit for bit."""
    e = table(spark, sf_dir, "embeddings")
    back = ops.unpacked(*ops.packed(e)).join(e.select(F.col("vec_id").alias("of"), F.col("embedding").alias("source")), F.col("vec_id") == F.col("of"))
    ends = [F.get("embedding", k).cast("double") for k in (0, 63)]
    return back.select("vec_id", "batch", "byte_start", "n_bytes", (F.col("embedding") == F.col("source")).alias("same"), ends[0].alias("first"), ends[1].alias("last"))


@query("SELECT label, count(*) AS n, round(avg(CAST(embedding[1] AS DOUBLE)), 6) AS first_mean, round(avg(CAST(embedding[64] AS DOUBLE)), 6) AS last_mean FROM embeddings GROUP BY label")
def mean_pool_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = ops.mean_pool(table(spark, sf_dir, "embeddings"), "label", "embedding", 64)
    return pooled.select("label", "n", F.round(F.get("mean", 0), 6).alias("first_mean"), F.round(F.get("mean", 63), 6).alias("last_mean"))


@query("""WITH RECURSIVE p AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
s AS (SELECT doc_id, least(greatest(CAST(ceil(length(line) / 3) AS BIGINT), 1), 512) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM p WHERE trim(line) <> ''),
w(doc_id, i, n, m, b) AS (SELECT doc_id, i, CAST(1 AS BIGINT), n, CAST(0 AS BIGINT) FROM s WHERE i = 1
UNION ALL SELECT s.doc_id, s.i, CASE WHEN (w.n + 1) * greatest(w.m, s.n) > 1024 OR w.n >= 63 THEN 1 ELSE w.n + 1 END, CASE WHEN (w.n + 1) * greatest(w.m, s.n) > 1024 OR w.n >= 63 THEN s.n ELSE greatest(w.m, s.n) END,
w.b + CASE WHEN (w.n + 1) * greatest(w.m, s.n) > 1024 OR w.n >= 63 THEN 1 ELSE 0 END FROM w JOIN s ON s.doc_id = w.doc_id AND s.i = w.i + 1)
SELECT doc_id, b AS batch, max(n) AS items, max(n) * max(m) AS padded FROM w GROUP BY doc_id, b""")
def batch_plan_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-preserving batches of each item's segments whose padded size stays within 1,024 tokens."""
    from loomlake.functions.scalars import embed_token_estimate

    items = text_ops.segment_arrays(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "\\n")
    return text_ops.batch_plan(items, "doc_id", F.transform("segs", lambda s: embed_token_estimate(s["segment"])))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS content, doc_id % 4 = 0 AS done FROM documents), v AS (SELECT content, min(doc_id) AS vector_of FROM h WHERE done GROUP BY content)
SELECT CASE WHEN done THEN 'done' WHEN v.content IS NOT NULL THEN 'reused' ELSE 'computed' END AS outcome, count(*) AS n, count(DISTINCT h.content) AS contents FROM h LEFT JOIN v ON h.content = v.content GROUP BY 1""")
def reuse_by_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What embedding has to compute: not what is done, not what another row of the same content has."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"), (F.col("doc_id") % 4 == 0).alias("done"))
    v = h.where("done").groupBy(F.col("content").alias("known")).agg(F.min("doc_id").alias("vector_of"))
    joined = h.join(v, F.col("content") == F.col("known"), "left")
    outcome = F.when(F.col("done"), "done").when(F.col("known").isNotNull(), "reused").otherwise("computed")
    return joined.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.count_distinct("content").alias("contents"))


@query(r"""WITH t AS (SELECT doc_id, unnest(list_filter(string_split_regex(lower(text), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS term FROM documents)
SELECT doc_id, count(*) AS score FROM t WHERE term IN ('licensed', 'the') GROUP BY doc_id HAVING count(DISTINCT term) = 2 ORDER BY score DESC, doc_id LIMIT 50""")
def text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ops.inverted_index(table(spark, sf_dir, "documents"), "doc_id", F.col("text"))
    return ops.text_match(index, "doc_id", ["licensed", "the"], 50)


@query("SELECT vec_id, 0 + (vec_id % 63) * 64 * 4 AS byte_start, 64 * 4 AS n_bytes FROM embeddings")
def vector_byte_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a vector lies in a packed batch of 32-bit floats."""
    return table(spark, sf_dir, "embeddings").select("vec_id", ((F.col("vec_id") % 63) * F.size("embedding") * 4).alias("byte_start"), (F.size("embedding") * 4).alias("n_bytes"))
