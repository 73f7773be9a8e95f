"""Verification by ranges, and exact digests in order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import digests as ops
from loomlake.queries.logs import _TAGGED
from loomlake.registry import query
from loomlake.session import checkpointed, scratch
from loomlake.sources import folders
from loomlake.sources.tables import LOG_SQL, event_log

COLUMNS = ("seq", "device", "kind", "entity", "amount")
#: Levels above the leaves: 2^20 leaves of WIDTH numbers each.
HEIGHT = 4


def _faulty(log: DataFrame) -> DataFrame:
    """A stored copy of the log in which some rows are changed, some lost, and some of a kind that never was."""
    log = log.where("seq % 1013 <> 0").withColumn("amount", F.when(F.col("seq") % 997 == 0, F.col("amount") + 1).otherwise(F.col("amount")))
    more = log.where("seq % 1511 = 0").withColumn("seq", F.col("seq") + 50_000_000)
    return log.unionByName(more)


@query(f"""WITH {LOG_SQL} SELECT seq, CASE WHEN seq % 1013 = 0 THEN 'missing' ELSE 'changed' END AS problem FROM log WHERE seq % 1013 = 0 OR seq % 997 = 0
UNION ALL SELECT seq + 50000000, 'surplus' FROM log WHERE seq % 1511 = 0 AND seq % 1013 <> 0""")
def verify_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored log against its re-derivation: trees of digests are compared from the root, and rows are read in the ranges that differ."""
    log, path = event_log(spark, sf_dir).select(*COLUMNS), scratch(spark, "stored")
    _faulty(log).repartitionByRange(8, "seq").sortWithinPartitions("seq").write.parquet(path)
    stored = spark.read.parquet(path)
    found = checkpointed(ops.verified(stored, log, ["seq"], ops.by_range("seq"), HEIGHT, "seq"))
    folders.remove(spark, path)
    return found


@query(f"""WITH {LOG_SQL}, d AS (SELECT row_number() OVER (ORDER BY seq) - 1 AS n, sha256({_TAGGED}) AS h FROM log), l0 AS (SELECT n // 256 AS node, count(*) AS n, sha256(string_agg(h, ',' ORDER BY d.n)) AS h FROM d GROUP BY 1),
l1 AS (SELECT node // 256 AS up, sum(n) AS n, sha256(string_agg(h, ',' ORDER BY node)) AS h, count(*) AS own FROM l0 GROUP BY 1), l2 AS (SELECT sum(n) AS n, sha256(string_agg(h, ',' ORDER BY up)) AS h FROM l1)
SELECT CAST(n AS BIGINT) AS n, CASE WHEN (SELECT count(*) FROM l0) = 1 THEN (SELECT min(h) FROM l0) WHEN (SELECT count(*) FROM l1) = 1 THEN (SELECT min(h) FROM l1) ELSE h END AS digest FROM l2""")
def ordered_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact digest of the log in its order, from ranges of 256 rows taken up level by level."""
    return ops.ordered_digest(event_log(spark, sf_dir).select(*COLUMNS), "seq")


@query(f"""WITH {LOG_SQL}, t AS (SELECT entity, kind, count(*) AS n FROM log GROUP BY ALL) SELECT entity, kind, 'changed' AS problem FROM t WHERE entity % 50 = 7""")
def verify_by_hash_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table whose key is no number, in ranges of the key's hash."""
    derived = event_log(spark, sf_dir).groupBy("entity", "kind").agg(F.count("*").alias("n"))
    stored = derived.withColumn("n", F.when(F.col("entity") % 50 == 7, F.col("n") + 1).otherwise(F.col("n")))
    return ops.verified(stored, derived, ["entity", "kind"], ops.by_hash("entity", "kind", bits=10), 2)
