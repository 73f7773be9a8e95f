"""Roll-ups of the cost ledger, histograms, percentiles and verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper edges of the histogram's buckets; above the last is the overflow. Fixed values.
EDGES = (1, 2, 5, 10, 20, 50, 100, 200, 500, 1000, 2000, 5000, 10000, 30000, 60000)
COST_KEYS = ("project", "feature", "agent", "model", "cost_kind")


def sums() -> list[Column]:
    return [F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "wall_ms", "usd_micros"))]


def own_cost() -> Column:
    """Cost that is not billed to a customer directly."""
    return F.sum(F.when(F.col("cost_kind") == "customer_billed", 0).otherwise(F.col("usd_micros"))).alias("own_usd_micros")


def cost_groups(calls: DataFrame, keys: tuple[str, ...] = COST_KEYS) -> DataFrame:
    return calls.groupBy(*keys).agg(*sums())


def cost_rollup(calls: DataFrame) -> DataFrame:
    """Totals per project, feature and agent in one pass (grouping sets), in long form; a null agent is a group of its own."""
    dims = calls.groupingSets([["project"], ["feature"], ["agent"]], "project", "feature", "agent")
    rolled = dims.agg(F.grouping_id().alias("g"), *sums(), own_cost())
    dimension = F.when(F.col("g") == 3, "project").when(F.col("g") == 5, "feature").otherwise("agent")
    key = F.when(F.col("g") == 3, F.col("project")).when(F.col("g") == 5, F.col("feature")).otherwise(F.col("agent"))
    return rolled.select(dimension.alias("dimension"), key.alias("key"), "calls", "tokens_in", "tokens_out", "usd_micros", "own_usd_micros")


def totals(calls: DataFrame) -> DataFrame:
    """Grand totals; wall time is left out on purpose."""
    return calls.agg(F.count("*").alias("calls"), *(F.sum(c).alias(c) for c in ("tokens_in", "tokens_out", "usd_micros")), own_cost())


def bucket(value: Column, edges: tuple[int, ...] = EDGES) -> Column:
    out = F.lit(len(edges))
    for k in reversed(range(len(edges))):
        out = F.when(value <= edges[k], k).otherwise(out)
    return out


def histogram(df: DataFrame, by: list[str], value: str, edges: tuple[int, ...] = EDGES) -> DataFrame:
    return df.groupBy(*by, bucket(F.col(value), edges).cast("long").alias("bucket")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def quantile_upper(hist: DataFrame, by: list[str], q: float, edges: tuple[int, ...] = EDGES) -> DataFrame:
    """The upper edge of the first bucket at which the running count reaches max(1, ceil(n q)); null beyond the edges.

    The window runs over at most len(edges) + 1 rows of each group.
    """
    own = Window.partitionBy(*by)
    running = hist.withColumns({"cum": F.sum("n").over(own.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)), "all": F.sum("n").over(own)})
    reached = running.where(F.col("cum") >= F.greatest(F.lit(1), F.ceil(F.col("all") * q)))
    edge = F.get(F.array(*(F.lit(e).cast("long") for e in edges)), F.min("bucket").cast("int"))
    return reached.groupBy(*by).agg(edge.alias("upper"), F.first("all").alias("n"))
