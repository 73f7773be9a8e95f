"""Mixing sources to target weights.

Tokens are counted per source, each source gets a repetition rate (its target over its size), and each
document is emitted floor(rate) times plus one hash-seeded Bernoulli copy with the fraction as probability.

The only thing gathered is one row per source; they are counted, and broadcast to the documents if they are few
(if not, the join back is one that can be split). Nothing is sorted, collected or kept per source, so a source that
holds a third of all rows costs no more than its share: sizes are partially aggregated before the shuffle.

Edge cases: null texts have size 0; null is a source of its own, ordered last; a source of size 0 has target 0
and its documents are emitted 0 times; a null doc_id is hashed as the text "null"; rows that repeat a doc_id
share its draw; an empty table gives an empty result; other columns are carried along untouched, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Sources whose rates are broadcast at most, some 100 bytes each; beyond, documents are shuffled to them.
MAX_BROADCAST = 200_000
#: Draws tried per source; the one whose taken words come nearest the target is used.
DRAWS = 8


def words(text: Column) -> Column:
    return F.regexp_count(common.whole(text), F.lit(common.WORD)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(source, size) rows to one row per source: source_size and target.

    Sources in code-point order (null last) take the weights in turn and share all words by weight; no target
    exceeds cap times its source. Ordered by cap over weight, the capped sources are a prefix, and the level
    that the others share is the largest of the levels left after each prefix.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    # Windows over one row per source; sources are named by people, and their number does not grow with the rows.
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    ranked = totals.select("source", "source_size", F.get(F.array(*map(F.lit, weights)), turn).cast("long").alias("weight"))
    by_cap = Window.orderBy(F.col("source_size") * cap / F.col("weight"), F.col("source").asc_nulls_last())
    before, onward = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum(F.col("source_size") * cap).over(before), F.lit(0))
    level = ranked.withColumn("level", left.cast("double") / F.sum("weight").over(onward).cast("double"))
    shared = F.max("level").over(everything) * F.col("weight")
    return level.select("source", "source_size", F.least((F.col("source_size") * cap).cast("double"), shared).alias("target"))


def draws(doc_id: Column) -> Column:
    """Uniform numbers in [0, 1) that depend on the id alone: the eight words of its SHA-256."""
    digest = F.sha2(F.coalesce(doc_id.cast("string"), F.lit("null")), 256)
    return F.array(*(F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("double") / 4294967296.0 for k in range(DRAWS)))


def source_rates(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """(doc_id, source, size) rows to one row per source: source_size, target, floor and fraction of its rate, draw.

    draw is the one of the DRAWS seeds whose Bernoulli copies bring the source nearest its target.
    """
    targets = source_targets(docs, weights, cap)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.withColumn("rate", rate).withColumns({"whole": F.floor("rate"), "fraction": F.col("rate") - F.floor("rate")}).drop("rate")
    joined = docs.withColumn("u", draws(F.col("doc_id"))).join(rates.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of")))
    extra = [F.sum(F.when(F.col("u")[k] < F.col("fraction"), F.col("size")).otherwise(0)).alias(f"extra{k}") for k in range(DRAWS)]
    taken = joined.groupBy("of").agg(F.first("whole").alias("w"), F.first("source_size").alias("s"), F.first("target").alias("t"), *extra)
    miss = [F.struct(F.abs(F.col("s") * F.col("w") + F.col(f"extra{k}") - F.col("t")).alias("off"), F.lit(k).alias("draw")) for k in range(DRAWS)]
    best = taken.select(F.col("of").alias("source_"), F.array_min(F.array(*miss))["draw"].alias("draw"))
    return rates.join(best, F.col("source").eqNullSafe(F.col("source_"))).drop("source_")


def mix_plan(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, copies."""
    sizes = common.checkpointed(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    rates = source_rates(sizes, weights, cap).withColumnRenamed("source", "of")
    joined = sizes.join(rates, F.col("source").eqNullSafe(F.col("of")))
    copies = F.col("whole") + (F.get(draws(F.col("doc_id")), F.col("draw")) < F.col("fraction")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", copies.alias("copies"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), cap: int = 3) -> DataFrame:
    """The mixture itself: each document's row as often as the plan says, numbered by mix_copy from 1; a column of that name is replaced."""
    sizes = common.checkpointed(docs.select("doc_id", "source", words(F.col("text")).alias("size")))
    rates = common.sized(source_rates(sizes, weights, cap).select(F.col("source").alias("of"), "whole", "fraction", "draw"), MAX_BROADCAST)
    # The row stands aside as one struct, so that no column of it can clash.
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns if c != "mix_copy")).alias("row"), docs["doc_id"].alias("id"), docs["source"].alias("own"))
    copies = F.col("whole") + (F.get(draws(F.col("id")), F.col("draw")) < F.col("fraction")).cast("long")
    kept = rows.join(rates, F.col("own").eqNullSafe(F.col("of"))).select("row", copies.alias("copies")).where("copies > 0")
    return kept.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("mix_copy")).select("row.*", "mix_copy")
