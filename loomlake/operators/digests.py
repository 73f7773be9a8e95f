"""Digests of tables by ranges: a tree of them, compared from the root down, and the exact digest of a table in its order.

A table's rows are dealt into leaves by a number that its key gives (a range of a whole-number key, or of a key's hash), so two tables
agree on where a row belongs without looking at each other. A leaf's digest is over its rows in order of the key, a
node's over its children in order; a level has FAN nodes for each node above. Comparing two trees starts at the root and takes only the
children of nodes that differ, so equal tables cost one comparison, and the rows that differ are looked for in their
ranges alone. Leaves are bounded by their width where keys are unique; a tree's digests are some dozen bytes for each leaf.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.operators import log as ops
from loomlake.session import checkpointed, sized

#: Bits of a node's number that one level takes off, keys of a leaf, rows of leaf numbers broadcast at most, and ranges put into a filter.
FAN_BITS, WIDTH, LEAVES_MAX, RANGES_MAX = 5, 256, 1_000_000, 64
TREE = "level int, node long, n long, digest string"


def by_range(key: str, width: int = WIDTH) -> Column:
    """Leaves as ranges of a whole-number key that is not negative."""
    return F.floor(F.col(key) / width).cast("long")


def by_hash(*keys: str, bits: int = 12) -> Column:
    """Leaves as ranges of a key's hash, for keys of any kind; so many bits that a leaf holds some hundred rows."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - bits)


def row_text(columns: list[str]) -> Column:
    """A row as text, every value behind its length, null as a mark of its own."""
    tagged = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null")) for c in columns]
    return F.concat_ws(";", *tagged)


def _joined(pairs: Column) -> Column:
    return F.sha2(F.array_join(F.transform(F.array_sort(pairs), lambda x: x["digest"]), ","), 256)


def leaves(df: DataFrame, keys: list[str], leaf: Column) -> DataFrame:
    """node, n, digest of every leaf."""
    own = df.select(leaf.alias("node"), F.struct(*keys, F.sha2(row_text(sorted(df.columns)), 256).alias("digest")).alias("x"))
    return own.groupBy("node").agg(F.count("*").alias("n"), _joined(F.collect_list("x")).alias("digest"))


def tree(df: DataFrame, keys: list[str], leaf: Column, height: int) -> DataFrame:
    """TREE: digests of all levels, leaves at level 0; the highest level has one node where leaf numbers are below 2^(FAN_BITS * height). Written out."""
    level = checkpointed(leaves(df, keys, leaf))
    levels = [level.select(F.lit(0).alias("level"), "node", "n", "digest")]
    for k in range(1, height + 1):
        pair = F.struct("node", "digest")
        level = checkpointed(level.groupBy(F.shiftright("node", FAN_BITS).alias("node")).agg(F.sum("n").alias("n"), _joined(F.collect_list(pair)).alias("digest")))
        levels.append(level.select(F.lit(k).alias("level"), "node", "n", "digest"))
    return reduce(DataFrame.unionByName, levels)


def differing(a: DataFrame, b: DataFrame, height: int) -> tuple[DataFrame, list[int]]:
    """Leaves (node) in which two trees differ, and how many nodes were compared at each level, from the top: of a level only children of nodes that differ."""
    wanted, compared = None, []
    for k in range(height, -1, -1):
        own = lambda t, name: t.where(F.col("level") == k).select("node", F.col("digest").alias(name))  # noqa: E731, B023
        left, right = own(a, "left"), own(b, "right")
        if wanted is not None:
            above = sized(wanted.select(F.col("node").alias("parent")), LEAVES_MAX)
            left, right = (x.join(above, F.shiftright("node", FAN_BITS) == F.col("parent"), "left_semi") for x in (left, right))
        both = checkpointed(left.join(right, "node", "full_outer"))
        compared.append(both.count())
        wanted = checkpointed(both.where(~F.col("left").eqNullSafe(F.col("right"))).select("node"))
    return wanted, compared


def within(df: DataFrame, leaf: Column, wanted: DataFrame, key: str | None = None, width: int = WIDTH) -> DataFrame:
    """The rows of df in these leaves. For leaves by_range of key, and few enough, the ranges reach the scan as a filter."""
    if key is not None:
        nodes = [r.node for r in wanted.limit(RANGES_MAX + 1).collect()]
        if len(nodes) <= RANGES_MAX:
            inside = [(F.col(key) >= n * width) & (F.col(key) < (n + 1) * width) for n in sorted(nodes)]
            return df.where(reduce(Column.__or__, inside)) if inside else df.limit(0)
    return df.withColumn("_leaf", leaf).join(sized(wanted.select(F.col("node").alias("_leaf")), LEAVES_MAX), "_leaf", "left_semi").drop("_leaf")


def verified(stored: DataFrame, derived: DataFrame, keys: list[str], leaf: Column, height: int, key: str | None = None, width: int = WIDTH) -> DataFrame:
    """keys, problem: rows in which a stored table and its re-derivation differ, found by descending into ranges that differ."""
    wanted, _ = differing(tree(stored, keys, leaf, height), tree(derived, keys, leaf, height), height)
    return ops.mismatches(within(stored, leaf, wanted, key, width), within(derived, leaf, wanted, key, width), keys)


def ordered_digest(df: DataFrame, order: str, width: int = WIDTH) -> DataFrame:
    """n, digest: the exact digest of a table's rows in their order, whatever its partitions. Rows are numbered by ranges, each width of them is a leaf, and leaves are taken up level by level until one is left."""
    level = ops.numbered(df, order, name="_n").withColumn("_leaf", F.floor((F.col("_n") - 1) / width).cast("long"))
    text = F.sha2(row_text(sorted(df.columns)), 256)
    level = checkpointed(level.groupBy(F.col("_leaf").alias("node")).agg(F.count("*").alias("n"), _joined(F.collect_list(F.struct("_n", text.alias("digest")))).alias("digest")))
    while level.count() > 1:
        level = checkpointed(level.groupBy(F.floor(F.col("node") / width).cast("long").alias("node")).agg(F.sum("n").alias("n"), _joined(F.collect_list(F.struct("node", "digest"))).alias("digest")))
    return level.select("n", "digest")
