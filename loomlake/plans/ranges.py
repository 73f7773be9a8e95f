"""Running values over the rows of a key, by ranges.

A window over a key brings all of its rows into one task, so a key with a third of the rows is as slow as all of them.
Here rows are sorted by range over key and order, so that such a key lies in many partitions, and written with the partition
and place that they came to. A value before a row is then what its partition holds before it, joined with what the key's
partitions before hold, which is one row per partition and key.

Edge cases: rows with a null key are one key; rows equal in key and order come in either order, which is fixed once they are
written; nulls add nothing to a sum, are no last value and no largest one; before the first row of a key, sums are 0 and the others null;
an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomlake.session import checkpointed, sized

#: Rows of bounds that are broadcast at most, some 40 bytes each; beyond, they are joined by a shuffle.
BOUNDS_MAX = 500_000


def placed(rows: DataFrame, by: tuple[str, ...], order: str | tuple[str, ...]) -> DataFrame:
    """rows sorted by range over key and order and written out, with the key as one struct, the partition and the place."""
    marks = {"_key": F.struct(*by), "_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    own = (order,) if isinstance(order, str) else order
    return checkpointed(rows.orderBy(*by, *own).withColumns(marks))


def before(rows: DataFrame, sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """placed rows with the sum of each of sums, the last of lasts that is not null, and the largest of tops, over the rows of its key before it."""
    sums, lasts, tops = sums or {}, lasts or {}, tops or {}
    names = [*sums, *lasts, *tops]
    of, start = (lambda n: F.col(f"_of_{n}")), (lambda n: F.col(f"_from_{n}"))
    rows = rows.withColumns({f"_of_{n}": c for n, c in {**sums, **lasts, **tops}.items()})
    whole = {n: F.sum(of(n)) for n in sums} | {n: F.max_by(of(n), F.when(of(n).isNotNull(), F.col("_at"))) for n in lasts} | {n: F.max(of(n)) for n in tops}
    bounds = rows.groupBy("_key", "_part").agg(*(c.alias(n) for n, c in whole.items()))
    over = Window.partitionBy("_key").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = {n: F.coalesce(F.sum(n).over(over), F.lit(0)) for n in sums} | {n: F.last(n, ignorenulls=True).over(over) for n in lasts} | {n: F.max(n).over(over) for n in tops}
    bounds = bounds.select(F.col("_key").alias("_k"), F.col("_part").alias("_p"), *(c.alias(f"_from_{n}") for n, c in carried.items()))
    joined = rows.join(sized(bounds, BOUNDS_MAX), (F.col("_part") == F.col("_p")) & F.col("_key").eqNullSafe(F.col("_k")))
    own = Window.partitionBy("_key", "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    values = {n: F.coalesce(F.sum(of(n)).over(own), F.lit(0)) + start(n) for n in sums}
    values |= {n: F.coalesce(F.last(of(n), ignorenulls=True).over(own), start(n)) for n in lasts}
    values |= {n: F.greatest(F.max(of(n)).over(own), start(n)) for n in tops}
    return joined.withColumns(values).drop("_k", "_p", *(f"_of_{n}" for n in names), *(f"_from_{n}" for n in names))


def running(rows: DataFrame, by: tuple[str, ...], order: str | tuple[str, ...], sums: dict[str, Column] | None = None, lasts: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """before() of rows as they come, in the order given within each key; all columns are kept."""
    return before(placed(rows, by, order), sums, lasts, tops).drop("_key", "_part", "_at")
