"""Bounded, totally ordered reads: filters, pages, nested histories, lookups."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_MAX = 500


def matching(df: DataFrame, **wanted) -> DataFrame:
    """Rows that equal every filter given; filters of None do not filter."""
    tests = [F.col(k) == v for k, v in wanted.items() if v is not None]
    return df.where(reduce(and_, tests)) if tests else df


def page(df: DataFrame, order: list[Column | str], limit: int) -> DataFrame:
    """The first rows in a total order, never more than ROWS_MAX: a bounded top-k, not a sort."""
    return df.orderBy(*order).limit(min(limit, ROWS_MAX))


def after(df: DataFrame, key: str, cursor: int | None, limit: int) -> DataFrame:
    """Keyset pagination: rows beyond the cursor; without a cursor from 0."""
    return df.where(F.col(key) >= (0 if cursor is None else cursor + 1)).orderBy(key).limit(min(limit, ROWS_MAX))


def first_match(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """One row per key, the first by order, in one partial aggregation."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("row")).select(*keys, "row.*")


def subsequence(text: Column, letters: str) -> Column:
    """Whether the letters occur in the text in this order, whatever the case."""
    import re

    return F.lower(text).rlike(".*?".join(re.escape(c) for c in letters.lower()))
