"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.session import checkpointed, scratch, sized  # noqa: F401
from loomlake.sources import folders

#: The white space of the contracts: space and the controls 9 to 13.
SPACE = r"\x20\x09-\x0D"
#: A word by white space.
WORD = rf"[^{SPACE}]+"
#: What stands between words made of letters, digits and everything beyond ASCII (upper case still in the text).
NOT_WORD = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; a file or a folder of parts, on any file system that Spark reads."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def whole(text: str | Column) -> Column:
    """The whole text, null as empty."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; pure ASCII takes the fast path of lower()."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


@contextmanager
def workspace(spark: SparkSession, name: str) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A function that writes a table into a folder of the shared one and reads it again; the folder goes at the end, so what is to outlive it must be checkpointed."""
    path = scratch(spark, name)

    def kept(df: DataFrame, table: str) -> DataFrame:
        df.write.parquet(f"{path}/{table}")
        return spark.read.schema(df.schema).parquet(f"{path}/{table}")

    try:
        yield kept
    finally:
        folders.remove(spark, path)
