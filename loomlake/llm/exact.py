"""Exact dedup by a tree-merge of sorted digest runs.

Every row becomes an entry: a 64-bit digest of the whole text by which runs are sorted, its SHA-256 and its length in
bytes, which verify that entries with one digest are one text, and the row's identifier. The entries of one partition
are a run. Runs meet in rounds: in each, the FAN runs whose numbers differ in their last bits alone send their entries to
one run, as in a binomial tree. A round is one aggregation over sorted rows: each partition merges what it holds
before anything is exchanged, the exchange deals a merged run out by its digests, and each task sorts what it was sent and
merges equal neighbours, keeping the wanted identifier and the number of rows. After the last round
one run is left, dealt over all tasks; every row finds its text's entry there.

So a text that fills a third of all rows is one entry of each run from the first exchange on, and at most FAN entries
meet for one run in a round. The rows' join with the last run is by the verified digest and can be split where a text is hot;
only texts that occur more than once take part on its right side. What travels is digests, never texts.

Equal means equal SHA-256, equal length and equal 64-bit digest; texts are not compared byte by byte.

Edge cases: a null text is empty; empty texts are equal; very long texts are read whole; a null id belongs to its group and stays only
where all ids of the group are null (it is neither the largest nor the smallest); rows that repeat id and text are rows
of their own, of which one stays; an empty table gives an empty result; other columns are ignored by the report and kept by
drop_copies, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bits of a run's number that one round takes off: so many runs, as a power of two, merge into one.
FAN_BITS = 4
#: What tells texts apart: the digest that runs are sorted by, and what verifies it.
DIGEST = ("digest", "sha", "size")


def rank(ident: Column, row: Column, keep: str) -> Column:
    """Entries of one text in the order in which they stay, the greatest first; null ids come last, equal ids by row."""
    return F.struct(turned(ident, keep).alias("ident"), (-row).alias("row"))


def turned(ident: Column, keep: str) -> Column:
    """An identifier such that the one to keep is the largest; its own inverse, and safe at the ends of the range."""
    return {"largest": ident, "smallest": F.bitwise_not(ident)}[keep]


def entries(docs: DataFrame, ident: str) -> DataFrame:
    """One entry per row: ident, row (a number of its own), run (the partition it is in), and DIGEST; written to the shared folder."""
    text = common.whole(docs["text"])
    rows = docs.select(docs[ident].cast("long").alias("ident"), text.alias("text"))
    rows = rows.select("ident", F.xxhash64("text").alias("digest"), F.unhex(F.sha2("text", 256)).alias("sha"), F.octet_length("text").alias("size"))
    # Written first: partition and row numbers then name the same entries in every later stage, whatever is lost.
    return common.checkpointed(rows).select("*", F.monotonically_increasing_id().alias("row"), F.spark_partition_id().cast("long").alias("run"))


def merged_runs(runs: DataFrame) -> DataFrame:
    """One round: the entries of FAN runs as one run, equal neighbours merged into one entry."""
    return runs.groupBy(F.shiftright("run", FAN_BITS).alias("run"), *DIGEST).agg(F.max("best").alias("best"), F.sum("n").alias("n"))


def tree_merge(runs: DataFrame, count: int) -> DataFrame:
    """The one run that is left of so many: DIGEST, best (of the rank), n (rows)."""
    while True:
        runs = merged_runs(runs)
        count = -(-count >> FAN_BITS)
        if count <= 1:
            return runs.drop("run")


def groups(docs: DataFrame, keep: str = "largest", ident: str = "doc_id") -> DataFrame:
    """ident, row, sha, keep_ident, keep_row, n for every row of docs: its group of equal texts and the row that stays."""
    rows = entries(docs, ident)
    last = tree_merge(rows.select("run", *DIGEST, rank(F.col("ident"), F.col("row"), keep).alias("best"), F.lit(1).cast("long").alias("n")), max(1, rows.rdd.getNumPartitions()))
    again = last.where(F.col("n") > 1).select(*(F.col(c).alias(f"g_{c}") for c in DIGEST), turned(F.col("best.ident"), keep).alias("keep_ident"), (-F.col("best.row")).alias("keep_row"), "n")
    joined = rows.join(again, [F.col(c) == F.col(f"g_{c}") for c in DIGEST], "left")
    alone = F.col("n").isNull()
    return joined.select("ident", "row", "sha", "size", F.when(alone, F.col("ident")).otherwise(F.col("keep_ident")).alias("keep_ident"), F.coalesce("keep_row", "row").alias("keep_row"), F.coalesce("n", F.lit(1).cast("long")).alias("n"))


def copy_report(docs: DataFrame, keep: str = "largest") -> DataFrame:
    """The contract's columns: one row per document, dropped ones too."""
    found = groups(docs, keep)
    return found.select(F.col("ident").alias("doc_id"), F.col("keep_ident").alias("keep_id"), F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, keep: str = "largest", ident: str = "doc_id") -> DataFrame:
    """docs without all but one of equal texts; of rows that repeat id and text any one stays. All columns are kept."""
    stays = groups(docs, keep, ident).where(F.col("row") == F.col("keep_row")).select(F.col("sha").alias("g_sha"), F.col("ident").alias("g_ident"))
    rows = docs.select(F.struct("*").alias("whole"), docs[ident].cast("long").alias("ident"), F.unhex(F.sha2(common.whole(docs["text"]), 256)).alias("sha"))
    rows = rows.join(stays, (F.col("sha") == F.col("g_sha")) & F.col("ident").eqNullSafe(F.col("g_ident")), "left_semi")
    return rows.dropDuplicates(["sha", "ident"]).select(*(F.col("whole")[c].alias(c) for c in docs.columns))


ORACLE = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text) AS group_size, row_number() OVER w = 1 AS kept, sha256(text) AS text_sha256
FROM d WINDOW w AS (PARTITION BY text ORDER BY doc_id DESC NULLS LAST)"""
