"""The corpus pipeline: quality, line dedup, near duplicates, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the
columns of documents. run() writes each stage as Parquet to the shared checkpoint folder and reads it again for
the next, so a lost executor costs no more than a stage's own work; what a stage has read is removed once its own
output stands.

Edge cases are those of the operators, which keep all columns whatever their names: null texts are empty, null ids
are ids, rows that repeat id and text are one after the near-duplicate stage, an empty table gives an empty mixture.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.llm import common, decontam, lines, mixing, quality, simhash
from loomlake.session import scratch
from loomlake.sources import folders


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble does not reject."""
    return quality.filter_quality(docs, common.table(spark, sf_dir, "labels"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates."""
    return lines.drop_lines(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: SimHash with pivot tables proposes pairs, a sketch those beyond its radius, and texts are linked by a similarity of 0.8 or more of their sets of five-word shingles, compared in full."""
    return simhash.drop_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontam.decontaminate(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixture: documents repeated to meet the weights of their sources, with mix_copy and words."""
    mixed = mixing.mix(docs)
    return mixed.select("doc_id", "lang", "source", "text", "mix_copy", mixing.words(F.col("text")).alias("words"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("near duplicates", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing to weights", mixing_stage),
]

#: The quality stage is a fitted model and near duplicates are an iterated walk: no SQL gives their rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs, read = common.table(spark, sf_dir, "documents"), None
    for k, (_, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if read is not None:
            folders.remove(spark, read)
        docs, read = spark.read.parquet(path), path
    return docs
