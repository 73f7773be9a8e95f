"""A session for local work, and the folder that driver and executors share.

On a cluster the session comes from outside and is used as it is; intermediate data then goes to the folder that it
names in spark.checkpoint.dir, and nowhere else.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


class NoSharedFolder(Exception):
    """A cluster whose session names no folder that all of its machines share."""


def local_session(cpus: int = 8, memory: str = "8g") -> SparkSession:
    conf = {
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.driver.memory": memory,
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Checkpoints go when nothing refers to them any more.
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    }
    spark = SparkSession.builder.master(f"local[{cpus}]").appName("loomlake").config(map=conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data: spark.checkpoint.dir, else what the context was given, else, on one machine alone, a temporary one."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named
    if context.master != "local" and not context.master.startswith("local["):
        raise NoSharedFolder("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="loomlake-")
    context.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """df with its lineage cut, kept in the shared folder; survives the loss of any executor."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def sized(df: DataFrame, rows: int) -> DataFrame:
    """df written out and counted: marked for broadcast if it has at most so many rows, else left to be joined by a shuffle.

    Without the mark, the large side of a join would be shuffled before the small one is known to be small.
    """
    from pyspark.sql import functions as F

    df = checkpointed(df)
    return F.broadcast(df) if df.count() <= rows else df
