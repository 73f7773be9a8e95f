"""The named queries: a name and an input to a result, as a user of the ledger asks for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import loomlake.queries  # noqa: F401
from loomlake import registry

#: Named queries and the registered queries that answer them.
NAMED = {
    "capability.snapshot": "surface_capability_snapshot",
    "project.inspect": "inspect_summary",
    "project.verify": "project_verify",
    "project.list": "surface_project_list",
    "job.list": "job_list_page",
    "cron.preview": "cron_preview",
    "cost.rollup": "cost_rollup",
    "health": "surface_health",
    "evidence.list": "surface_evidence_list",
    "source.health": "source_health",
    "transcript.get": "surface_transcript_get",
}


class UnknownQuery(KeyError):
    """No query has this name."""


def ask(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in NAMED:
        raise UnknownQuery(name)
    return registry.QUERIES[NAMED[name]](spark, sf_dir)
