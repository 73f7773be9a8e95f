"""Calls against their ledger."""

import duckdb

from loomlake.queries import chain
from loomlake.registry import ORACLES


def test_calls_of_a_task_are_bounded(spark, data, monkeypatch):
    """The number of tasks follows the rows, calls and ledger meet without a join, and the result is the SQL's."""
    monkeypatch.setattr(chain, "CALLS", 1_000)
    rows = spark.read.parquet(f"{data}/lineitem.parquet").count()
    df = chain.dispatch_ledger_equality(spark, data)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and f"RepartitionByExpression [call" in plan and f", {-(-2 * rows // 1_000)}" in plan
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{data}/lineitem.parquet'")
    assert sorted(map(tuple, df.collect())) == sorted(duck.sql(ORACLES["dispatch_ledger_equality"]).fetchall())
