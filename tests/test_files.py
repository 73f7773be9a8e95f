"""Files that the queries write."""

from pyspark.sql import functions as F

from loomlake.queries import files
from loomlake.sources import files as sources


def test_intake_deals_a_language_into_files(spark, data, monkeypatch):
    """No file, and so no task, holds a whole large language; the bytes are all there, and intake is not cut."""
    monkeypatch.setattr(files, "FILE_BYTES", 20_000)
    monkeypatch.setattr(files, "FILES", 40)
    plans, plan = [], sources.plan_intake
    monkeypatch.setattr(files.files, "plan_intake", lambda *a: plans.append(plan(*a).select("length").collect()) or plan(*a))
    got = {r.lang: (r.taken, r.n_bytes, r.truncated) for r in files.file_intake(spark, data).collect()}
    d = spark.read.parquet(f"{data}/documents.parquet").where("text IS NOT NULL")
    sizes = {r.lang: r.n for r in d.groupBy("lang").agg(F.sum(F.octet_length("text") + 1).alias("n")).collect()}
    assert got == {k: (True, n, False) for k, n in sizes.items()}
    lengths = [r.length for r in plans[0]]
    assert len(sizes) < len(lengths) <= 2 * 40 and max(lengths) < max(sizes.values()) / 2
