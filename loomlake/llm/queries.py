"""The queries opN_<name> of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline

from . import chat, clusters, common, decontam, exact, licenses, lines, media, mixing, quality, secrets, simhash, spelling, urls


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(common.table(spark, sf_dir, "documents"))


def op2_benchmark_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.overlaps(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.drop("body").distinct()


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_quality(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return scored.drop("body")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.chat_report(common.table(spark, sf_dir, "conversations"))


def op5_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = urls.page_labels(common.table(spark, sf_dir, "labels"))
    return urls.judge_urls(common.table(spark, sf_dir, "pages"), labels)


def op6_simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_report(common.table(spark, sf_dir, "documents"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(common.table(spark, sf_dir, "documents"))


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(common.table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op9_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(common.table(spark, sf_dir, "documents"))


def op10_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(common.table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clusters.cluster(common.table(spark, sf_dir, "embeddings"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(common.table(spark, sf_dir, "documents"))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.copy_report(common.table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_benchmark_overlaps": op2_benchmark_overlaps,
    "op3_quality_rules": op3_quality_rules,
    "op4_chat_format": op4_chat_format,
    "op5_url_verdicts": op5_url_verdicts,
    "op6_simhash_components": op6_simhash_components,
    "op7_licenses": op7_licenses,
    "op8_source_mix": op8_source_mix,
    "op9_line_templates": op9_line_templates,
    "op10_transport_streams": op10_transport_streams,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_dedup": op13_exact_dedup,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op1_secrets": secrets.oracle(),
    "op2_benchmark_overlaps": decontam.oracle(),
    "op4_chat_format": chat.ORACLE,
    "op5_url_verdicts": urls.oracle(),
    "op7_licenses": licenses.oracle(),
    "op9_line_templates": lines.oracle(),
    "op11_centroid_clusters": clusters.oracle(),
    "op12_spelling_variants": spelling.oracle(),
    "op13_exact_dedup": exact.ORACLE,
    "op8_source_mix": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight FROM t),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
        / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
      FROM w WINDOW o AS (ORDER BY 3 * source_size / weight, source NULLS LAST)),
g AS (SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), max(level) OVER () * weight) AS target FROM l),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM g),
h AS (SELECT d.*, sha256(coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x FROM d),
u AS (SELECT h.doc_id, h.source, h.size, r.source_size, r.target, CAST(floor(rate) AS BIGINT) AS whole,
        k, CAST(('0x' || substr(x, 8 * k + 1, 8)) AS BIGINT) / 4294967296.0 < rate - floor(rate) AS more
      FROM h JOIN r ON h.source IS NOT DISTINCT FROM r.source, range(0, 8) AS q(k)),
m AS (SELECT source, k, abs(CAST(sum(size * (whole + CAST(more AS BIGINT))) AS BIGINT) - any_value(target)) AS off FROM u GROUP BY source, k),
b AS (SELECT source, k FROM m QUALIFY row_number() OVER (PARTITION BY source ORDER BY off, k) = 1)
SELECT u.doc_id, u.size, u.source_size, u.target, CAST(u.size * (whole + CAST(more AS BIGINT)) AS BIGINT) AS taken, CAST(whole + CAST(more AS BIGINT) AS BIGINT) AS copies
FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source AND u.k = b.k""",
}
