"""Further operators of the inventory: admission, leases, stages, windows of speech, inputs of embedding, validity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import log, queue
from loomlake.registry import query
from loomlake.sources.tables import JOBS_SQL, LEASES_SQL, LOG_SQL, NOW_MS, event_log, jobs, leases, table


@query(f"""WITH {LOG_SQL}, r AS (SELECT seq, device, kind || ':' || (seq % 40) AS key FROM log WHERE kind = 'signup'), f AS (SELECT *, row_number() OVER (PARTITION BY device, key ORDER BY seq) AS nth FROM r),
n AS (SELECT *, sum(CASE WHEN nth = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY device ORDER BY seq) AS held FROM f)
SELECT device, seq, CASE WHEN nth > 1 THEN 'conflict' WHEN held > 30 THEN 'resource_exhausted' ELSE 'admitted' END AS outcome FROM n""")
def registry_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries into registries of bounded size: a repeated key conflicts, a full registry refuses."""
    r = event_log(spark, sf_dir).where("kind = 'signup'").select("seq", "device", F.concat("kind", F.lit(":"), (F.col("seq") % 40).cast("string")).alias("key"))
    # Only the first request of a key can be admitted; those are numbered by device, in as many tasks as they need.
    firsts = r.groupBy("device", "key").agg(F.min("seq").alias("first_seq"))
    held = log.numbered(firsts, "first_seq", by=("device",), name="held").select(F.col("device").alias("of"), F.col("key").alias("key_"), "first_seq", "held")
    n = r.join(held, (F.col("device") == F.col("of")) & (F.col("key") == F.col("key_")))
    return n.select("device", "seq", F.when(F.col("seq") > F.col("first_seq"), "conflict").when(F.col("held") > 30, "resource_exhausted").otherwise("admitted").alias("outcome"))


@query(f"""WITH {JOBS_SQL}, {LEASES_SQL}, h AS (SELECT job_id, (job_id + CASE WHEN job_id % 5 = 0 THEN 1 ELSE 0 END) % 4 AS worker FROM jobs WHERE state = 'queued' AND job_id % 2 = 0)
SELECT h.job_id, l.worker IS NOT NULL AS changed, CASE WHEN l.worker IS NOT NULL THEN {NOW_MS} + 60000 END AS expires_ts_ms FROM h LEFT JOIN leases l ON h.job_id = l.job_id AND h.worker = l.worker AND l.expires_ts_ms > {NOW_MS}""")
def lease_heartbeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A heartbeat extends a lease that is alive and the worker's own; else it changes nothing."""
    beats = jobs(spark, sf_dir).where("state = 'queued' AND job_id % 2 = 0").select("job_id", ((F.col("job_id") + F.when(F.col("job_id") % 5 == 0, 1).otherwise(0)) % 4).alias("worker"))
    live = leases(spark, sf_dir).where(F.col("expires_ts_ms") > NOW_MS).withColumn("alive", F.lit(True))
    joined = beats.join(live.drop("expires_ts_ms"), ["job_id", "worker"], "left")
    changed = F.coalesce("alive", F.lit(False))
    return joined.select("job_id", changed.alias("changed"), F.when(changed, F.lit(NOW_MS) + 60000).alias("expires_ts_ms"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT entity, seq, CASE kind WHEN 'view' THEN 'start' WHEN 'click' THEN 'finish' ELSE 'fail' END AS fact, ts_ms FROM log WHERE kind IN ('view', 'click', 'error')),
l AS (SELECT entity, max(seq) AS started FROM s WHERE fact = 'start' GROUP BY entity)
SELECT s.entity, max(CASE WHEN fact = 'start' THEN 1 ELSE 0 END) = 1 AS started, count(*) FILTER (fact = 'finish' AND seq > started) AS finished, count(*) FILTER (fact = 'fail' AND seq > started) AS failed,
CASE WHEN count(*) FILTER (fact = 'finish' AND seq > started) > 0 THEN 'done' WHEN count(*) FILTER (fact = 'fail' AND seq > started) >= 3 THEN 'dead' WHEN count(*) FILTER (fact = 'fail' AND seq > started) > 0 THEN 'retrying' ELSE 'running' END AS state
FROM s JOIN l ON s.entity = l.entity GROUP BY s.entity""")
def stage_execution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage rows: each start resets the row, so only facts after the latest start count."""
    fact = F.when(F.col("kind") == "view", "start").when(F.col("kind") == "click", "finish").otherwise("fail")
    s = event_log(spark, sf_dir).where("kind IN ('view', 'click', 'error')").select("entity", "seq", fact.alias("fact"))
    latest = s.where("fact = 'start'").groupBy(F.col("entity").alias("of")).agg(F.max("seq").alias("started_seq"))
    after = F.col("seq") > F.col("started_seq")
    rows = s.join(latest, F.col("entity") == F.col("of")).groupBy("entity").agg(
        F.bool_or(F.col("fact") == "start").alias("started"), F.count_if((F.col("fact") == "finish") & after).alias("finished"), F.count_if((F.col("fact") == "fail") & after).alias("failed")
    )
    state = F.when(F.col("finished") > 0, "done").when(F.col("failed") >= 3, "dead").when(F.col("failed") > 0, "retrying").otherwise("running")
    return rows.withColumn("state", state)


@query("""WITH t AS (SELECT conv_id, sum(length(text)) * 60 AS total_ms FROM conversations GROUP BY conv_id), w AS (SELECT conv_id, CAST(total_ms AS BIGINT) AS total_ms, unnest(range(0, CAST(total_ms AS BIGINT), 29000)) AS from_ms FROM t)
SELECT conv_id, from_ms, least(from_ms + 30000, total_ms) AS to_ms FROM w""")
def speech_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 30 s that overlap by one, over recordings as long as their texts."""
    t = table(spark, sf_dir, "conversations").groupBy("conv_id").agg((F.sum(F.char_length("text")) * 60).alias("total_ms")).where("total_ms > 0")
    w = t.select("conv_id", "total_ms", F.explode(F.sequence(F.lit(0).cast("long"), F.col("total_ms") - 1, F.lit(29000).cast("long"))).alias("from_ms"))
    return w.select("conv_id", "from_ms", F.least(F.col("from_ms") + 30000, F.col("total_ms")).alias("to_ms"))


@query("SELECT doc_id, sha256(concat_ws(chr(10) || chr(10), nullif(source, 'src0'), text)) AS input_sha256 FROM documents")
def embed_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded: a prefix, if there is one, a blank line, the text."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.concat_ws("\n\n", F.nullif("source", F.lit("src0")), "text"), 256).alias("input_sha256"))


@query("SELECT doc_id, strlen(text) AS n_bytes, strlen(text) > 10 AND (ascii(right(text, 1)) > 127) AS cut_breaks FROM documents")
def utf8_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a text cut one byte short still is UTF-8."""
    raw = F.encode("text", "UTF-8")
    cut = F.substr(raw, F.lit(1), F.octet_length("text") - 1)
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), ((F.octet_length("text") > 10) & ~F.is_valid_utf8(cut.cast("string"))).alias("cut_breaks"))


@query(f"""WITH {JOBS_SQL}, w AS (SELECT job_id, attempt_count, CAST(least(2000 * pow(2, attempt_count - 1), 900000) AS BIGINT) AS window_ms, CAST('0x' || substr(md5(job_id || ':' || attempt_count), 1, 12) AS BIGINT) AS h FROM jobs WHERE attempt_count > 0)
SELECT job_id, h % (window_ms + 1) AS wait_ms FROM w""")
def jittered_retry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full jitter: a reproducible draw between nothing and the whole window."""
    j = jobs(spark, sf_dir).where("attempt_count > 0")
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("job_id").cast("string"), F.col("attempt_count").cast("string"))), 1, 12), 16, 10).cast("long")
    return j.select("job_id", (h % (queue.backoff_window(F.col("attempt_count")) + 1)).alias("wait_ms"))


@query("""WITH e AS (SELECT vec_id, label, list_sum(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN CAST(x AS DOUBLE) ELSE 0 END)) AS s, len(list_filter(embedding, lambda x: x > 0)) AS n FROM embeddings)
SELECT vec_id, round(s / n, 5) AS masked_mean FROM e WHERE n > 0""")
def masked_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean over the positions that a mask keeps (here the positive ones)."""
    kept = F.filter("embedding", lambda x: x > 0)
    total = F.aggregate(kept, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", total.alias("s"), F.size(kept).alias("n"))
    return e.where("n > 0").select("vec_id", F.round(F.col("s") / F.col("n"), 5).alias("masked_mean"))


@query("""SELECT source, lang, count(*) AS items, CAST(sum(n_chars) AS BIGINT) AS chars, round(CAST(sum(n_chars) AS DOUBLE) / 1048576, 6) AS mib FROM documents GROUP BY ROLLUP (source, lang)""")
def source_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra: totals by source and language with subtotals."""
    return table(spark, sf_dir, "documents").rollup("source", "lang").agg(F.count("*").alias("items"), F.sum("n_chars").alias("chars"), F.round(F.sum("n_chars").cast("double") / 1048576, 6).alias("mib"))
