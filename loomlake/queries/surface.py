"""The rest of the named queries, and queries on sources, sinks and scalar functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.functions import scalars
from loomlake.operators import log, reads, text
from loomlake.plans import ranges
from loomlake.registry import query
from loomlake.sources import files
from loomlake.sources.tables import CALLS_SQL, LOG_SQL, event_log, model_calls, table

#: Capabilities, the table that stands behind each, and how it is provided where that table has rows: fixed values.
CAPABILITIES = (("bus", "events", "local"), ("sync", "events", "local"), ("meter", "lineitem", "local"), ("workers", "orders", "local"), ("credentials", "customer", "local"), ("search", "documents", "local"), ("models", "embeddings", "hosted"), ("storage", "pages", "local"), ("telemetry", "labels", "local"))


@query(" UNION ALL ".join(f"SELECT '{i}' AS id, CASE WHEN count(*) > 0 THEN '{m}' ELSE 'unavailable' END AS mode, count(*) AS rows FROM {t}" for i, t, m in CAPABILITIES) + " UNION ALL SELECT 'identity', 'unavailable', 0")
def surface_capability_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is there to be asked: every capability with how it is provided, by what its table holds."""
    one = [table(spark, sf_dir, t).agg(F.count("*").alias("rows")).select(F.lit(i).alias("id"), F.when(F.col("rows") > 0, m).otherwise("unavailable").alias("mode"), "rows") for i, t, m in CAPABILITIES]
    return reduce(DataFrame.unionByName, one).unionByName(spark.range(1).select(F.lit("identity").alias("id"), F.lit("unavailable").alias("mode"), F.lit(0).cast("long").alias("rows")))


@query("SELECT lower(hex(encode(r_name))) AS project_id, r_name AS name, row_number() OVER (ORDER BY lower(hex(encode(r_name)))) AS position FROM region")
def surface_project_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Projects in the order of their ids' bytes."""
    r = table(spark, sf_dir, "region").select(scalars.hex_id(F.encode("r_name", "UTF-8")).alias("project_id"), F.col("r_name").alias("name"))
    return log.numbered(r, "project_id", name="position")


@query(f"WITH {LOG_SQL} SELECT 'events' AS counter, count(*) AS value FROM log UNION ALL SELECT 'errors', count(*) FILTER (kind = 'error') FROM log UNION ALL SELECT 'devices', count(DISTINCT device) FROM log")
def surface_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = event_log(spark, sf_dir).agg(F.count("*").alias("events"), F.count_if(F.col("kind") == "error").alias("errors"), F.count_distinct("device").alias("devices"))
    return one.select(F.inline(F.array(*(F.struct(F.lit(c).alias("counter"), F.col(c).alias("value")) for c in ("events", "errors", "devices")))))


@query("""WITH p AS (SELECT doc_id, source, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 50) SELECT p.doc_id AS evidence_id, source AS source_id, CASE WHEN l.doc_id IS NULL THEN 'raw' WHEN quality = 0 THEN 'failed' ELSE 'ready' END AS status,
CASE WHEN l.doc_id IS NOT NULL THEN 'normalize,chunk' END AS stages FROM p LEFT JOIN labels l ON p.doc_id = l.doc_id""")
def surface_evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of items with their stages: the page first, then one join."""
    page = reads.page(table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars"), [F.desc("n_chars"), "doc_id"], 50)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("of"), "quality")
    status = F.when(F.col("of").isNull(), "raw").when(F.col("quality") == 0, "failed").otherwise("ready")
    joined = page.join(labels, F.col("doc_id") == F.col("of"), "left")
    return joined.select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_id"), status.alias("status"), F.when(F.col("of").isNotNull(), "normalize,chunk").alias("stages"))


@query("""SELECT turn AS segment_index, coalesce(CASE WHEN turn % 2 = 1 THEN upper(text) END, text) AS rendered, turn % 2 = 1 AS is_edited, CASE role WHEN 'user' THEN 'Asker' WHEN 'assistant' THEN 'Helper' ELSE 'unnamed' END AS speaker
FROM conversations WHERE conv_id = (SELECT conv_id FROM conversations GROUP BY conv_id ORDER BY count(*) DESC, conv_id LIMIT 1) AND turn >= 0 ORDER BY turn LIMIT 200""")
def surface_transcript_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the longest transcript, corrections before what was heard, with speakers' names."""
    c = table(spark, sf_dir, "conversations")
    longest = c.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "of").limit(1)
    c = c.join(F.broadcast(longest), F.col("conv_id") == F.col("of"), "left_semi")  # one row
    own = F.col("text")
    edited = F.when(F.col("turn") % 2 == 1, F.upper(own))
    page = reads.after(c, "turn", None, 200)
    return page.select(F.col("turn").alias("segment_index"), F.coalesce(edited, own).alias("rendered"), edited.isNotNull().alias("is_edited"), F.when(F.col("role") == "user", "Asker").when(F.col("role") == "assistant", "Helper").otherwise("unnamed").alias("speaker"))


@query("""WITH s AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS segment, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
o AS (SELECT *, CAST(coalesce(sum(octet_length(encode(segment)) + 1) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS byte_start FROM s)
SELECT doc_id, byte_start, byte_start + octet_length(encode(segment)) AS byte_end FROM o WHERE trim(segment) <> ''""")
def segment_records_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments packed as little-endian records and read back."""
    segs = text.segments(table(spark, sf_dir, "documents"), "doc_id", F.col("text"), "\\n")
    fields = ("byte_start", "byte_end")
    return files.decoded_segments(files.segment_records(segs, "doc_id", fields), "doc_id", fields)


@query("SELECT item_id, substr(hex(encode(text)), 21, 80) AS bytes_hex, strlen(text) AS n_bytes FROM benchmark")
def text_byte_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes 10 to 50 of each text."""
    b = table(spark, sf_dir, "benchmark")
    return b.select("item_id", F.hex(F.substring(F.encode("text", "UTF-8"), 11, 40)).alias("bytes_hex"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("""WITH e AS (SELECT event_id + 1 AS seq, md5('7:' || (event_id + 1)) AS h FROM events), n AS (SELECT seq, CAST('0x' || substr(h, 1, 7) AS BIGINT) % 100 AS pick, CAST('0x' || substr(h, 9, 7) AS BIGINT) % 3 AS device, CAST('0x' || substr(h, 17, 7) AS BIGINT) % 1000000 AS amount FROM e)
SELECT seq, device, CASE WHEN pick < 45 THEN 'step' WHEN pick < 55 THEN 'start' WHEN pick < 65 THEN 'finish' WHEN pick < 78 THEN 'enqueue' WHEN pick < 88 THEN 'complete' WHEN pick < 94 THEN 'rename' ELSE 'audit' END AS kind, amount FROM n""")
def synthetic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A made-up twin of the log: for each of its numbers the event that a seed gives."""
    return files.synthetic_events(event_log(spark, sf_dir).select("seq"), 7)


@query("""WITH h AS (SELECT sha256(text) AS hash, doc_id, length(text) AS n FROM documents) SELECT DISTINCT hash, n AS n_chars FROM h WHERE hash NOT IN (SELECT hash FROM h WHERE doc_id % 3 = 0)""")
def new_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs that a store, which has every third, still lacks."""
    d = table(spark, sf_dir, "documents")
    stored = d.where("doc_id % 3 = 0").select(F.sha2("text", 256).alias("hash"))
    return files.new_blobs(d.select(F.col("text").alias("content")), stored).select("hash", F.char_length("content").cast("long").alias("n_chars"))


@query("""WITH d AS (SELECT doc_id, sha256(doc_id || ':' || text) AS hash, octet_length(encode(doc_id || ':' || text)) AS n FROM documents)
SELECT d.doc_id, CASE WHEN d.doc_id % 7 = 0 THEN 'missing' WHEN d.doc_id % 11 = 0 THEN 'corrupt' ELSE 'ok' END AS status, CASE WHEN d.doc_id % 7 <> 0 AND d.doc_id % 11 <> 0 THEN n END AS n_bytes FROM d""")
def blob_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs asked for by hash; what is absent, or no longer what its name says, is not given."""
    content = F.concat_ws(":", F.col("doc_id").cast("string"), "text")
    d = table(spark, sf_dir, "documents").select("doc_id", content.alias("content"), F.sha2(content, 256).alias("hash"))
    store = d.where("doc_id % 7 <> 0").select("hash", F.when(F.col("doc_id") % 11 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")).alias("content"))
    return files.read_blobs(d.select("doc_id", "hash"), store).select("doc_id", "status", F.octet_length("content").cast("long").alias("n_bytes"))


@query(f"""WITH {CALLS_SQL} SELECT feature, cost_kind, CASE WHEN cost_kind = 'customer_billed' THEN 'customer_billed' WHEN tokens_in > 25 THEN 'measured' ELSE 'estimated' END AS provider_cost, count(*) AS n, round(CAST(sum(tokens_in) AS DOUBLE) * 1000 / sum(wall_ms + 1), 6) AS tokens_per_s FROM calls GROUP BY 1, 2, 3""")
def cost_kind_and_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How a call's cost is known, and the rate of its tokens."""
    kind = F.when(F.col("cost_kind") == "customer_billed", "customer_billed").when(F.col("tokens_in") > 25, "measured").otherwise("estimated")
    rate = F.sum("tokens_in").cast("double") * 1000 / F.sum(F.col("wall_ms") + 1)
    return model_calls(spark, sf_dir).groupBy("feature", "cost_kind", kind.alias("provider_cost")).agg(F.count("*").alias("n"), F.round(rate, 6).alias("tokens_per_s"))


@query("""WITH s AS (SELECT conv_id, turn, turn * 9000 + (turn % 3) * 400 AS start_ms FROM conversations), k AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY start_ms, turn) - 1 AS idx FROM s WHERE start_ms >= (turn // 2) * 18000 AND start_ms >= 9000)
SELECT conv_id, turn, start_ms, idx FROM k""")
def segment_commit_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded segments that start before what is committed go; the rest are numbered without gaps."""
    s = table(spark, sf_dir, "conversations").select("conv_id", "turn", (F.col("turn") * 9000 + (F.col("turn") % 3) * 400).alias("start_ms"))
    kept = s.where((F.col("start_ms") >= F.floor(F.col("turn") / 2) * 18000) & (F.col("start_ms") >= 9000))
    return ranges.running(kept, ("conv_id",), ("start_ms", "turn"), {"idx": F.lit(1).cast("long")})


@query("""SELECT conv_id, min(turn) FILTER (role <> 'system') AS locator_start, max(turn) FILTER (role <> 'system') AS locator_end, 'message' AS locator_kind FROM conversations GROUP BY conv_id""")
def locator_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.when(F.col("role") != "system", F.col("turn"))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min(own).alias("locator_start"), F.max(own).alias("locator_end"), F.first(F.lit("message")).alias("locator_kind"))


@query("""WITH w AS (SELECT doc_id, n_chars FROM documents), x AS (SELECT doc_id, unnest(range(0, greatest(CAST(n_chars AS BIGINT), 1), 4000)) AS window_start, n_chars FROM w) SELECT doc_id, window_start, least(window_start + 4000, n_chars) AS window_end FROM x""")
def byte_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A long item in windows of fixed size, as a stream of it is processed."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("n_chars") - 1, F.lit(0)), F.lit(4000).cast("long"))).alias("window_start"))
    return d.select("doc_id", "window_start", F.least(F.col("window_start") + 4000, F.col("n_chars")).alias("window_end"))


@query("""WITH e AS (SELECT s_suppkey AS a, s_nationkey AS b FROM supplier), ok AS (SELECT n_nationkey AS b, n_regionkey AS r FROM nation WHERE n_regionkey < 3) SELECT a, b FROM e WHERE NOT EXISTS (SELECT 1 FROM ok WHERE ok.b = e.b)""")
def dependency_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that no rule allows."""
    e = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("b"))
    ok = table(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("b"))
    return e.join(ok, "b", "left_anti").select("a", "b")
