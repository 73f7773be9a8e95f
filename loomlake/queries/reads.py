"""Relational reads: filters, pages, joins, semi and anti joins, set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators import reads as ops
from loomlake.registry import query
from loomlake.sources.tables import JOBS_SQL, LOG_SQL, event_log, jobs, table

WORDS = "CAST(n_chars AS BIGINT)"


@query(f"WITH {JOBS_SQL} SELECT job_id, project, priority_rank FROM jobs WHERE state = 'queued' AND class = 'cpu' ORDER BY enqueued_seq DESC, job_id LIMIT 50")
def list_filtered_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    mine = ops.matching(jobs(spark, sf_dir), state="queued", **{"class": "cpu"}, project=None)
    return ops.page(mine, [F.desc("enqueued_seq"), "job_id"], 50).select("job_id", "project", "priority_rank")


@query("SELECT doc_id AS evidence_id, source AS source_id, n_chars FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 500")
def evidence_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = ops.matching(table(spark, sf_dir, "documents"), lang="en")
    return ops.page(d, [F.desc("n_chars"), "doc_id"], 10_000).select(F.col("doc_id").alias("evidence_id"), F.col("source").alias("source_id"), "n_chars")


@query("SELECT conv_id, turn, role FROM conversations WHERE conv_id = 12 AND turn >= 3 ORDER BY turn LIMIT 200")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.after(table(spark, sf_dir, "conversations").where("conv_id = 12"), "turn", 2, 200).select("conv_id", "turn", "role")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 77")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("doc_id = 77").select("doc_id", "lang", "source", "n_chars")


@query("""SELECT d.doc_id AS evidence_id, array_to_string(list(s.stage || ':' || s.state ORDER BY s.rank) FILTER (s.stage IS NOT NULL), ',') AS history FROM documents d LEFT JOIN (
SELECT doc_id, 'normalize' AS stage, 0 AS rank, CASE quality WHEN 1 THEN 'ok' ELSE 'failed' END AS state FROM labels UNION ALL SELECT doc_id, 'chunk', 1, CASE toxic WHEN 0 THEN 'ok' ELSE 'dead' END FROM labels) s ON d.doc_id = s.doc_id GROUP BY d.doc_id""")
def nested_history_collect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each item with its stages in pipeline order: a join and a small list, in place of a query per item."""
    labels = table(spark, sf_dir, "labels")
    steps = F.array(F.struct(F.lit(0).alias("rank"), F.lit("normalize").alias("stage"), F.when(F.col("quality") == 1, "ok").otherwise("failed").alias("state")), F.struct(F.lit(1).alias("rank"), F.lit("chunk").alias("stage"), F.when(F.col("toxic") == 0, "ok").otherwise("dead").alias("state")))
    stages = labels.select(F.col("doc_id").alias("of"), F.inline(steps))
    joined = table(spark, sf_dir, "documents").select("doc_id").join(stages, F.col("doc_id") == F.col("of"), "left")
    grouped = joined.groupBy(F.col("doc_id").alias("evidence_id")).agg(F.array_sort(F.collect_list(F.when(F.col("stage").isNotNull(), F.struct("rank", "stage", "state")))).alias("steps"))
    return grouped.select("evidence_id", F.when(F.size("steps") > 0, F.array_join(F.transform("steps", lambda s: F.concat_ws(":", s["stage"], s["state"])), ",")).alias("history"))


@query(f"WITH {LOG_SQL}, p AS (SELECT entity, max(seq // 1000) AS pass FROM log GROUP BY entity) SELECT log.entity, count(*) AS chunks, min(seq) AS first_seq FROM log JOIN p ON log.entity = p.entity AND log.seq // 1000 = p.pass GROUP BY log.entity")
def current_pass_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only rows of each item's current pass; older passes stay in the table."""
    log = event_log(spark, sf_dir).withColumn("pass", F.floor(F.col("seq") / 1000))
    current = log.groupBy("entity").agg(F.max("pass").alias("pass"))
    return log.join(current, ["entity", "pass"]).groupBy("entity").agg(F.count("*").alias("chunks"), F.min("seq").alias("first_seq"))


@query("""WITH h AS (SELECT doc_id, sha256(text) AS content FROM documents), v AS (SELECT content, min(doc_id) AS vector_of FROM h GROUP BY content) SELECT h.doc_id, v.vector_of, h.doc_id <> v.vector_of AS reused FROM h LEFT JOIN v ON h.content = v.content""")
def first_match_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each text with the first row of the same content: what can be reused instead of computed."""
    h = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("content"))
    v = ops.first_match(h, ["content"], "doc_id").select("content", F.col("doc_id").alias("vector_of"))
    return h.join(v, "content", "left").select("doc_id", "vector_of", (F.col("doc_id") != F.col("vector_of")).alias("reused"))


@query("SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def skip_done_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "labels").select("doc_id")
    return table(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@query("SELECT o_orderkey AS session_id, c_name AS account FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'O' AND c_acctbal >= 0")
def session_identity_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open sessions with their accounts; which side is sent around is left to sizes at run time."""
    o, c = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'"), table(spark, sf_dir, "customer").where("c_acctbal >= 0")
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("session_id"), F.col("c_name").alias("account"))


@query("""WITH f AS (SELECT p_partkey AS name, md5(p_name) AS hash FROM part WHERE p_partkey % 5 <> 0), k AS (SELECT p_partkey AS name, CASE WHEN p_partkey % 7 = 0 THEN md5(p_name || '!') ELSE md5(p_name) END AS pin FROM part WHERE p_partkey % 3 <> 0)
SELECT coalesce(f.name, k.name) AS name, CASE WHEN f.name IS NULL THEN 'orphan pin' WHEN k.name IS NULL THEN 'not pinned' ELSE 'changed' END AS problem FROM f FULL OUTER JOIN k ON f.name = k.name WHERE f.name IS NULL OR k.name IS NULL OR hash <> pin""")
def full_outer_lock_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files against the lock: pins without a file, files without a pin, files that changed."""
    p = table(spark, sf_dir, "part")
    f = p.where("p_partkey % 5 <> 0").select(F.col("p_partkey").alias("name"), F.md5("p_name").alias("hash"))
    k = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("name"), F.when(F.col("p_partkey") % 7 == 0, F.md5(F.concat("p_name", F.lit("!")))).otherwise(F.md5("p_name")).alias("pin"))
    both = f.join(k, "name", "full_outer")
    problem = F.when(F.col("hash").isNull(), "orphan pin").when(F.col("pin").isNull(), "not pinned").when(F.col("hash") != F.col("pin"), "changed")
    return both.select("name", problem.alias("problem")).where("problem IS NOT NULL")


@query("SELECT s_suppkey, s_name FROM supplier WHERE regexp_matches(lower(s_name), 's.*?0.*?1')")
def subsequence_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where(ops.subsequence(F.col("s_name"), "S01")).select("s_suppkey", "s_name")


@query("SELECT c.conv_id, c.turn, c.role, coalesce(n.name, 'unnamed') AS speaker FROM conversations c LEFT JOIN (VALUES ('user', 'Asker'), ('assistant', 'Helper')) n(role, name) ON c.role = n.role")
def speaker_names_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = spark.createDataFrame([("user", "Asker"), ("assistant", "Helper")], "of string, name string")
    c = table(spark, sf_dir, "conversations")
    return c.join(F.broadcast(names), F.col("role") == F.col("of"), "left").select("conv_id", "turn", "role", F.coalesce("name", F.lit("unnamed")).alias("speaker"))


@query("""SELECT n_nationkey AS run_id, array_to_string(list(s_suppkey ORDER BY s_suppkey) FILTER (s_suppkey IS NOT NULL), ',') AS tools, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON n_nationkey = s_nationkey GROUP BY n_nationkey""")
def run_with_grants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each run with its tool grants in order; runs without any stay."""
    n, s = table(spark, sf_dir, "nation"), table(spark, sf_dir, "supplier")
    grouped = n.join(s, F.col("n_nationkey") == F.col("s_nationkey"), "left").groupBy(F.col("n_nationkey").alias("run_id")).agg(F.array_sort(F.collect_list("s_suppkey")).alias("t"), F.count("s_suppkey").alias("n"))
    return grouped.select("run_id", F.when(F.size("t") > 0, F.array_join(F.transform("t", lambda x: x.cast("string")), ",")).alias("tools"), "n")


@query("SELECT c_custkey AS id, lower(hex(encode(c_name))) AS id_hex, coalesce(nullif(c_mktsegment, 'MACHINERY'), 'none') AS rendered, nullif(c_mktsegment, 'MACHINERY') IS NOT NULL AS is_edited FROM customer")
def computed_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    edited = F.nullif("c_mktsegment", F.lit("MACHINERY"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.lower(F.hex(F.encode("c_name", "UTF-8"))).alias("id_hex"), F.coalesce(edited, F.lit("none")).alias("rendered"), edited.isNotNull().alias("is_edited"))


@query("SELECT o_orderstatus AS state, o_orderstatus IN ('F', 'O') AS known, count(*) AS n FROM orders GROUP BY 1")
def enum_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n")).withColumn("known", F.col("state").isin("F", "O"))


@query("SELECT doc_id, quality, toxic, nullif(quality, 1) IS NULL <> (nullif(toxic, 0) IS NULL) AS half_set FROM labels")
def both_or_neither(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields that must be set together."""
    a, b = F.nullif("quality", F.lit(1)), F.nullif("toxic", F.lit(0))
    return table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic", (a.isNull() != b.isNull()).alias("half_set"))


@query("""WITH m AS (SELECT s_suppkey AS member, s_nationkey AS workspace, s_suppkey % 3 AS rank FROM supplier), p AS (SELECT c_custkey AS path_id, c_nationkey AS workspace, c_custkey % 3 AS needed FROM customer)
SELECT path_id, count(*) FILTER (rank >= needed) AS allowed, count(*) FILTER (rank < needed) AS refused FROM p JOIN m ON p.workspace = m.workspace GROUP BY path_id""")
def acl_role_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members who may use a path: their role's rank against the rank that it needs."""
    m = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("workspace"), (F.col("s_suppkey") % 3).alias("rank"))
    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("path_id"), F.col("c_nationkey").alias("workspace"), (F.col("c_custkey") % 3).alias("needed"))
    # Counting members per workspace and rank first keeps the join at three rows a workspace.
    ranks = m.groupBy("workspace", "rank").agg(F.count("*").alias("n"))
    joined = p.join(ranks, "workspace")
    some = lambda test: F.coalesce(F.sum(F.when(test, F.col("n"))), F.lit(0))
    return joined.groupBy("path_id").agg(some(F.col("rank") >= F.col("needed")).alias("allowed"), some(F.col("rank") < F.col("needed")).alias("refused"))


@query("SELECT p_partkey, substr(trim(regexp_replace(p_name, '[[:cntrl:]]', '', 'g')), 1, 200) AS title, starts_with(p_name, '.') OR suffix(p_name, '.pos') AS skipped FROM part")
def title_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles without control characters, at most 200 characters; hidden names are skipped."""
    title = F.substring(F.btrim(F.regexp_replace("p_name", r"\p{Cntrl}", "")), 1, 200)
    return table(spark, sf_dir, "part").select("p_partkey", title.alias("title"), (F.startswith("p_name", F.lit(".")) | F.endswith("p_name", F.lit(".pos"))).alias("skipped"))


@query("SELECT DISTINCT split_part(url, '/', 3) AS directory FROM pages ORDER BY 1 LIMIT 256")
def directory_discovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.split_part("url", F.lit("/"), F.lit(3)).alias("directory")).distinct().orderBy("directory").limit(256)


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def top_rows_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(spark, sf_dir, "orders").withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_orderkey", "o_totalprice")
