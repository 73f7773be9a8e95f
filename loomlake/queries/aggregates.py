"""Aggregating queries: costs, health, counts, histograms, percentiles, verdicts, admission."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators import rollup
from loomlake.registry import query
from loomlake.sources.tables import CALLS_SQL, JOBS_SQL, LOG_SQL, event_log, jobs, model_calls, table

S = ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in ("tokens_in", "tokens_out", "usd_micros"))
OWN = "CAST(sum(CASE WHEN cost_kind = 'customer_billed' THEN 0 ELSE usd_micros END) AS BIGINT) AS own_usd_micros"


@query(f"""WITH {CALLS_SQL} SELECT CASE grouping_id(project, feature, agent) WHEN 3 THEN 'project' WHEN 5 THEN 'feature' ELSE 'agent' END AS dimension,
CASE grouping_id(project, feature, agent) WHEN 3 THEN project WHEN 5 THEN feature ELSE agent END AS key, count(*) AS calls, {S}, {OWN}
FROM calls GROUP BY GROUPING SETS ((project), (feature), (agent))""")
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cost_rollup(model_calls(spark, sf_dir))


@query(f"WITH {CALLS_SQL} SELECT project, feature, agent, model, cost_kind, count(*) AS calls, CAST(sum(wall_ms) AS BIGINT) AS wall_ms, {S} FROM calls GROUP BY ALL")
def cost_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.cost_groups(model_calls(spark, sf_dir))


@query(f"WITH {CALLS_SQL} SELECT count(*) AS calls, {S}, {OWN} FROM calls")
def cost_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.totals(model_calls(spark, sf_dir))


@query(f"""WITH {CALLS_SQL}, u AS (SELECT 'a' AS ledger, project, agent, count(*) AS calls, CAST(sum(usd_micros) AS BIGINT) AS usd_micros FROM calls WHERE feature = 'A' GROUP BY project, agent
UNION ALL SELECT 'b', project, agent, count(*), CAST(sum(usd_micros) AS BIGINT) FROM calls WHERE feature <> 'A' GROUP BY project, agent)
SELECT *, row_number() OVER (ORDER BY ledger, project, agent NULLS FIRST) AS position FROM u""")
def union_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of two ledgers in one total order, a null agent first."""
    calls = model_calls(spark, sf_dir)
    one = lambda name, df: df.groupBy(F.lit(name).alias("ledger"), "project", "agent").agg(F.count("*").alias("calls"), F.sum("usd_micros").alias("usd_micros"))
    both = one("a", calls.where("feature = 'A'")).unionByName(one("b", calls.where("feature <> 'A'")))
    order = Window.orderBy("ledger", "project", F.col("agent").asc_nulls_first())
    return both.withColumn("position", F.row_number().over(order).cast("long"))


@query(f"""WITH {CALLS_SQL}, g AS (SELECT CAST(sum(usd_micros) AS BIGINT) AS usd, count(*) AS n FROM calls)
SELECT dim, count(*) AS groups_, CAST(sum(n) AS BIGINT) AS calls, CAST(sum(usd) AS BIGINT) AS usd_micros, CAST(sum(n) AS BIGINT) = (SELECT n FROM g) AND CAST(sum(usd) AS BIGINT) = (SELECT usd FROM g) AS balanced FROM (
SELECT 'project' AS dim, project AS k, count(*) AS n, sum(usd_micros) AS usd FROM calls GROUP BY project UNION ALL SELECT 'feature', feature, count(*), sum(usd_micros) FROM calls GROUP BY feature
UNION ALL SELECT 'agent', agent, count(*), sum(usd_micros) FROM calls GROUP BY agent) GROUP BY dim""")
def ledger_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every dimension of the roll-up adds up to the ledger's total."""
    calls = model_calls(spark, sf_dir)
    rolled = rollup.cost_rollup(calls).groupBy(F.col("dimension").alias("dim")).agg(F.count("*").alias("groups_"), F.sum("calls").alias("calls"), F.sum("usd_micros").alias("usd_micros"))
    total = rollup.totals(calls).select(F.col("calls").alias("n"), F.col("usd_micros").alias("usd"))
    return rolled.join(F.broadcast(total)).select("dim", "groups_", "calls", "usd_micros", ((F.col("calls") == F.col("n")) & (F.col("usd_micros") == F.col("usd"))).alias("balanced"))


@query(f"""WITH {LOG_SQL} SELECT device AS source_id, CASE WHEN kind IN ('view', 'click') THEN 'normalize' ELSE 'chunk' END AS stage,
count(*) FILTER (kind IN ('view', 'signup', 'purchase')) AS ok_count, count(*) FILTER (kind = 'click') AS failed_count, count(*) FILTER (kind = 'error') AS dead_count,
CAST(coalesce(sum(amount) FILTER (kind <> 'error'), 0) AS BIGINT) AS bytes_total, max_by(ts_ms, seq) FILTER (kind IN ('view', 'signup', 'purchase')) AS last_success_ts_ms,
max_by(ts_ms, seq) FILTER (kind IN ('click', 'error')) AS last_failure_ts_ms, max_by(body, seq) FILTER (kind IN ('click', 'error')) AS last_error_code FROM log GROUP BY 1, 2""")
def source_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters and latest values per source and stage in one aggregation."""
    log = event_log(spark, sf_dir)
    ok, bad = F.col("kind").isin("view", "signup", "purchase"), F.col("kind").isin("click", "error")
    when = lambda c, v: F.when(c, F.col(v))
    return log.groupBy(F.col("device").alias("source_id"), F.when(F.col("kind").isin("view", "click"), "normalize").otherwise("chunk").alias("stage")).agg(
        F.count_if(ok).alias("ok_count"), F.count_if(F.col("kind") == "click").alias("failed_count"), F.count_if(F.col("kind") == "error").alias("dead_count"),
        F.coalesce(F.sum(when(F.col("kind") != "error", "amount")), F.lit(0)).alias("bytes_total"),
        F.max_by(when(ok, "ts_ms"), when(ok, "seq")).alias("last_success_ts_ms"), F.max_by(when(bad, "ts_ms"), when(bad, "seq")).alias("last_failure_ts_ms"), F.max_by(when(bad, "body"), when(bad, "seq")).alias("last_error_code"),
    )


@query(f"WITH {JOBS_SQL} SELECT class, count(*) FILTER (state = 'queued') AS queued, count(*) FILTER (state = 'done') AS done, count(*) FILTER (state = 'dead') AS dead FROM jobs GROUP BY class")
def count_by_state_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed slots per state, zero where there is none; unknown states are skipped."""
    counted = jobs(spark, sf_dir).groupBy("class").pivot("state", ["queued", "done", "dead"]).count()
    return counted.na.fill(0)


@query("SELECT source, count(*) AS n, count(DISTINCT sha256(trim(regexp_replace(text, '[ \\t\\n\\f\\r]+', ' ', 'g'), ' '))) AS distinct_content FROM documents GROUP BY source")
def distinct_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.sha2(F.btrim(F.regexp_replace("text", "[ \\t\\n\\f\\r]+", " "), F.lit(" ")), 256)
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_distinct(content).alias("distinct_content"))


@query("SELECT label AS model_id, CAST(vec_id % 2 AS BIGINT) AS version, CAST(len(embedding) AS BIGINT) AS dim, count(*) AS n, max(vec_id) AS last_seq FROM embeddings GROUP BY ALL")
def model_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy(F.col("label").alias("model_id"), (F.col("vec_id") % 2).alias("version"), F.size("embedding").cast("long").alias("dim")).agg(F.count("*").alias("n"), F.max("vec_id").alias("last_seq"))


@query("SELECT conv_id AS evidence_id, max(turn) FILTER (role = 'assistant') AS last_index, max(length(text)) FILTER (role = 'assistant') AS last_end FROM conversations GROUP BY conv_id")
def resume_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where work resumes: a pair of maxima, both null where nothing was done."""
    own = F.col("role") == "assistant"
    return table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("evidence_id")).agg(F.max(F.when(own, F.col("turn"))).alias("last_index"), F.max(F.when(own, F.char_length("text").cast("long"))).alias("last_end"))


HIST = "CASE " + " ".join(f"WHEN wall_ms <= {e} THEN {k}" for k, e in enumerate(rollup.EDGES)) + f" ELSE {len(rollup.EDGES)} END"


@query(f"WITH {CALLS_SQL} SELECT feature, CAST({HIST} AS BIGINT) AS bucket, count(*) AS n, CAST(sum(wall_ms) AS BIGINT) AS total FROM calls GROUP BY 1, 2")
def histogram_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.histogram(model_calls(spark, sf_dir), ["feature"], "wall_ms")


@query(f"""WITH {CALLS_SQL}, h AS (SELECT feature, CAST({HIST} AS BIGINT) AS bucket, count(*) AS n FROM calls GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY feature ORDER BY bucket) AS cum, sum(n) OVER (PARTITION BY feature) AS total FROM h)
SELECT feature, CAST([{', '.join(map(str, rollup.EDGES))}][CAST(min(bucket) AS BIGINT) + 1] AS BIGINT) AS upper, CAST(any_value(total) AS BIGINT) AS n FROM c WHERE cum >= greatest(1, ceil(total * 0.95)) GROUP BY feature""")
def histogram_quantile_upper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.quantile_upper(rollup.histogram(model_calls(spark, sf_dir), ["feature"], "wall_ms"), ["feature"], 0.95)


@query(f"WITH {CALLS_SQL} SELECT project, quantile_disc(wall_ms, 0.5) AS p50, quantile_disc(wall_ms, 0.95) AS p95, max(wall_ms) AS top FROM calls GROUP BY project")
def percentile_nearest_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = model_calls(spark, sf_dir)
    return calls.groupBy("project").agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY wall_ms)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY wall_ms)").cast("long").alias("p95"), F.max("wall_ms").alias("top"))


@query("""WITH s AS (SELECT event_type AS metric, max(value) AS most, quantile_disc(value, 0.5) AS median, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY event_type)
SELECT metric, most, median, p95, CASE WHEN metric IN ('error', 'click') THEN p95 < 100 ELSE median >= 10 END AS passed FROM s""")
def gate_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series against thresholds: at most is strict, at least is not."""
    events = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("metric"))
    s = events.agg(F.max("value").alias("most"), F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("median"), F.expr("percentile_disc(0.95) WITHIN GROUP (ORDER BY value)").alias("p95"))
    return s.withColumn("passed", F.when(F.col("metric").isin("error", "click"), F.col("p95") < 100).otherwise(F.col("median") >= 10))


@query(f"WITH {LOG_SQL} SELECT entity AS meter, count(*) AS records, count(*) - count(DISTINCT ts_ms) AS conflicts, CAST(sum(amount) AS BIGINT) AS total FROM log WHERE kind = 'purchase' GROUP BY entity")
def usage_meter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals per meter; records that repeat an id (the time) are conflicts; overflow gives null, not an error."""
    log = event_log(spark, sf_dir).where("kind = 'purchase'")
    return log.groupBy(F.col("entity").alias("meter")).agg(F.count("*").alias("records"), (F.count("*") - F.count_distinct("ts_ms")).alias("conflicts"), F.try_sum("amount").alias("total"))


@query(f"WITH {CALLS_SQL} SELECT model, CAST(sum(tokens_in) AS BIGINT) AS tokens, CAST(sum(wall_ms) AS BIGINT) AS wall_ms, bool_and(tokens_out > 0) AS measured FROM calls GROUP BY model")
def usage_accumulation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return model_calls(spark, sf_dir).groupBy("model").agg(F.sum("tokens_in").alias("tokens"), F.sum("wall_ms").alias("wall_ms"), F.bool_and(F.col("tokens_out") > 0).alias("measured"))


@query("""WITH c AS (SELECT d.lang AS suite, contains(lower(d.text), 'license') AS expected, contains(d.text, 'License') AS got FROM documents d)
SELECT suite, count(*) FILTER (expected = got) AS passed, count(*) FILTER (expected <> got) AS failed, count(*) FILTER (expected <> got) > 0 AS regressed FROM c GROUP BY suite""")
def eval_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "documents").select(F.col("lang").alias("suite"), (F.contains(F.lower("text"), F.lit("license")) == F.contains("text", F.lit("License"))).alias("same"))
    return c.groupBy("suite").agg(F.count_if("same").alias("passed"), F.count_if(~F.col("same")).alias("failed"), (F.count_if(~F.col("same")) > 0).alias("regressed"))


@query("""WITH b AS (SELECT sha256(text) AS name, CASE WHEN doc_id % 50 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS found, doc_id % 90 = 7 AS misplaced, text LIKE '%.' AS whole FROM documents)
SELECT count(*) FILTER (name = found AND NOT misplaced) AS ok, count(*) FILTER (name <> found) AS corrupt, count(*) FILTER (misplaced) AS misplaced, count(*) FILTER (NOT whole) AS temporary,
array_to_string(list_sort(list(DISTINCT name) FILTER (name <> found))[1:64], ',') AS defects, count(DISTINCT name) FILTER (name <> found) > 64 AS truncated FROM b""")
def cas_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blobs whose content no longer has the hash that names them. Defects are listed up to 64, the smallest first, by a bounded top-k."""
    d = table(spark, sf_dir, "documents")
    b = d.select(F.sha2("text", 256).alias("name"), F.when(F.col("doc_id") % 50 == 0, F.sha2(F.concat("text", F.lit("x")), 256)).otherwise(F.sha2("text", 256)).alias("found"), (F.col("doc_id") % 90 == 7).alias("misplaced"), F.endswith("text", F.lit(".")).alias("whole"))
    bad = F.col("name") != F.col("found")
    counts = b.agg(F.count_if(~bad & ~F.col("misplaced")).alias("ok"), F.count_if(bad).alias("corrupt"), F.count_if("misplaced").alias("misplaced"), F.count_if(~F.col("whole")).alias("temporary"), (F.count_distinct(F.when(bad, F.col("name"))) > 64).alias("truncated"))
    listed = b.where(bad).select("name").distinct().orderBy("name").limit(64).agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("defects"))
    return counts.join(F.broadcast(listed))


@query("""WITH r AS (SELECT conv_id, role, CASE role WHEN 'system' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END AS rank FROM conversations) SELECT conv_id, max_by(role, rank) AS top_role, max(rank) >= 1 AS allowed FROM r GROUP BY conv_id""")
def max_role(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest role of each member, and whether it reaches the one asked for."""
    rank = F.when(F.col("role") == "system", 2).when(F.col("role") == "assistant", 1).otherwise(0)
    r = table(spark, sf_dir, "conversations").select("conv_id", "role", rank.alias("rank"))
    return r.groupBy("conv_id").agg(F.max_by("role", "rank").alias("top_role"), (F.max("rank") >= 1).alias("allowed"))


@query("""WITH s AS (SELECT conv_id AS trace, turn AS span, CASE WHEN turn > 0 THEN turn - 1 - CASE WHEN turn % 6 = 5 THEN 100 ELSE 0 END END AS parent FROM conversations),
o AS (SELECT trace, count(*) AS orphans FROM s WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s p WHERE p.trace = s.trace AND p.span = s.parent) GROUP BY trace)
SELECT s.trace, count(*) FILTER (parent IS NULL) AS roots, coalesce(any_value(orphans), 0) AS orphans, count(*) FILTER (parent IS NULL) = 1 AND coalesce(any_value(orphans), 0) = 0 AS sound FROM s LEFT JOIN o ON s.trace = o.trace GROUP BY s.trace""")
def trace_tree_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace has one root and every parent is there."""
    turn = F.col("turn")
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("trace"), turn.alias("span"), F.when(turn > 0, turn - 1 - F.when(turn % 6 == 5, 100).otherwise(0)).alias("parent"))
    known = s.select(F.col("trace").alias("trace_"), F.col("span").alias("span_"))
    orphans = s.where("parent IS NOT NULL").join(known, (F.col("trace") == F.col("trace_")) & (F.col("parent") == F.col("span_")), "left_anti").groupBy("trace").agg(F.count("*").alias("orphans"))
    roots = s.groupBy("trace").agg(F.count_if(F.col("parent").isNull()).alias("roots"))
    return roots.join(orphans, "trace", "left").select("trace", "roots", F.coalesce("orphans", F.lit(0)).alias("orphans"), ((F.col("roots") == 1) & F.col("orphans").isNull()).alias("sound"))


DIMENSIONS = ("steps", "tokens", "money", "time")


@query("""WITH b AS (SELECT o_orderkey AS run_id, o_custkey % 90 AS spent, o_orderkey % 30 AS asked, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS money FROM orders)
SELECT run_id, CASE WHEN spent + asked > 100 THEN 'steps' WHEN spent * 10 + asked > 850 THEN 'tokens' WHEN money + asked * 10 > 1100 THEN 'money' END AS exceeded FROM b""")
def budget_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first dimension, in fixed order, that a request would take over its limit; an overflow refuses."""
    o = table(spark, sf_dir, "orders")
    b = o.select(F.col("o_orderkey").alias("run_id"), (F.col("o_custkey") % 90).alias("spent"), (F.col("o_orderkey") % 30).alias("asked"), (F.floor("o_totalprice") % 1000).alias("money"))
    over = lambda total, limit: F.coalesce(total > limit, F.lit(True))
    first = F.when(over(F.try_add("spent", "asked"), 100), "steps").when(over(F.try_add(F.try_multiply("spent", F.lit(10)), "asked"), 850), "tokens").when(over(F.try_add("money", F.try_multiply("asked", F.lit(10))), 1100), "money")
    return b.select("run_id", first.alias("exceeded"))


@query("""WITH e AS (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host, page_id % 3 AS policy FROM pages)
SELECT page_id, host, CASE WHEN host IN ('localhost', '127.0.0.1', '[::1]') THEN 'allow' WHEN policy = 0 THEN 'deny' WHEN policy = 1 THEN 'allow' WHEN suffix(host, '.org') THEN 'allow' ELSE 'deny' END AS decision FROM e""")
def policy_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a call may go: loopback always, nowhere else under a local policy, listed endpoints under a custom one."""
    e = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", r"^[a-z]+://([^/?#]*)", 1).alias("host"), (F.col("page_id") % 3).alias("policy"))
    decision = F.when(F.col("host").isin("localhost", "127.0.0.1", "[::1]"), "allow").when(F.col("policy") == 0, "deny").when(F.col("policy") == 1, "allow").when(F.endswith("host", F.lit(".org")), "allow").otherwise("deny")
    return e.select("page_id", "host", decision.alias("decision"))


@query("""WITH s AS (SELECT doc_id, CASE WHEN d.n_chars > 20000 THEN 'refused' WHEN EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) THEN 'duplicate' ELSE 'added' END AS outcome FROM documents d)
SELECT outcome, count(*) AS n, min(doc_id) AS first_doc FROM s GROUP BY outcome""")
def submit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What became of each submitted file; a bad one is a row, not a failure."""
    d, l = table(spark, sf_dir, "documents").select("doc_id", "n_chars"), table(spark, sf_dir, "labels").select(F.col("doc_id").alias("known")).distinct()
    s = d.join(l, F.col("doc_id") == F.col("known"), "left")
    outcome = F.when(F.col("n_chars") > 20000, "refused").when(F.col("known").isNotNull(), "duplicate").otherwise("added")
    return s.groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"))
