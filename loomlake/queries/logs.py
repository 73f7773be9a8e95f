"""Queries on the log and its folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.operators import log as ops
from loomlake.plans import fold, ranges
from loomlake.registry import query
from loomlake.session import scratch
from loomlake.sources.tables import LOG_SQL, event_log, table

#: The user table that the fold queries derive from the log.
USERS = fold.Table(
    key=("entity",),
    columns={
        "last_view": fold.Last({"view": "amount"}),
        "last_touch": fold.Last({"view": "seq", "click": "seq"}),
        "first_purchase": fold.First({"purchase": "amount"}),
        "spent": fold.Total({"purchase": "amount"}),
        "errors": fold.Total({"error": "CAST(1 AS BIGINT)"}),
    },
)


@query(f"WITH {LOG_SQL} SELECT seq, device, ts_ms, kind FROM log WHERE seq > 100 ORDER BY seq LIMIT 500")
def log_range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.range_scan(event_log(spark, sf_dir), 100, 500).select("seq", "device", "ts_ms", "kind")


@query(f"WITH {LOG_SQL} SELECT seq, device, row_number() OVER (PARTITION BY device ORDER BY seq) AS lamport FROM log")
def log_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.lamport(event_log(spark, sf_dir)).select("seq", "device", "lamport")


@query(f"WITH {LOG_SQL}, x AS (SELECT * FROM log WHERE seq % 97 <> 0) SELECT seq FROM x WHERE seq > 1 AND NOT EXISTS (SELECT 1 FROM x y WHERE y.seq = x.seq - 1)")
def log_contiguity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.gaps(event_log(spark, sf_dir).where("seq % 97 <> 0"))


@query(f"WITH {LOG_SQL} SELECT coalesce(max(seq), 0) AS head, count(*) AS events FROM log")
def log_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.head(event_log(spark, sf_dir))


@query(f"WITH {LOG_SQL} SELECT seq, kind, TRY_CAST(json_extract_string(body, '$.k') AS BIGINT) AS k, json_extract_string(body, '$.k') IS NULL AS malformed FROM log")
def event_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    body = F.from_json("body", "k long")
    return log.select("seq", "kind", body["k"].alias("k"), body["k"].isNull().alias("malformed"))


@query(f"""WITH {LOG_SQL}, r AS (SELECT seq, CASE WHEN seq % 50 = 0 THEN kind || '-' ELSE kind END AS kind, CASE WHEN seq % 70 = 0 THEN 65 ELSE 1 END AS refs FROM log)
SELECT CASE WHEN NOT regexp_matches(kind, '^[A-Za-z0-9]{{1,64}}$') THEN 'kind' WHEN refs > 64 THEN 'refs' ELSE 'ok' END AS problem, count(*) AS n FROM r GROUP BY 1""")
def request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    requests = log.select(F.when(F.col("seq") % 50 == 0, F.concat("kind", F.lit("-"))).otherwise(F.col("kind")).alias("kind"), "body", F.array_repeat(F.lit("r"), F.when(F.col("seq") % 70 == 0, 65).otherwise(1)).alias("refs"))
    return ops.validated(requests).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query(f"""WITH {LOG_SQL} SELECT entity, max_by(amount, seq) FILTER (kind = 'view') AS last_view, max(seq) FILTER (kind IN ('view', 'click')) AS last_touch,
min_by(amount, seq) FILTER (kind = 'purchase') AS first_purchase, CAST(sum(amount) FILTER (kind = 'purchase') AS BIGINT) AS spent, CAST(sum(1) FILTER (kind = 'error') AS BIGINT) AS errors
FROM log WHERE kind IN ('view', 'click', 'purchase', 'error') GROUP BY entity""")
def fold_upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fold.fold(event_log(spark, sf_dir), USERS)


@query(f"""WITH {LOG_SQL}, b AS (SELECT entity, min(seq) AS born FROM log WHERE kind = 'signup' GROUP BY entity)
SELECT log.entity, max_by(amount, seq) FILTER (kind = 'click') AS clicked, CAST(count(*) FILTER (kind = 'click') AS BIGINT) AS clicks
FROM log JOIN b ON log.entity = b.entity WHERE seq >= born AND kind IN ('signup', 'click') GROUP BY log.entity""")
def fold_update_lenient(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fold.Table(("entity",), {"clicked": fold.Last({"click": "amount"}), "clicks": fold.Total({"click": "CAST(1 AS BIGINT)"}, nulls_as_zero=True)}, creates=("signup",))
    return fold.fold(event_log(spark, sf_dir), t)


@query(f"WITH {LOG_SQL} SELECT entity, min(seq) AS seq, min_by(amount, seq) AS amount, count(*) > 1 AS repeated FROM log WHERE kind = 'purchase' GROUP BY entity")
def fold_first_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).where("kind = 'purchase'")
    return log.groupBy("entity").agg(F.min("seq").alias("seq"), F.min_by("amount", "seq").alias("amount"), (F.count("*") > 1).alias("repeated"))


@query(f"""WITH {LOG_SQL} SELECT entity, kind, device, CAST(sum(CASE WHEN device <> 1 THEN amount END) AS BIGINT) AS counter, CAST(coalesce(sum(CASE WHEN device <> 1 THEN amount END), 0) AS BIGINT) AS as_read
FROM log GROUP BY entity, kind, device""")
def fold_increment_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters are null until first touched; the read form has zero."""
    counter = F.sum(F.when(F.col("device") != 1, F.col("amount")))
    return event_log(spark, sf_dir).groupBy("entity", "kind", "device").agg(counter.alias("counter"), F.coalesce(counter, F.lit(0)).alias("as_read"))


@query(f"""WITH {LOG_SQL}, l AS (SELECT * FROM log WHERE kind IN ('view', 'click', 'error')), d AS (SELECT entity, max(seq) AS gone FROM l WHERE kind = 'error' GROUP BY entity)
SELECT l.entity, max_by(amount, seq) FILTER (kind = 'view') AS viewed, CAST(sum(1) FILTER (kind = 'click') AS BIGINT) AS clicks FROM l LEFT JOIN d ON l.entity = d.entity
WHERE gone IS NULL OR seq > gone GROUP BY l.entity""")
def fold_delete_tombstone(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fold.Table(("entity",), {"viewed": fold.Last({"view": "amount"}), "clicks": fold.Total({"click": "CAST(1 AS BIGINT)"})}, deletes=("error",))
    return fold.fold(event_log(spark, sf_dir), t)


@query(f"""WITH {LOG_SQL}, a AS (SELECT entity, max(seq) AS set_at, max_by(amount, seq) AS base FROM log WHERE kind = 'signup' GROUP BY entity)
SELECT log.entity, CAST(coalesce(any_value(base), 0) + coalesce(sum(CASE WHEN kind = 'purchase' AND seq > coalesce(set_at, 0) THEN amount END), 0) AS BIGINT) AS spent
FROM log LEFT JOIN a ON log.entity = a.entity WHERE kind IN ('signup', 'purchase') GROUP BY log.entity""")
def fold_sum_with_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An absolute assignment replaces the counter; later deltas add to it."""
    log = event_log(spark, sf_dir).where("kind IN ('signup', 'purchase')")
    base = log.where("kind = 'signup'").groupBy(F.col("entity").alias("of")).agg(F.max("seq").alias("at"), F.max_by("amount", "seq").alias("base"))
    joined = log.join(base, F.col("entity") == F.col("of"), "left")
    later = F.when((F.col("kind") == "purchase") & (F.col("seq") > F.coalesce("at", F.lit(0))), F.col("amount"))
    return joined.groupBy("entity").agg((F.coalesce(F.first("base"), F.lit(0)) + F.coalesce(F.sum(later), F.lit(0))).alias("spent"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT entity, seq, kind, CASE kind WHEN 'signup' THEN 'running' WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'finished' END AS status FROM log WHERE kind IN ('signup', 'error', 'purchase', 'view')),
b AS (SELECT entity, min(seq) AS born FROM s WHERE kind = 'signup' GROUP BY entity)
SELECT s.entity, max_by(status, seq) FILTER (status IS NOT NULL) AS status, max(seq) AS last_seq, count(*) FILTER (kind = 'view') AS steps, min(seq) FILTER (kind IN ('error', 'purchase')) AS first_end_seq
FROM s JOIN b ON s.entity = b.entity WHERE seq >= born GROUP BY s.entity""")
def fold_state_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run: created by signup, stepped by view, ended by error or purchase, restarted by another signup."""
    status = {"signup": "'running'", "error": "'failed'", "purchase": "'finished'"}
    t = fold.Table(
        ("entity",),
        {
            "status": fold.Last(status),
            "last_seq": fold.Last({k: "seq" for k in ("signup", "error", "purchase", "view")}),
            "steps": fold.Total({"view": "CAST(1 AS BIGINT)"}, nulls_as_zero=True),
            "first_end_seq": fold.First({"error": "seq", "purchase": "seq"}),
        },
        creates=("signup",),
    )
    return fold.fold(event_log(spark, sf_dir), t)


@query(f"""WITH {LOG_SQL}, l AS (SELECT *, CASE kind WHEN 'signup' THEN 1 WHEN 'error' THEN 0 END AS mark FROM log WHERE kind IN ('signup', 'error', 'click')),
a AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY entity ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS alive FROM l)
SELECT entity, seq, kind, CASE WHEN kind = 'signup' THEN 'duplicate' ELSE 'missing' END AS problem FROM a WHERE (kind = 'signup' AND alive = 1) OR (kind <> 'signup' AND alive = 0)""")
def fold_strict_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fold.Table(("entity",), {"clicks": fold.Total({"click": "CAST(1 AS BIGINT)"})}, creates=("signup",), deletes=("error",))
    return fold.strict_violations(event_log(spark, sf_dir), t)


@query(f"""WITH {LOG_SQL} SELECT entity, max_by(amount, seq) FILTER (kind = 'view') AS last_view, max(seq) FILTER (kind IN ('view', 'click')) AS last_touch,
min_by(amount, seq) FILTER (kind = 'purchase') AS first_purchase, CAST(sum(amount) FILTER (kind = 'purchase') AS BIGINT) AS spent, CAST(sum(1) FILTER (kind = 'error') AS BIGINT) AS errors
FROM log WHERE kind IN ('view', 'click', 'purchase', 'error') GROUP BY entity""")
def snapshot_plus_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots at each quarter of the log, all but the newest two pruned, and the state restored from them with the tail folded onto it."""
    log, folder = event_log(spark, sf_dir), scratch(spark, "snapshots")
    top = ops.head(log).first()["head"]
    digest = ops.schema_digest({"t": USERS})
    for quarter in (1, 2, 3):
        cut = top * quarter // 4
        ops.write_snapshot(ops.restored(spark, log, folder, USERS, cut), folder, digest, cut, keep=2)
    return fold.finish(ops.restored(spark, log, folder, USERS, top), USERS)


@query(f"""WITH {LOG_SQL}, r AS (SELECT *, row_number() OVER (ORDER BY CAST(seq % 3 <> 0 AS INTEGER), md5(CAST(seq AS VARCHAR)), seq) AS n FROM log)
SELECT n AS seq, device, kind, seq AS was, row_number() OVER (PARTITION BY device ORDER BY n) AS lamport FROM r""")
def append_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches appended to a new log, every row with the next seq and its device's next counter; the second expects the first's head."""
    path = scratch(spark, "log")
    requests = event_log(spark, sf_dir).select("device", "kind", F.array().cast("array<string>").alias("refs"), "body", F.col("seq").alias("was"))
    requests = requests.withColumn("at", F.struct(F.md5(F.col("was").cast("string")), "was"))
    top = ops.append(spark, path, requests.where("was % 3 = 0"), "at", expected_head=0)
    ops.append(spark, path, requests.where("was % 3 <> 0"), "at", expected_head=top)
    return spark.read.parquet(path).select("seq", "device", "kind", "was", "lamport")


@query(f"""WITH {LOG_SQL}, t AS (SELECT entity, CAST(sum(amount) AS BIGINT) AS spent FROM log WHERE kind = 'purchase' GROUP BY entity)
SELECT entity, CASE WHEN entity % 10 = 0 THEN 'changed' ELSE 'missing' END AS problem FROM t WHERE entity % 10 = 0 OR entity % 11 = 0""")
def verify_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored table with rows changed and lost, against its re-derivation."""
    derived = event_log(spark, sf_dir).where("kind = 'purchase'").groupBy("entity").agg(F.sum("amount").alias("spent"))
    stored = derived.where("entity % 10 = 0 OR entity % 11 <> 0").withColumn("spent", F.when(F.col("entity") % 10 == 0, F.col("spent") + 1).otherwise(F.col("spent")))
    return ops.mismatches(stored, derived, ["entity"])


@query(f"""WITH {LOG_SQL}, a AS (SELECT entity, kind, count(*) AS n FROM log GROUP BY ALL), b AS (SELECT entity, kind, count(*) AS n FROM log WHERE seq % 1000 <> 0 GROUP BY ALL)
SELECT * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)""")
def except_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    counted = lambda df: df.groupBy("entity", "kind").agg(F.count("*").alias("n"))
    return counted(log).exceptAll(counted(log.where("seq % 1000 <> 0")))


@query(f"""WITH {LOG_SQL} SELECT coalesce(max(seq), 0) AS head, count(*) AS events, count(DISTINCT device) AS devices, max(seq // 1000) AS snapshots, max(seq // 1000) * 1000 AS latest_snapshot,
max_by(kind, seq) AS last_kind FROM log""")
def inspect_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    thousands = F.max(F.floor(F.col("seq") / 1000))
    return event_log(spark, sf_dir).agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"), F.count("*").alias("events"), F.count_distinct("device").alias("devices"), thousands.alias("snapshots"), (thousands * 1000).alias("latest_snapshot"), F.max_by("kind", "seq").alias("last_kind"))


@query(f"""WITH {LOG_SQL} SELECT seq, '{{"seq":' || seq || ',"device":' || device || ',"tsMs":' || ts_ms || ',"kind":"' || kind || '","bodyHex":"' || lower(hex(encode(body))) || '"}}' AS line FROM log""")
def export_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.export_lines(event_log(spark, sf_dir))


@query(f"""WITH {LOG_SQL}, s AS (SELECT DISTINCT seq // 1000 AS snap FROM log), r AS (SELECT snap, row_number() OVER (ORDER BY snap DESC) AS r FROM s) SELECT snap FROM r WHERE r > 2""")
def prune_not_in_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshots that pruning removes: all but the newest two."""
    snaps = event_log(spark, sf_dir).select(F.floor(F.col("seq") / 1000).alias("snap")).distinct()
    return snaps.join(snaps.orderBy(F.desc("snap")).limit(2), "snap", "left_anti")


@query(f"""WITH {LOG_SQL} SELECT kind, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n FROM log WHERE kind IN ('error', 'purchase') GROUP BY kind""")
def kind_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the kinds that a projection wants are read; the filter reaches the scan."""
    return event_log(spark, sf_dir).where(F.col("kind").isin("error", "purchase")).groupBy("kind").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


@query(f"""WITH {LOG_SQL}, g AS (SELECT seq, entity, unnest(range(0, CAST(seq % 4 AS BIGINT))) AS tool FROM log WHERE kind = 'signup')
SELECT entity AS run_id, 'tool-' || tool AS tool_id, max(seq) AS started_seq, count(*) AS grants FROM g GROUP BY ALL""")
def tool_grants_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event grants several tools: a row for each."""
    starts = event_log(spark, sf_dir).where("kind = 'signup' AND seq % 4 > 0")
    rows = starts.select("seq", "entity", F.explode(F.sequence(F.lit(0).cast("long"), F.col("seq") % 4 - 1)).alias("tool"))
    return rows.groupBy(F.col("entity").alias("run_id"), F.concat(F.lit("tool-"), "tool").alias("tool_id")).agg(F.max("seq").alias("started_seq"), F.count("*").alias("grants"))


@query(f"""WITH {LOG_SQL}, s AS (SELECT entity, seq, kind, row_number() OVER (PARTITION BY entity ORDER BY seq) AS step, lag(kind) OVER (PARTITION BY entity ORDER BY seq) AS before FROM log WHERE kind IN ('view', 'error', 'purchase'))
SELECT entity, seq, CASE WHEN kind = 'view' AND before = 'error' THEN 'resumed, not planned' WHEN kind = 'purchase' AND before = 'purchase' THEN 'finished twice' END AS problem
FROM s WHERE (kind = 'view' AND before = 'error') OR (kind = 'purchase' AND before = 'purchase')""")
def run_guard_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules on a run's order of events, each as a query for its violations."""
    s = event_log(spark, sf_dir).where("kind IN ('view', 'error', 'purchase')").select("entity", "seq", "kind")
    s = ranges.running(s, ("entity",), "seq", lasts={"before": F.col("kind")})
    problem = F.when((F.col("kind") == "view") & (F.col("before") == "error"), "resumed, not planned").when((F.col("kind") == "purchase") & (F.col("before") == "purchase"), "finished twice")
    return s.select("entity", "seq", problem.alias("problem")).where("problem IS NOT NULL")


_TAGGED = " || ';' || ".join(f"coalesce(CAST(length(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), 'null')" for c in ("amount", "device", "entity", "kind", "seq"))


@query(f"""WITH {LOG_SQL}, d AS (SELECT CAST('0x' || substr(md5({_TAGGED}), 1, 15) AS BIGINT) AS h FROM log) SELECT count(*) AS n, bit_xor(h) AS mixed, CAST(sum(h & 1048575) AS BIGINT) AS added FROM d""")
def table_digest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order-free digest of the log."""
    return ops.table_digest(event_log(spark, sf_dir).select("seq", "device", "kind", "entity", "amount"))


@query(f"""WITH {LOG_SQL}, t AS (SELECT entity, CAST(sum(amount) AS BIGINT) AS spent FROM log WHERE kind = 'purchase' GROUP BY entity), s AS (SELECT entity, spent + CASE WHEN entity % 10 = 0 THEN 1 ELSE 0 END AS spent FROM t WHERE entity % 11 <> 0 OR entity % 10 = 0),
b AS (SELECT sha256(text) AS name, CASE WHEN doc_id % 50 = 0 THEN sha256(text || 'x') ELSE sha256(text) END AS found FROM documents)
SELECT 'digest of a faithful table' AS item, (SELECT count(*) FROM t) AS seen, CAST(0 AS BIGINT) AS wrong UNION ALL SELECT 'digest of a changed table', (SELECT count(*) FROM s), 1
UNION ALL SELECT 'rows changed', (SELECT count(*) FROM t), (SELECT count(*) FROM t WHERE entity % 10 = 0) UNION ALL SELECT 'rows missing', (SELECT count(*) FROM t), (SELECT count(*) FROM t WHERE entity % 10 <> 0 AND entity % 11 = 0)
UNION ALL SELECT 'rows surplus', (SELECT count(*) FROM t), 0 UNION ALL SELECT 'blobs', (SELECT count(*) FROM b), (SELECT count(*) FROM b WHERE name <> found)""")
def project_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What verifying a project composes: digests of stored tables against their re-derivation, the rows that differ, and a sweep of the blobs."""
    derived = event_log(spark, sf_dir).where("kind = 'purchase'").groupBy("entity").agg(F.sum("amount").alias("spent"))
    changed = derived.where("entity % 10 = 0 OR entity % 11 <> 0").withColumn("spent", F.when(F.col("entity") % 10 == 0, F.col("spent") + 1).otherwise(F.col("spent")))
    d = table(spark, sf_dir, "documents")
    blobs = d.select(F.sha2("text", 256).alias("name"), F.when(F.col("doc_id") % 50 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text")).alias("content"))
    return ops.verify_report({"faithful": (derived.repartition(3), derived), "changed": (changed, derived)}, ("changed", ["entity"]), blobs)
