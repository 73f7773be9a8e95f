"""Streaming queries; each gives the resulting table as a batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomlake.plans import fold, ranges
from loomlake.queries.logs import USERS
from loomlake.registry import query
from loomlake.session import scratch
from loomlake.sources import folders
from loomlake.sources.tables import LOG_SQL, epoch_us, event_log, micros, table
from loomlake.streaming import stream as ops


@query(f"""WITH {LOG_SQL} SELECT entity, max_by(amount, seq) FILTER (kind = 'view') AS last_view, max(seq) FILTER (kind IN ('view', 'click')) AS last_touch,
min_by(amount, seq) FILTER (kind = 'purchase') AS first_purchase, CAST(sum(amount) FILTER (kind = 'purchase') AS BIGINT) AS spent, CAST(sum(1) FILTER (kind = 'error') AS BIGINT) AS errors
FROM log WHERE kind IN ('view', 'click', 'purchase', 'error') GROUP BY entity""")
def stream_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The user table, folded incrementally by a structured stream over the event files."""

    def prepare(events: DataFrame) -> DataFrame:
        return events.select((F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("kind"), F.col("user_id").alias("entity"), micros(F.col("value")).alias("amount"))

    schema = table(spark, sf_dir, "events").schema
    # A file source reads a folder; the glob keeps to the one table.
    return ops.folded_stream(spark, f"{sf_dir}/events.parque[t]", schema, prepare, USERS)


#: A table whose rows are born, deleted and overwritten: users from signup to error; a signup sets what they spent to its amount.
MEMBERS = fold.Table(
    key=("entity",),
    columns={
        "clicked": fold.Last({"click": "amount"}),
        "first_view": fold.First({"view": "seq"}),
        "clicks": fold.Total({"click": "CAST(1 AS BIGINT)"}, nulls_as_zero=True),
        "spent": fold.Reset({"purchase": "amount"}, {"signup": "amount"}),
    },
    creates=("signup",),
    deletes=("error",),
)


@query(f"""WITH {LOG_SQL}, d AS (SELECT entity, max(seq) AS gone FROM log WHERE kind = 'error' GROUP BY entity), l AS (SELECT log.* FROM log LEFT JOIN d ON log.entity = d.entity WHERE gone IS NULL OR seq > gone),
b AS (SELECT entity, min(seq) AS born, max(seq) AS set_at, max_by(amount, seq) AS base FROM l WHERE kind = 'signup' GROUP BY entity)
SELECT l.entity, max_by(amount, seq) FILTER (kind = 'click') AS clicked, min(seq) FILTER (kind = 'view') AS first_view, count(*) FILTER (kind = 'click') AS clicks,
CAST(any_value(base) + coalesce(sum(amount) FILTER (kind = 'purchase' AND seq > set_at), 0) AS BIGINT) AS spent FROM l JOIN b ON l.entity = b.entity WHERE seq >= born GROUP BY l.entity""")
def stream_fold_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are born, deleted and overwritten, folded by a stream over files of the log that come out of order."""
    path = scratch(spark, "shuffled")
    log = event_log(spark, sf_dir).select("seq", "kind", "entity", "amount")
    log.repartition(12, F.xxhash64("seq")).write.parquet(path)
    folded = ops.folded_stream(spark, path, log.schema, lambda batch: batch, MEMBERS, files_per_trigger=4)
    folders.remove(spark, path)
    return folded


@query(f"WITH {LOG_SQL}, r AS (SELECT entity, seq, row_number() OVER (PARTITION BY entity ORDER BY seq DESC) AS r FROM log) SELECT entity, min(seq) AS first_seq, max(seq) AS head, count(*) AS frames FROM r WHERE r <= 20 GROUP BY entity")
def resume_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = ops.resume_window(event_log(spark, sf_dir), "entity", "seq", 20)
    return kept.groupBy("entity").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("head"), F.count("*").alias("frames"))


@query(f"""WITH {LOG_SQL}, n AS (SELECT entity, row_number() OVER (PARTITION BY entity ORDER BY seq) AS frame FROM log), b AS (SELECT entity, max(frame) AS head, greatest(max(frame) - 19, 1) AS first FROM n GROUP BY entity),
c AS (SELECT DISTINCT entity, entity % 100 AS cursor FROM log)
SELECT c.entity, cursor, CASE WHEN cursor > head THEN 'invalid_input' WHEN cursor < first - 1 THEN 'resume_window_exceeded' ELSE 'resumed' END AS status, CASE WHEN cursor <= head AND cursor >= first - 1 THEN head - cursor END AS behind FROM c JOIN b ON c.entity = b.entity""")
def resume_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir)
    frames = ranges.running(log.select("entity", "seq"), ("entity",), "seq", {"before": F.lit(1)}).select("entity", (F.col("before") + 1).alias("frame"))
    cursors = log.select("entity").distinct().withColumn("cursor", F.col("entity") % 100)
    return ops.resume_status(ops.resume_window(frames, "entity", "frame", 20), "entity", "frame", cursors)


@query(f"""WITH {LOG_SQL}, m AS (SELECT entity, seq, max(seq) OVER (PARTITION BY entity) AS last, bool_or(kind = 'purchase' AND seq % 50 = 0) OVER (PARTITION BY entity) AS ended FROM log)
SELECT entity, count(*) AS frames, max(seq) AS last_sent FROM m WHERE seq < last OR ended GROUP BY entity""")
def settled_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest boundary is held back until the next one or the end of the run."""
    sent = ops.settled(event_log(spark, sf_dir), "entity", "seq", (F.col("kind") == "purchase") & (F.col("seq") % 50 == 0))
    return sent.groupBy("entity").agg(F.count("*").alias("frames"), F.max("seq").alias("last_sent"))


@query(f"""WITH {LOG_SQL}, c AS (SELECT DISTINCT device, device * 1000 AS cursor FROM log), r AS (SELECT log.device, seq, row_number() OVER (PARTITION BY log.device ORDER BY seq) AS r FROM log JOIN c ON log.device = c.device WHERE seq > cursor)
SELECT device, seq FROM r WHERE r <= 100""")
def sync_pull(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = event_log(spark, sf_dir).select("device", "seq")
    cursors = log.select("device").distinct().withColumn("cursor", F.col("device") * 1000)
    return ops.pull(log, "device", "seq", cursors, 100)


@query(f"WITH {LOG_SQL} SELECT device, max(seq) AS high_water, max(ts_ms) AS latest_ts_ms FROM log GROUP BY device")
def high_water_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_log(spark, sf_dir).groupBy("device").agg(F.max("seq").alias("high_water"), F.max("ts_ms").alias("latest_ts_ms"))


@query(f"""WITH {LOG_SQL} SELECT seq AS stream_seq, 'id: ' || seq || chr(10) || 'event: ' || kind || chr(10) || 'data: ' || body || chr(10) || chr(10) AS event FROM log""")
def sse_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = event_log(spark, sf_dir).select(F.col("seq").alias("stream_seq"), F.col("kind").alias("event_kind"), F.col("body").alias("data_json"))
    return ops.sse(frames)


@query(f"WITH {LOG_SQL} SELECT CAST(seq AS VARCHAR) AS id, kind AS event, body AS data FROM log")
def sse_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a hundred events each, decoded."""
    frames = event_log(spark, sf_dir).select(F.col("seq").alias("stream_seq"), F.col("kind").alias("event_kind"), F.col("body").alias("data_json"))
    texts = ops.sse(frames).groupBy(F.floor((F.col("stream_seq") - 1) / 100)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("stream_seq", "event"))), lambda e: e["event"]), "").alias("text"))
    return ops.sse_events(texts, "text").select("id", "event", "data")


@query("""SELECT CAST(epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) // 1000 AS BIGINT) AS window_ms, event_type AS kind, count(*) AS n FROM events GROUP BY ALL""")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extra beside the log's own order: tumbling windows by event time."""
    e = table(spark, sf_dir, "events")
    hour = F.floor(epoch_us(F.col("ts")) / 3600000000).cast("long") * 3600000
    return e.groupBy(hour.alias("window_ms"), F.col("event_type").alias("kind")).agg(F.count("*").alias("n"))


@query(f"""WITH {LOG_SQL}, e AS (SELECT min(seq) AS stop FROM log WHERE kind = 'purchase' AND entity % 7 = 3) SELECT kind, count(*) AS frames, max(seq) AS last_seq FROM log, e WHERE stop IS NULL OR seq <= stop GROUP BY kind""")
def follow_until_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a followed stream, up to the one that ends it."""

    def prepare(events: DataFrame) -> DataFrame:
        return events.select((F.col("event_id") + 1).alias("seq"), F.col("event_type").alias("kind"), F.col("user_id").alias("entity"))

    schema = table(spark, sf_dir, "events").schema
    frames = ops.follow(spark, f"{sf_dir}/events.parque[t]", schema, prepare, "kind = 'purchase' AND entity % 7 = 3")
    return frames.groupBy("kind").agg(F.count("*").alias("frames"), F.max("seq").alias("last_seq"))
