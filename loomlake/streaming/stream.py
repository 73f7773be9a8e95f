"""Streams: an incremental fold, resume windows, settled frames, and pulls by sequence.

Order is by sequence number throughout; the high-water mark of a log is its largest sequence, never an event time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.plans import fold
from loomlake.session import checkpointed, scratch
from loomlake.sources import folders

RESUME_FRAMES = 256


class ResumeWindowExceeded(Exception):
    """The cursor lies before the frames that are kept."""


def versions(spark: SparkSession, folder: str, before: int | None = None) -> dict[int, list[int]]:
    """Of each bucket of a state, the batches that wrote it, newest first; batches whose write was cut off do not count."""
    out: dict[int, list[int]] = {}
    for name in folders.names(spark, folder):
        n = int(name.split("=")[1])
        if (before is None or n < before) and folders.exists(spark, f"{folder}/{name}/_SUCCESS"):
            for bucket in folders.names(spark, f"{folder}/{name}"):
                if bucket.startswith("bucket="):
                    out.setdefault(int(bucket.split("=")[1]), []).append(n)
    return {b: sorted(ns, reverse=True) for b, ns in out.items()}


def folded_stream(spark: SparkSession, source: str, schema, prepare, table: fold.Table, folder: str | None = None, files_per_trigger: int = 64, buckets: int = 64) -> DataFrame:
    """Fold a stream of log files into a state table, batch by batch, and give the table as it stands at the end.

    The state is dealt into buckets by a hash of the key. A batch is folded on its own, and only the buckets that its
    keys lie in are read, merged and written again, as that batch's version; of older versions the newest stays, so
    that a batch that is run again after a failure starts from what it started from before and overwrites nothing
    but its own result. A table whose states can't be merged in any order goes to ordered_stream().
    """
    if not table.order_free():
        return ordered_stream(spark, source, schema, prepare, table, folder, files_per_trigger, buckets)
    own, folder = folder is None, folder or scratch(spark, "stream")
    state = f"{folder}/state"
    bucket = F.pmod(F.xxhash64(*table.key), F.lit(buckets)).cast("int")

    def absorb(batch: DataFrame, batch_id: int) -> None:
        tail = checkpointed(fold.state(prepare(batch), table))
        touched = [r[0] for r in tail.select(bucket).distinct().collect()]  # at most as many numbers as there are buckets
        old = versions(spark, state, batch_id)
        paths = [f"{state}/batch={old[b][0]}/bucket={b}" for b in touched if b in old]
        merged = fold.merge(spark.read.parquet(*paths), tail, table) if paths else tail
        if touched:
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{state}/batch={batch_id}")
        for b in touched:
            for n in old.get(b, [])[1:]:
                folders.remove(spark, f"{state}/batch={n}/bucket={b}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(absorb).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    paths = [f"{state}/batch={ns[0]}/bucket={b}" for b, ns in sorted(versions(spark, state).items())]
    read = fold.finish(spark.read.parquet(*paths) if paths else fold.state(prepare(spark.createDataFrame([], schema)), table), table)
    return _taken(spark, read, folder) if own else read


def _taken(spark: SparkSession, read: DataFrame, folder: str) -> DataFrame:
    """A result that no longer needs the folder that it was read from, which goes."""
    read = checkpointed(read)
    folders.remove(spark, folder)
    return read


#: What a batch of an ordered stream has done: how far the log is folded without a gap, and where each bucket's newest version is.
MARK = "low long, versions map<int,long>"


def _mark(spark: SparkSession, folder: str, before: int | None = None) -> tuple[int | None, int, dict[int, int]]:
    """The newest complete mark: its batch, low-water mark and versions; none, zero and none before the first."""
    done = [int(n.split("=")[1]) for n in folders.names(spark, f"{folder}/marks") if folders.exists(spark, f"{folder}/marks/{n}/_SUCCESS")]
    done = [n for n in done if before is None or n < before]
    if not done:
        return None, 0, {}
    row = spark.read.schema(MARK).parquet(f"{folder}/marks/batch={max(done)}").first()
    return max(done), row.low, row.versions


def contiguous_to(events: DataFrame, low: int, order: str = "seq") -> int:
    """How far a log goes without a gap, from low on: an anti join on the next number, and one minimum."""
    after = events.select(F.col(order).alias("s")).where(F.col("s") > low)
    following = after.select((F.col("s") - 1).alias("before")).unionByName(events.sparkSession.range(0).select(F.col("id").alias("before")))
    ends = after.join(following, F.col("s") == F.col("before"), "left_anti").agg(F.min("s").alias("end"))
    begun = after.where(F.col("s") == low + 1).limit(1).agg(F.count("*").alias("n"))
    row = ends.crossJoin(begun).first()  # one row each
    return row.end if row.n else low


def ordered_stream(spark: SparkSession, source: str, schema, prepare, table: fold.Table, folder: str | None = None, files_per_trigger: int = 64, buckets: int = 64) -> DataFrame:
    """folded_stream for tables with deletes, lenient creates or overwritten counters, whose events count in order.

    Files may come in any order: an event waits until the log is there without a gap from its beginning (numbers start at 1),
    so the state is always that of a prefix, and what waits is kept beside it. A batch folds the events that have become due
    onto the buckets of their keys, whose rows may go or be born. Its mark (how far the log is folded, and which batch wrote each
    bucket last) is written at the end and makes it count: a batch that is cut off before is run again from the mark before, as if
    nothing had been. Events that come twice are taken once. What still waits at the end (a log with gaps) is folded in its order.
    """
    own, folder = folder is None, folder or scratch(spark, "stream")
    bucket = F.pmod(F.xxhash64(*table.key), F.lit(buckets)).cast("int")
    empty = lambda: prepare(spark.createDataFrame([], schema))
    blank = fold.state(empty(), table)

    def states(newest: dict[int, int], wanted: list[int]) -> DataFrame:
        # A bucket whose rows are all gone leaves no folder.
        paths = [f"{folder}/state/batch={newest[b]}/bucket={b}" for b in wanted if b in newest]
        paths = [p for p in paths if folders.exists(spark, p)]
        return spark.read.schema(blank.schema).parquet(*paths) if paths else blank

    def waiting(batch: int | None) -> DataFrame:
        return empty() if batch is None else spark.read.schema(empty().schema).parquet(f"{folder}/waiting/batch={batch}")

    def absorb(batch: DataFrame, batch_id: int) -> None:
        last, low, newest = _mark(spark, folder, batch_id)
        events = prepare(batch).where(F.col(table.order) > low)
        events = checkpointed(waiting(last).unionByName(events).dropDuplicates([table.order]))
        high = contiguous_to(events, low, table.order)
        due = events.where((F.col(table.order) <= high) & F.col("kind").isin(*table.wanted()))
        touched = [r[0] for r in due.select(bucket).distinct().collect()]  # at most as many numbers as there are buckets
        if touched:
            merged = fold.absorb(states(newest, touched), due, table)
            merged.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(f"{folder}/state/batch={batch_id}")
        events.where(F.col(table.order) > high).write.mode("overwrite").parquet(f"{folder}/waiting/batch={batch_id}")
        now = {**newest, **dict.fromkeys(touched, batch_id)}
        spark.createDataFrame([(high, now)], MARK).coalesce(1).write.mode("overwrite").parquet(f"{folder}/marks/batch={batch_id}")
        # The batch before last can no longer be asked for.
        if last is not None and (older := _mark(spark, folder, last))[0] is not None:
            for b, n in older[2].items():
                if newest[b] != n:
                    folders.remove(spark, f"{folder}/state/batch={n}/bucket={b}")
            folders.remove(spark, f"{folder}/waiting/batch={older[0]}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(source)
    stream.writeStream.foreachBatch(absorb).option("checkpointLocation", f"{folder}/offsets").trigger(availableNow=True).start().awaitTermination()
    last, _, newest = _mark(spark, folder)
    read = fold.finish(fold.absorb(states(newest, sorted(newest)), waiting(last), table), table)
    return _taken(spark, read, folder) if own else read


class NeverEnded(Exception):
    """A followed stream that has not ended within the time given."""


def follow(spark: SparkSession, source: str, schema, prepare, terminal: str, every: str = "25 milliseconds", patience_s: float = 600.0) -> DataFrame:
    """Frames of a stream of files, polled until one that is terminal (a SQL condition) has come; those up to the first terminal one, by seq.

    A stream in which none comes within patience_s raises NeverEnded, and one that failed what it failed with.
    """
    import time

    folder, ended = scratch(spark, "follow"), []

    def absorb(batch: DataFrame, batch_id: int) -> None:
        rows = prepare(batch)
        rows.write.mode("overwrite").parquet(f"{folder}/frames/batch={batch_id}")
        if rows.where(terminal).limit(1).count():
            ended.append(batch_id)

    stream = spark.readStream.schema(schema).parquet(source)
    run = stream.writeStream.foreachBatch(absorb).option("checkpointLocation", f"{folder}/offsets").trigger(processingTime=every).start()
    until = time.monotonic() + patience_s
    while run.isActive and not ended and time.monotonic() < until:
        run.awaitTermination(1)
    failed = run.exception()
    run.stop()
    if failed:
        raise failed
    if not ended:
        folders.remove(spark, folder)
        raise NeverEnded(f"no frame in {patience_s:g} s for which {terminal}")
    frames = spark.read.parquet(f"{folder}/frames").drop("batch")
    first = frames.where(terminal).agg(F.min("seq").alias("_end"))
    return _taken(spark, frames.join(F.broadcast(first)).where(F.col("seq") <= F.col("_end")).drop("_end"), folder)


def resume_window(frames: DataFrame, by: str, order: str, keep: int = RESUME_FRAMES) -> DataFrame:
    """The last frames of each stream; the bound is taken before the shuffle."""
    w = Window.partitionBy(by).orderBy(F.desc(order))
    return frames.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= keep).drop("_r")


def resume_status(window: DataFrame, by: str, order: str, cursors: DataFrame) -> DataFrame:
    """What each cursor (by, cursor) gets: frames to send, or why not."""
    bounds = window.groupBy(by).agg(F.min(order).alias("first"), F.max(order).alias("head"))
    status = F.when(F.col("cursor") > F.col("head"), "invalid_input").when(F.col("cursor") < F.col("first") - 1, "resume_window_exceeded").otherwise("resumed")
    return cursors.join(bounds, by).select(by, "cursor", status.alias("status"), F.when(status == "resumed", F.col("head") - F.col("cursor")).alias("behind"))


def settled(frames: DataFrame, by: str, order: str, terminal) -> DataFrame:
    """Frames that may be sent: all but the newest of a stream that has not ended."""
    # An aggregate joined back, not a window, so that a stream with a third of the frames can be split.
    ends = frames.groupBy(F.col(by).alias("_by")).agg(F.max(order).alias("_last"), F.max(F.when(terminal, 1).otherwise(0)).alias("_ended"))
    marked = frames.join(ends, F.col(by).eqNullSafe(F.col("_by")))
    return marked.where((F.col(order) < F.col("_last")) | (F.col("_ended") == 1)).drop("_by", "_last", "_ended")


def pull(frames: DataFrame, by: str, order: str, cursors: DataFrame, limit: int) -> DataFrame:
    """The next frames after each cursor, at most limit of each."""
    own = frames.join(cursors, by).where(F.col(order) > F.col("cursor"))
    w = Window.partitionBy(by).orderBy(order)
    return own.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r", "cursor")


def sse(frames: DataFrame) -> DataFrame:
    """Frames rendered as server-sent events."""
    return frames.select("stream_seq", F.concat(F.lit("id: "), F.col("stream_seq").cast("string"), F.lit("\nevent: "), "event_kind", F.lit("\ndata: "), F.replace("data_json", F.lit("\n"), F.lit("\ndata: ")), F.lit("\n\n")).alias("event"))


def sse_events(texts: DataFrame, text: str) -> DataFrame:
    """Events of a text of server-sent events: id, event, data."""
    blocks = texts.select(F.posexplode(F.split(text, "\n\n", -1)).alias("at", "block")).where("block <> ''")
    field = lambda name: F.array_join(F.transform(F.filter(F.split("block", "\n", -1), lambda l: F.startswith(l, F.lit(f"{name}: "))), lambda l: F.substr(l, F.lit(len(name) + 3))), "\n")
    return blocks.select("at", field("id").alias("id"), field("event").alias("event"), field("data").alias("data"))
