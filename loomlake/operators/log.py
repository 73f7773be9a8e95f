"""Operations on the append-only log: scans, numbering, validation, digests, verification, snapshots, export."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake import model
from loomlake.plans import fold
from loomlake.session import checkpointed, sized
from loomlake.sources import folders


#: Rows of bounds that are broadcast at most, some 40 bytes each; beyond, they are joined by a shuffle.
BOUNDS_MAX = 500_000


class HeadChanged(Exception):
    """A conditional append found another head than it expected."""


class InvalidBatch(Exception):
    """A batch holds requests that the log does not take; none of it was written."""


def range_scan(log: DataFrame, after: int, limit: int) -> DataFrame:
    """The next events after a cursor; filter, order and limit are one bounded top-k."""
    return log.where(F.col("seq") > after).orderBy("seq").limit(limit)


def head(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("seq"), F.lit(0)).alias("head"), F.count("*").alias("events"))


def numbered(rows: DataFrame, order: str, start: int = 0, by: tuple[str, ...] = (), name: str = "seq") -> DataFrame:
    """rows with a contiguous number from start + 1 in the given order, within each key of by if any is named.

    Rows are sorted by range over key and order, so that a hot key lies in many partitions, and written out with
    the partition and place that they came to: counts and rows are read from what was written, never from two
    sorts that could differ. A number is then the place less the key's first in that partition, more what lies in
    the partitions before. Bounds are one row per partition and key in it.
    """
    marks = {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
    placed = checkpointed(rows.orderBy(*by, order).withColumns(marks))
    bounds = placed.groupBy("_part", *by).agg(F.min("_at").alias("_least"), F.count("*").alias("_n"))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("_n").over(before), F.lit(0)) + start + 1
    bounds = bounds.select(F.col("_part").alias("_of"), *(F.col(c).alias(f"_{c}") for c in by), (first - F.col("_least")).alias("_shift"))
    same = F.col("_part") == F.col("_of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    joined = placed.join(sized(bounds, BOUNDS_MAX), same)
    return joined.select(*(F.col(c) for c in rows.columns), (F.col("_at") + F.col("_shift")).alias(name))


def lamport(log: DataFrame) -> DataFrame:
    """Per-device counters in seq order; a device that writes a third of the log is numbered in many tasks."""
    return numbered(log, "seq", by=("device",), name="lamport")


def gaps(log: DataFrame, after: int = 0) -> DataFrame:
    """Where the sequence breaks: seq without a predecessor. An anti join on seq - 1, so no global order is needed."""
    before = log.select((F.col("seq") + 1).alias("next"))
    return log.where(F.col("seq") > after + 1).join(before, F.col("seq") == F.col("next"), "left_anti").select("seq")


def validated(requests: DataFrame) -> DataFrame:
    """requests with problem: null, or what is wrong with kind, body or refs."""
    problem = (
        F.when(F.col("kind").isNull() | ~F.col("kind").rlike(f"^[A-Za-z0-9]{{1,{model.KIND_CHARS_MAX}}}$"), "kind")
        .when(F.octet_length("body") > model.BODY_BYTES_MAX, "body")
        .when(F.size("refs") > model.REFS_MAX, "refs")
    )
    return requests.withColumn("problem", problem)


def heads(spark: SparkSession, path: str) -> tuple[int, DataFrame | None]:
    """The head of the stored log, and each device's last counter; 0 and none if there is no log."""
    if not folders.exists(spark, path):
        return 0, None
    log = spark.read.parquet(path)
    return head(log).first()["head"], log.groupBy(F.col("device").alias("_of_device")).agg(F.max("lamport").alias("_last"))


def append(spark: SparkSession, path: str, requests: DataFrame, order: str, expected_head: int | None = None) -> int:
    """Append a batch to the log at path and give the new head.

    Every row gets the next seq and its device's next lamport counter. The whole batch is refused if the head is
    not the expected one or if any request is invalid. One writer at a time, as a single-writer log demands; files
    of a failed write are never visible.
    """
    now, last = heads(spark, path)
    if expected_head is not None and now != expected_head:
        raise HeadChanged(f"expected {expected_head}, found {now}")
    requests = checkpointed(requests)  # what is judged is what is written, whatever the source does meanwhile
    bad = validated(requests).where("problem IS NOT NULL").groupBy("problem").agg(F.count("*").alias("n")).orderBy("problem").collect()
    if bad:
        raise InvalidBatch(", ".join(f"{r.n} x {r.problem}" for r in bad))
    rows = numbered(numbered(requests, order, now), "seq", by=("device",), name="lamport")
    if last is not None:
        own = rows.join(last, F.col("device").eqNullSafe(F.col("_of_device")), "left")
        rows = own.withColumn("lamport", F.col("lamport") + F.coalesce("_last", F.lit(0))).drop("_of_device", "_last")
    rows.write.mode("append").parquet(path)
    return head(spark.read.parquet(path)).first()["head"]


def row_digest(columns: list[str]) -> Column:
    """60 bits of a row: every value as text behind its length, null as a mark of its own."""
    tagged = [F.coalesce(F.concat(F.length(F.col(c).cast("string")).cast("string"), F.lit(":"), F.col(c).cast("string")), F.lit("null")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws(";", *tagged)), 1, 15), 16, 10).cast("long")


def table_digest(df: DataFrame) -> DataFrame:
    """Order-free digest of a table: rows, and exclusive or and (bounded) sum of the row digests. One partial aggregation, columns by name."""
    h = row_digest(sorted(df.columns))
    return df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("mixed"), F.sum(h.bitwiseAND(F.lit(0xFFFFF))).alias("added"))


def mismatches(stored: DataFrame, derived: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that differ between a stored table and its re-derivation: keys and what is wrong."""
    value = lambda df, name: df.select(*keys, F.struct(*[c for c in df.columns if c not in keys]).alias(name))
    both = value(stored, "stored").join(value(derived, "derived"), keys, "full_outer")
    problem = F.when(F.col("stored").isNull(), "missing").when(F.col("derived").isNull(), "surplus").when(~F.col("stored").eqNullSafe(F.col("derived")), "changed")
    return both.select(*keys, problem.alias("problem")).where("problem IS NOT NULL")


def verify_report(tables: dict[str, tuple[DataFrame, DataFrame]], compared: tuple[str, list[str]], blobs: DataFrame) -> DataFrame:
    """item, seen, wrong: each stored table's digest against its derivation, the rows of one that differ, and blobs (name, content) that are not what their name says."""
    one = lambda item, df: df.select(F.lit(item).alias("item"), "seen", "wrong")
    parts = []
    for name, (stored, derived) in tables.items():
        both = table_digest(stored).select(F.struct("*").alias("a")).crossJoin(table_digest(derived).select(F.struct("*").alias("b")))  # a row each
        parts.append(one(f"digest of a {name} table", both.select(F.col("a.n").alias("seen"), (F.col("a") != F.col("b")).cast("long").alias("wrong"))))
    name, keys = compared
    stored, derived = tables[name]
    wrong = mismatches(stored, derived, keys).agg(*(F.count_if(F.col("problem") == p).alias(p) for p in ("changed", "missing", "surplus")))
    both = derived.agg(F.count("*").alias("seen")).crossJoin(wrong)
    parts += [one(f"rows {p}", both.withColumn("wrong", F.col(p))) for p in ("changed", "missing", "surplus")]
    parts.append(one("blobs", blobs.agg(F.count("*").alias("seen"), F.count_if(F.sha2("content", 256) != F.col("name")).alias("wrong"))))
    report = parts[0]
    for p in parts[1:]:
        report = report.unionByName(p)
    return report


def schema_digest(tables: dict[str, fold.Table], version: int = 1) -> str:
    """Digest of table names, keys and columns; a snapshot of another digest is stale."""
    import hashlib

    text = ";".join(f"{n}:{','.join(t.key)}:{','.join(f'{c}/{type(k).__name__}' for c, k in t.columns.items())}" for n, t in sorted(tables.items()))
    return hashlib.sha256(f"{version};{text}".encode()).hexdigest()[:16]


def write_snapshot(states: DataFrame, folder: str, digest: str, seq: int, keep: int | None = None) -> str:
    """Write the state as it is at seq; with keep, remove all but the newest so many of this digest."""
    path = f"{folder}/digest={digest}/snapshot_seq={seq}"
    states.write.mode("overwrite").parquet(path)
    if keep is not None:
        for old in sorted(snapshot_seqs(states.sparkSession, folder, digest), reverse=True)[keep:]:
            folders.remove(states.sparkSession, f"{folder}/digest={digest}/snapshot_seq={old}")
    return path


def snapshot_seqs(spark: SparkSession, folder: str, digest: str) -> list[int]:
    """Where complete snapshots of this digest stand; one whose write was cut off does not count."""
    at = f"{folder}/digest={digest}"
    found = [re.fullmatch(r"snapshot_seq=(\d+)", n) for n in folders.names(spark, at)]
    return [int(m[1]) for m in found if m and folders.exists(spark, f"{at}/{m[0]}/_SUCCESS")]


def newest_snapshot(spark: SparkSession, folder: str, digest: str, upto: int) -> tuple[int, DataFrame] | None:
    """The newest snapshot of this digest at or before a head."""
    seqs = [s for s in snapshot_seqs(spark, folder, digest) if s <= upto]
    return (max(seqs), spark.read.parquet(f"{folder}/digest={digest}/snapshot_seq={max(seqs)}")) if seqs else None


def restored(spark: SparkSession, log: DataFrame, folder: str, table: fold.Table, upto: int) -> DataFrame:
    """The state at upto: the newest snapshot with the tail of the log folded onto it, or the fold of all where there is none."""
    found = newest_snapshot(spark, folder, schema_digest({"t": table}), upto)
    tail = log.where(F.col("seq") <= upto)
    if found is None:
        return fold.state(tail, table)
    seq, snapshot = found
    return fold.absorb(snapshot, tail.where(F.col("seq") > seq), table)


def export_lines(log: DataFrame) -> DataFrame:
    """One JSON line per event, as the export writes them."""
    fields = F.struct(F.col("seq"), F.col("device"), F.col("ts_ms").alias("tsMs"), F.col("kind"), F.lower(F.hex(F.encode(F.col("body"), "UTF-8"))).alias("bodyHex"))
    return log.select("seq", F.to_json(fields).alias("line"))


def export_json(log: DataFrame, path: str) -> None:
    """The export itself: JSON lines beside a manifest (head, events, an id), which is written last and marks the export complete."""
    export_lines(log).select("line").write.text(f"{path}/events")
    head(log).withColumn("export_id", F.lit(uuid.uuid4().hex)).write.json(f"{path}/manifest")
