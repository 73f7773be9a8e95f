"""Files as sources and sinks: what the given tables hold is written out, and read back as intake reads it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators import log as log_ops
from loomlake.queries.texts import captions
from loomlake.registry import query
from loomlake.session import checkpointed, scratch
from loomlake.sources import files, folders
from loomlake.sources.tables import LOG_SQL, event_log, table


#: Bytes of a file that intake's folder holds, about, and how many files there are at most; well below what intake takes.
FILE_BYTES, FILES = 128 << 20, 1_000


def _through(spark: SparkSession, name: str, use: Callable[[str], DataFrame]) -> DataFrame:
    """What use makes of a new folder, which goes again."""
    path = scratch(spark, name)
    found = checkpointed(use(path))
    folders.remove(spark, path)
    return found


@query("SELECT lang, count(*) > 0 AS taken, CAST(sum(strlen(text) + 1) AS BIGINT) AS n_bytes, false AS truncated FROM documents WHERE text IS NOT NULL GROUP BY lang")
def file_intake(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of text files for each language, as a plan of intake lists it; a language is dealt into files of about FILE_BYTES, at most FILES of all."""

    def use(path: str) -> DataFrame:
        d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "lang", F.col("text").alias("value"))
        sizes = d.groupBy(F.col("lang").alias("of")).agg(F.sum(F.octet_length("value") + 1).alias("bytes"))
        total = F.sum("bytes").over(Window.partitionBy())  # over a row for each language
        share = F.least(F.ceil(F.col("bytes") / FILE_BYTES), F.greatest(F.floor(FILES * F.col("bytes") / total), F.lit(1)))
        sizes = checkpointed(sizes.select("of", share.cast("int").alias("parts")))
        d = d.join(F.broadcast(sizes), F.col("lang").eqNullSafe(F.col("of"))).withColumn("part", F.pmod(F.xxhash64("doc_id", "value"), F.col("parts")))
        # Each part is a range of its own, so that no task gets two by the chance of a hash, and a task's rows are one file a language.
        number = sizes.agg(F.sum("parts").cast("int").alias("n")).first().n or 1
        d.repartitionByRange(number, "lang", "part").select("lang", "value").write.partitionBy("lang").text(path)
        plan = files.plan_intake(spark, path)
        lang = F.regexp_extract("path", r"lang=([^/]+)/", 1)
        return plan.groupBy(lang.alias("lang")).agg((F.count_if(~F.col("skipped")) > 0).alias("taken"), F.sum("length").alias("n_bytes"), F.max("truncated").alias("truncated"))

    return _through(spark, "intake", use)


@query("""WITH c AS (SELECT 'item-' || conv_id AS title FROM conversations GROUP BY conv_id HAVING conv_id % 20 = 0)
SELECT title, 'captions' AS media FROM c UNION ALL SELECT 'item-' || item_id, 'json' FROM benchmark WHERE item_id % 10 = 0""")
def file_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Caption files and JSON files opened: what they are by their first bytes, whatever their names say."""

    def use(path: str) -> DataFrame:
        c = captions(spark, sf_dir).where("conv_id % 20 = 0").select(F.concat(F.lit("item-"), F.col("conv_id").cast("string")).alias("file"), F.col("text").alias("value"))
        b = table(spark, sf_dir, "benchmark").where("item_id % 10 = 0").select(F.concat(F.lit("item-"), F.col("item_id").cast("string")).alias("file"), F.to_json(F.struct("item_id", "text")).alias("value"))
        c.repartition("file").write.partitionBy("file").text(f"{path}/a")
        b.repartition("file").write.partitionBy("file").text(f"{path}/b")
        found = files.opened(spark, path)
        return found.select(F.regexp_extract("path", r"file=([^/]+)/", 1).alias("title"), "media")

    return _through(spark, "opened", use)


@query("SELECT conv_id, turn, role, text FROM conversations")
def json_lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as lines of JSON and read under a schema that a malformed line would break."""

    def use(path: str) -> DataFrame:
        table(spark, sf_dir, "conversations").select(F.to_json(F.struct("conv_id", "turn", "role", "text")).alias("value")).write.text(path)
        return files.json_lines(spark, path, "conv_id long, turn long, role string, text string")

    return _through(spark, "lines", use)


@query("SELECT item_id, sha256(text) AS hash, strlen(text) AS n_bytes FROM benchmark")
def manifest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of the benchmark's items, one JSON document, and the entries read from it."""

    def use(path: str) -> DataFrame:
        entry = F.struct("item_id", F.sha2("text", 256).alias("hash"), F.octet_length("text").cast("long").alias("n_bytes"))
        one = table(spark, sf_dir, "benchmark").agg(F.collect_list(entry).alias("entries"))  # a manifest is one document
        one.select(F.to_json(F.struct(F.lit(1).alias("version"), "entries")).alias("value")).coalesce(1).write.text(path)
        return files.manifest(spark, path, "version int, entries array<struct<item_id:long,hash:string,n_bytes:long>>", "entries")

    return _through(spark, "manifest", use)


@query("""SELECT 'item-' || item_id AS name, CAST(1 + item_id % 3 AS INTEGER) AS version, CAST(item_id AS VARCHAR) AS item, 'benchmark' AS suite, text || chr(10) AS body FROM benchmark""")
def prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts as files with their versions in their names and their fields in front."""

    def use(path: str) -> DataFrame:
        front = F.concat(F.lit("---\nitem: "), F.col("item_id").cast("string"), F.lit("\nsuite: benchmark\n---\n"))
        name = F.concat(F.lit("item-"), F.col("item_id").cast("string"), F.lit("@"), (1 + F.col("item_id") % 3).cast("string"), F.lit(".md"))
        table(spark, sf_dir, "benchmark").select(name.alias("file"), F.concat(front, "text").alias("value")).repartition("file").write.partitionBy("file").text(path)
        return files.prompts(spark, f"{path}/*").select("name", "version", F.col("fields")["item"].alias("item"), F.col("fields")["suite"].alias("suite"), "body")

    return _through(spark, "prompts", use)


@query(f"""WITH {LOG_SQL} SELECT coalesce(max(seq), 0) AS head, count(*) AS events, count(*) AS lines, count(*) AS decoded, max(kind) AS last_kind FROM log""")
def export_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log exported with its manifest, and what a reader of the export finds."""

    def use(path: str) -> DataFrame:
        log_ops.export_json(event_log(spark, sf_dir), path)
        lines = files.json_lines(spark, f"{path}/events", "seq long, device long, tsMs long, kind string, bodyHex string")
        read = lines.agg(F.count("*").alias("lines"), F.count_if(F.col("seq").isNotNull() & F.col("bodyHex").isNotNull()).alias("decoded"), F.max("kind").alias("last_kind"))
        return spark.read.schema("head long, events long, export_id string").json(f"{path}/manifest").select("head", "events").crossJoin(read)  # a row each

    return _through(spark, "export", use)
