"""File sources: intake of folders, JSON lines, manifests, prompts with front matter, vocabularies, blobs.

All listing and reading goes through Spark's readers, so any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILES_MAX, DEPTH_MAX, TEXT_BYTES_MAX = 2_000, 8, 1 << 30


def plan_intake(spark: SparkSession, root: str, own_suffix: str = "", files_max: int = FILES_MAX) -> DataFrame:
    """path, length, modified, skipped, truncated: files below root in order, at most files_max; hidden, own (a folder or file with own_suffix) and too deep ones are marked.

    truncated says on every row whether there were more than that.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    inside = F.regexp_replace("path", r"^.*?" + _quoted(root.rstrip("/")) + "/", "")
    hidden = inside.rlike(r"(^|/)\.") | (inside.rlike(_quoted(own_suffix) + "(/|$)") if own_suffix else F.lit(False)) | (F.size(F.split(inside, "/", -1)) > DEPTH_MAX)
    total = files.agg((F.count("*") > files_max).alias("truncated"))  # one row
    return files.withColumn("skipped", hidden).orderBy("path").limit(files_max).join(F.broadcast(total))


def _quoted(text: str) -> str:
    import re

    return re.escape(text.split("://", 1)[-1])


def opened(spark: SparkSession, root: str) -> DataFrame:
    """path, length, title, media of the files that intake takes; media by their first bytes."""
    from loomlake.functions.scalars import media_of

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    head = F.decode(F.substring("content", 1, 4096), "ISO-8859-1")
    title = F.substring(F.btrim(F.regexp_replace(F.regexp_extract("path", r"([^/]+?)(\.[^./]*)?$", 1), r"\p{Cntrl}", "")), 1, 200)
    return files.select("path", "length", title.alias("title"), media_of(head).alias("media"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row per line, blank lines skipped; a malformed line fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def manifest(spark: SparkSession, path: str, schema: str, entries: str) -> DataFrame:
    """The entries of a manifest that is one JSON document."""
    return spark.read.schema(schema).option("multiLine", "true").json(path).select(F.inline(entries))


def prompts(spark: SparkSession, root: str) -> DataFrame:
    """name, version, front (as text), fields (its `key: value` lines as a map), body, hash of files name@version.md (or the one file in a folder of that name, as Spark writes it) with front matter between lines of dashes."""
    files = spark.read.text(root, wholetext=True).select(F.col("value"), F.input_file_name().alias("path"))
    name = r"([^/@=]+)@(\d+)\.md(?:/[^/]+)?$"
    matter = r"(?s)^---\n(.*?)\n---\n(.*)$"
    return files.select(
        F.regexp_extract("path", name, 1).alias("name"), F.regexp_extract("path", name, 2).try_cast("int").alias("version"),
        F.regexp_extract("value", matter, 1).alias("front"), F.expr(f"str_to_map(regexp_extract(value, r'{matter}', 1), '\n', ': ')").alias("fields"), F.when(F.col("value").rlike(matter), F.regexp_extract("value", matter, 2)).otherwise(F.col("value")).alias("body"), F.sha2("value", 256).alias("hash"),
    ).where("name <> ''")


def new_blobs(blobs: DataFrame, existing: DataFrame) -> DataFrame:
    """hash, content of blobs (content) that the store does not have, each once."""
    hashed = blobs.select(F.sha2("content", 256).alias("hash"), "content").dropDuplicates(["hash"])
    return hashed.join(existing.select("hash"), "hash", "left_anti")


def read_blobs(wanted: DataFrame, store: DataFrame) -> DataFrame:
    """wanted (with hash) with status and content: ok, missing, or corrupt, where the stored content does not hash to its name."""
    held = store.select(F.col("hash").alias("_name"), F.col("content").alias("_content"))
    joined = wanted.join(held, F.col("hash") == F.col("_name"), "left")
    status = F.when(F.col("_name").isNull(), "missing").when(F.sha2("_content", 256) != F.col("hash"), "corrupt").otherwise("ok")
    return joined.withColumn("status", status).withColumn("content", F.when(F.col("status") == "ok", F.col("_content"))).drop("_name", "_content")


def synthetic_events(numbers: DataFrame, seed: int) -> DataFrame:
    """Reproducible events by seed and number (seq): seq, device, kind in a weighted mix, amount. A map: any part can be made again."""
    digest = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("seq").cast("string")))
    number = lambda at: F.conv(F.substring(digest, at, 7), 16, 10).cast("long")
    pick = number(1) % 100
    kind = F.when(pick < 45, "step").when(pick < 55, "start").when(pick < 65, "finish").when(pick < 78, "enqueue").when(pick < 88, "complete").when(pick < 94, "rename").otherwise("audit")
    return numbers.select("seq", (number(9) % 3).alias("device"), kind.alias("kind"), (number(17) % 1000000).alias("amount"))


def little_endian(value: Column) -> Column:
    """A long as 16 hex digits, least byte first."""
    digits = F.lpad(F.hex(value), 16, "0")
    return F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8)))


def from_little_endian(digits: Column) -> Column:
    return F.conv(F.concat(*(F.substring(digits, 15 - 2 * k, 2) for k in range(8))), 16, 10).cast("decimal(20,0)").cast("long")


def segment_records(segments: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, records: each item's segments packed as fixed-width little-endian records, as hex digits."""
    packed = segments.select(key, F.col(fields[0]).alias("at"), F.concat(*(little_endian(F.col(f)) for f in fields)).alias("r"))
    return packed.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]), "").alias("records"))


def decoded_segments(records: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """The segments again; a short record, or an end before its start, is corruption and fails."""
    width = 16 * len(fields)
    sound = F.when(F.length("records") % width == 0, F.col("records")).otherwise(F.raise_error(F.lit("short record")))
    n = F.floor(F.length("records") / width).cast("int")
    rows = records.select(key, sound.alias("records")).where(n > 0).select(key, F.explode(F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.substr(F.col("records"), k * width + 1, F.lit(width)))).alias("r"))
    return rows.select(key, *(from_little_endian(F.substring("r", 16 * k + 1, 16)).alias(f) for k, f in enumerate(fields)))
