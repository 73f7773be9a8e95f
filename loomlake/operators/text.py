"""Text pipeline: records, segments, greedy chunks, captions, turns.

Segments carry their byte spans, so chunking needs no range join. Offsets, the greedy windows and the batches are
recurrences, folded over the segments of one item within its own row: no shuffle at all, and what a row holds
is bounded by the item itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions.scalars import bound, emitted, running_sums
from loomlake.plans import ranges

TARGET_BYTES, MAX_BYTES = 1200, 1600
#: Silence in ms after which a segment starts a turn.
TURN_GAP_MS = 700


def segment_arrays(df: DataFrame, key: str, text: Column, separator: str, *keep: str) -> DataFrame:
    """key, keep..., segs: per item the parts between separators (idx, byte_start, byte_end, segment); blank ones give none but take their place."""
    # A separator is its bytes; offsets are a running sum over one item.
    gap = len(separator.encode().decode("unicode_escape"))
    parts = df.select(key, *keep, F.split(text, separator, -1).alias("parts"))
    starts = running_sums(F.transform("parts", lambda p: (F.octet_length(p) + gap).cast("long")))
    spans = F.zip_with("parts", starts, lambda p, s: F.struct(s.alias("byte_start"), (s + F.octet_length(p)).cast("long").alias("byte_end"), p.alias("segment")))
    kept = F.filter(spans, lambda x: F.btrim(x["segment"]) != "")
    return parts.select(key, *keep, F.transform(kept, lambda x, i: F.struct(i.cast("long").alias("idx"), x["byte_start"].alias("byte_start"), x["byte_end"].alias("byte_end"), x["segment"].alias("segment"))).alias("segs"))


def segments(df: DataFrame, key: str, text: Column, separator: str) -> DataFrame:
    """key, idx, byte_start, byte_end, segment: segment_arrays as rows."""
    return segment_arrays(df, key, text, separator).select(key, F.inline("segs"))


def line_spans(text: Column, separator: str) -> Column:
    """For every part between separators that is not blank, in the order of segment_arrays: the first and last line (from 0) that hold anything of it."""
    breaks = lambda p: F.length(F.regexp_replace(p, r"[^\n]", ""))
    gap = separator.encode().decode("unicode_escape").count("\n")

    def spans(parts: Column) -> Column:
        starts = running_sums(F.transform(parts, lambda p: (breaks(p) + gap).cast("long")))
        own = lambda p, at: F.struct((at + breaks(F.regexp_extract(p, r"^\s*", 0))).alias("first"), (at + breaks(F.regexp_replace(p, r"\s*$", ""))).alias("last"), (F.btrim(p) != "").alias("kept"))
        return F.filter(F.zip_with(parts, starts, own), lambda x: x["kept"])

    return bound(F.split(text, separator, -1), spans)


def chunk_windows(items: DataFrame, key: str, shape: str = "any", target: int = TARGET_BYTES, most: int = MAX_BYTES, keep: tuple[str, ...] = ()) -> DataFrame:
    """key, keep..., ordinal, byte_start, byte_end, first_idx, last_idx: greedy windows over consecutive segments (segs) of each item.

    A window closes before a segment if it has reached the target (or, for headings, if the segment is one); it
    closes after one if it has reached the maximum; a window over the maximum is cut every so many bytes. shape:
    any, each (every segment its own window), heading (segments need a depth).
    """
    window_t = "struct<a:bigint,b:bigint,i:bigint,j:bigint>"
    none = F.array().cast(f"array<{window_t}>")

    def step(state: Column, s: Column) -> tuple[Column, Column]:
        opened = state["open"]
        long_enough = (opened["b"] - opened["a"] >= target) if shape == "any" else ((s["depth"] > 0) | (opened["b"] - opened["a"] >= target))
        close_before = opened.isNotNull() & long_enough
        start = opened.isNull() | close_before
        grown = F.struct(F.when(start, s["byte_start"]).otherwise(opened["a"]).alias("a"), s["byte_end"].alias("b"), F.when(start, s["idx"]).otherwise(opened["i"]).alias("i"), s["idx"].alias("j"))
        close_after = grown["b"] - grown["a"] >= most
        closed = F.concat(F.when(close_before, F.array(opened)).otherwise(none), F.when(close_after, F.array(grown)).otherwise(none))
        return F.struct(F.when(~close_after, grown).alias("open")), closed

    if shape == "each":
        windows = F.transform("segs", lambda s: F.struct(s["byte_start"].alias("a"), s["byte_end"].alias("b"), s["idx"].alias("i"), s["idx"].alias("j")))
    else:
        last = lambda state: F.when(state["open"].isNull(), none).otherwise(F.array(state["open"]))
        windows = emitted(F.col("segs"), F.struct(F.lit(None).cast(window_t).alias("open")), step, window_t, last)
    cuts = lambda w: F.sequence(w["a"], F.greatest(w["b"] - 1, w["a"]), F.lit(most).cast("long"))
    pieces = F.flatten(F.transform(windows, lambda w: F.transform(cuts(w), lambda c: F.struct(c.alias("a"), F.least(c + most, w["b"]).alias("b"), w["i"].alias("i"), w["j"].alias("j")))))
    rows = items.select(key, *keep, F.posexplode(pieces).alias("ordinal", "p"))
    return rows.select(key, *keep, F.col("ordinal").cast("long").alias("ordinal"), F.col("p.a").alias("byte_start"), F.col("p.b").alias("byte_end"), F.col("p.i").alias("first_idx"), F.col("p.j").alias("last_idx"))


def turn_marks(segs: DataFrame, key: str, order: str, start: str, stop: str, gap_ms: int = TURN_GAP_MS) -> DataFrame:
    """segs with starts_turn: the first of its item, or after enough silence."""
    before = F.col("_before")
    marked = ranges.running(segs, (key,), order, lasts={"_before": F.col(stop)})
    return marked.withColumn("starts_turn", before.isNull() | (F.greatest(F.col(start) - before, F.lit(0)) >= gap_ms)).drop("_before")


def clamp_cues(cues: DataFrame, key: str, order: str, start: str, stop: str) -> DataFrame:
    """Cues without overlap: one that ends by what is committed goes, one that starts before it is clamped.

    A cue that goes never raises the committed end, so that end is the running maximum over all before it.
    """
    rows = ranges.running(cues, (key,), order, tops={"_c": F.col(stop)}).withColumn("_c", F.coalesce("_c", F.lit(0)))
    return rows.where(F.col(stop) > F.col("_c")).withColumn(start, F.greatest(F.col(start), F.col("_c"))).drop("_c")


def cues_of(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, idx, start_ms, end_ms, cue: blocks of a caption text that are cues; settings are dropped, lines joined."""
    from loomlake.functions.scalars import caption_ms

    blocks = df.select(key, F.posexplode(F.split(text, r"\n{2,}", -1)).alias("idx", "block"))
    lines = F.filter(F.split("block", "\n", -1), lambda x: x != "")
    blocks = blocks.select(key, "idx", lines.alias("lines"))
    blocks = blocks.withColumn("at", F.array_position(F.transform("lines", lambda x: F.contains(x, F.lit("-->"))), F.lit(True)).cast("int")).where("at BETWEEN 1 AND 2")
    times = F.get("lines", F.col("at") - 1)
    start = caption_ms(F.btrim(F.split_part(times, F.lit("-->"), F.lit(1))))
    stop = caption_ms(F.regexp_extract(F.split_part(times, F.lit("-->"), F.lit(2)), r"^\s*(\S+)", 1))
    cue = F.array_join(F.slice("lines", F.col("at") + 1, F.greatest(F.size("lines") - F.col("at"), F.lit(0))), " ")
    return blocks.select(key, F.col("idx").cast("long").alias("idx"), start.alias("start_ms"), stop.alias("end_ms"), cue.alias("cue")).where("start_ms IS NOT NULL AND end_ms >= start_ms")


def batch_plan(items: DataFrame, key: str, sizes: Column, padded_max: int = 1024, count_max: int = 63) -> DataFrame:
    """key, batch, items, padded: order-preserving greedy batches of each item's parts (an array of sizes) whose padded size stays within padded_max."""
    t = "struct<n:bigint,m:bigint>"
    none = F.array().cast(f"array<{t}>")
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("m"))

    def step(acc: Column, x: Column) -> tuple[Column, Column]:
        full = (acc["n"] > 0) & (((acc["n"] + 1) * F.greatest(acc["m"], x) > padded_max) | (acc["n"] >= count_max))
        state = F.struct(F.when(full, F.lit(1).cast("long")).otherwise(acc["n"] + 1).alias("n"), F.when(full, x).otherwise(F.greatest(acc["m"], x)).alias("m"))
        return state, F.when(full, F.array(acc)).otherwise(none)

    last = lambda acc: F.when(acc["n"] > 0, F.array(acc)).otherwise(none)
    rows = items.select(key, F.posexplode(emitted(sizes, zero, step, t, last)).alias("batch", "b"))
    return rows.select(key, F.col("batch").cast("long").alias("batch"), F.col("b.n").alias("items"), (F.col("b.n") * F.col("b.m")).alias("padded"))


def csv_records(df: DataFrame, key: str, text: Column) -> DataFrame:
    """key, idx, line, record: records of a CSV text, a line end inside quotes being part of its record; line is where it starts, from 1.

    A line belongs to an open record while the quotes before it are odd in number.
    """
    lines = df.select(key, F.split(text, "\n", -1).alias("lines"))
    quotes = running_sums(F.transform("lines", lambda x: F.length(F.regexp_replace(x, '[^"]', "")).cast("long")))
    begins = F.filter(F.transform(quotes, lambda q, i: F.when(q % 2 == 0, i)), lambda i: i.isNotNull())
    lines = lines.select(key, "lines", begins.alias("begins"))
    record = lambda i, stop: F.struct((i + 1).alias("line"), F.array_join(F.slice("lines", i + 1, stop - i), "\n").alias("record"))
    stops = F.concat(F.slice("begins", F.lit(2), F.greatest(F.size("begins") - 1, F.lit(0))), F.array(F.size("lines")))
    records = F.filter(F.zip_with("begins", stops, record), lambda r: F.btrim(r["record"]) != "")
    return lines.select(key, F.posexplode(records).alias("idx", "r")).select(key, F.col("idx").cast("long").alias("idx"), F.col("r.line").cast("long").alias("line"), "r.record")
