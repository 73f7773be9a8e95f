"""Transcripts of long recordings, window by window, with a transcriber as a hook.

Where the next window begins depends on what was decoded in this one (the tail past the last segment is read again, so
that a word across the boundary is heard whole), so the windows of an item are a recurrence: items are dealt over tasks, and an item is
read from front to back, a window at a time, within its task. What is committed never overlaps: the committed end is carried
from window to window, and a segment that starts before it, which a transcriber gives when it hears the carried tail twice, is dropped.
An item whose earlier run was cut off goes on at the largest end of its stored segments, with the next index.

A transcriber is a function of a recording, of any type, and a window's start and end in ms; it gives the segments that it hears
(start_ms, end_ms, text, in order) and by how many ms to go on. dry_run() is one that reads utterances instead of sound.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomlake.operators.text import TURN_GAP_MS

#: Length of a window, and the ms that a character lasts in a dry run, whose transcriber goes on by whole seconds.
WINDOW_MS, CHAR_MS, STEP_MS = 30_000, 60, 1_000
Segment = tuple[int, int, str]
Transcriber = Callable[[object, int, int], tuple[list[Segment], int]]
SEGMENTS = "item long, batch_index long, segment_index long, start_ms long, end_ms long, starts_turn boolean, text string"


class NoProgress(Exception):
    """A transcriber that does not go on would hear the same window for ever."""


def dry_run(utterances: list[dict], from_ms: int, to_ms: int) -> tuple[list[Segment], int]:
    """Utterances (start_ms, end_ms, text) that end in the window, from its start on; if none does, what the window holds of the first."""
    heard = [u for u in utterances or [] if u["start_ms"] < to_ms and u["end_ms"] > from_ms]

    def part(u: dict, stop: int) -> Segment:
        start = max(u["start_ms"], from_ms)
        return start, stop, u["text"][(start - u["start_ms"]) // CHAR_MS : -(-(stop - u["start_ms"]) // CHAR_MS)]

    segments = [part(u, u["end_ms"]) for u in heard if u["end_ms"] <= to_ms] or [part(u, to_ms) for u in heard[:1]]
    if not segments:
        return [], to_ms - from_ms
    return segments, max(STEP_MS, (segments[-1][1] - from_ms) // STEP_MS * STEP_MS)


def transcript(recording: object, length_ms: int, transcriber: Transcriber, window_ms: int, next_index: int = 0, resume_ms: int = 0) -> Iterator[tuple]:
    """batch_index, segment_index, start_ms, end_ms, starts_turn, text of what one item's run commits."""
    at, committed, batch, index = resume_ms, resume_ms, 0, next_index
    while at < length_ms:
        segments, advance = transcriber(recording, at, min(at + window_ms, length_ms))
        if advance <= 0:
            raise NoProgress(f"window at {at} ms")
        before = committed
        for start, stop, text in segments:
            # The guard is what was committed before this window; within it, segments are the transcriber's own.
            if start >= before:
                stop = max(start, stop)
                yield batch, index, start, stop, index == 0 or start - committed >= TURN_GAP_MS, text
                committed, index = max(committed, stop), index + 1
        at, batch = at + advance, batch + 1


def transcribed(items: DataFrame, transcriber: Transcriber, progress: DataFrame | None = None, window_ms: int = WINDOW_MS) -> DataFrame:
    """SEGMENTS of items (item, length_ms, recording) as this run commits them. progress: segments (item, segment_index, end_ms) that earlier runs committed."""
    items = items.select(F.col("item").cast("long").alias("item"), F.col("length_ms").cast("long").alias("length_ms"), "recording")
    if progress is None:
        rows = items.select("*", F.lit(0).cast("long").alias("next_index"), F.lit(0).cast("long").alias("resume_ms"))
    else:
        done = progress.groupBy(F.col("item").alias("of")).agg((F.max("segment_index") + 1).cast("long").alias("next_index"), F.max("end_ms").cast("long").alias("resume_ms"))
        zero = F.lit(0).cast("long")
        rows = items.join(done, F.col("item") == F.col("of"), "left").select("item", "length_ms", "recording", F.coalesce("next_index", zero).alias("next_index"), F.coalesce("resume_ms", zero).alias("resume_ms"))
    names = [c.split()[0] for c in SEGMENTS.split(", ")]
    kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):  # one recording at a time
                item, length, recording, index, resume = (batch.column(c)[k].as_py() for c in range(5))
                rows = [(item, *r) for r in transcript(recording, length or 0, transcriber, window_ms, index, resume)]
                columns = zip(*rows, strict=True) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return rows.mapInArrow(run, SEGMENTS)
