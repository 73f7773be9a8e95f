"""Transcripts of recordings by windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomlake.operators import speech as ops
from loomlake.registry import query
from loomlake.sources.tables import table


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as recordings: turns as utterances, as long as their texts, with a pause of 200 ms (every fifth: 900) between them."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    own = F.char_length("text") * ops.CHAR_MS
    w = Window.partitionBy("conv_id").orderBy("turn", "text")
    pause = F.when(F.col("turn") % 5 == 4, 900).otherwise(200)
    stop = F.sum(own + pause).over(w) - pause
    u = c.select("conv_id", (stop - own).cast("long").alias("start_ms"), stop.cast("long").alias("end_ms"), "text")
    listed = F.array_sort(F.collect_list(F.struct("start_ms", "end_ms", "text")))
    return u.groupBy(F.col("conv_id").alias("item")).agg(F.max("end_ms").alias("length_ms"), listed.alias("recording"))


_WINDOW = f"least(pos + {ops.WINDOW_MS}, length_ms)"
_PART = f"lambda u: {{'start_ms': greatest(u.start_ms, pos), 'end_ms': STOP, 'text': substr(u.text, CAST((greatest(u.start_ms, pos) - u.start_ms) // {ops.CHAR_MS} + 1 AS BIGINT), CAST((STOP - u.start_ms + {ops.CHAR_MS - 1}) // {ops.CHAR_MS} - (greatest(u.start_ms, pos) - u.start_ms) // {ops.CHAR_MS} AS BIGINT))}}"


@query(f"""WITH RECURSIVE t AS (SELECT conv_id, turn, coalesce(text, '') AS text, length(coalesce(text, '')) * {ops.CHAR_MS} AS own, CASE WHEN turn % 5 = 4 THEN 900 ELSE 200 END AS pause FROM conversations),
u AS (SELECT conv_id AS item, text, own, sum(own + pause) OVER (PARTITION BY conv_id ORDER BY turn, text ROWS UNBOUNDED PRECEDING) - pause AS stop FROM t),
v AS (SELECT item, CAST(stop - own AS BIGINT) AS start_ms, CAST(stop AS BIGINT) AS end_ms, text FROM u),
i AS (SELECT item, max(end_ms) AS length_ms, list({{'start_ms': start_ms, 'end_ms': end_ms, 'text': text}} ORDER BY start_ms, end_ms, text) AS us FROM v GROUP BY item),
p AS (SELECT item, length_ms, us, CASE WHEN item % 2 = 0 THEN least(len(us), 2) ELSE 0 END AS n FROM i),
g AS (
  SELECT item, length_ms, us, CAST(CASE WHEN n = 0 THEN 0 ELSE us[n].end_ms END AS BIGINT) AS pos, CAST(CASE WHEN n = 0 THEN 0 ELSE us[n].end_ms END AS BIGINT) AS committed, CAST(n AS BIGINT) AS next_index, CAST(-1 AS BIGINT) AS batch, CAST(0 AS BIGINT) AS first_index, CAST(0 AS BIGINT) AS was, us AS fresh FROM p
  UNION ALL
  SELECT item, length_ms, us, pos + CASE WHEN len(segs) = 0 THEN to_ms - pos ELSE greatest({ops.STEP_MS}, (segs[-1].end_ms - pos) // {ops.STEP_MS} * {ops.STEP_MS}) END, greatest(committed, coalesce(list_max(list_transform(kept, lambda s: s.end_ms)), committed)), next_index + len(kept), batch + 1, next_index, committed, kept
  FROM (SELECT *, list_filter(segs, lambda s: s.start_ms >= committed) AS kept FROM (SELECT *, CASE WHEN len(whole) > 0 THEN list_transform(whole, {_PART.replace('STOP', 'u.end_ms')}) ELSE list_transform(heard[1:1], {_PART.replace('STOP', 'to_ms')}) END AS segs
    FROM (SELECT *, list_filter(heard, lambda u: u.end_ms <= to_ms) AS whole FROM (SELECT *, list_filter(us, lambda u: u.start_ms < to_ms AND u.end_ms > pos) AS heard FROM (SELECT *, {_WINDOW} AS to_ms FROM g WHERE pos < length_ms)))))),
s AS (SELECT item, batch AS batch_index, first_index, was, unnest(fresh) AS x, generate_subscripts(fresh, 1) AS k FROM g WHERE batch >= 0),
o AS (SELECT item, batch_index, first_index + k - 1 AS segment_index, x.start_ms AS start_ms, x.end_ms AS end_ms, x.text AS text, was, max(x.end_ms) OVER (PARTITION BY item, batch_index ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT item, batch_index, segment_index, start_ms, end_ms, segment_index = 0 OR start_ms - greatest(was, coalesce(before, was)) >= 700 AS starts_turn, text FROM o""")
def transcript_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every recording heard window by window, the committed end carried along; of every second one two segments are stored already, and it goes on behind them."""
    items = recordings(spark, sf_dir)
    stored = items.where("item % 2 = 0").select("item", F.posexplode(F.slice("recording", F.lit(1), F.lit(2))).alias("segment_index", "u")).select("item", "segment_index", "u.end_ms")
    return ops.transcribed(items, ops.dry_run, stored)
