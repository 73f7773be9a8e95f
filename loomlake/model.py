"""Schemas of the event envelope, segments, chunks and stream frames."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructField, StructType

REF = StructType([StructField("entity", StringType()), StructField("id", BinaryType())])

EVENT = StructType(
    [
        StructField("seq", LongType(), False),
        StructField("device", BinaryType(), False),
        StructField("lamport", LongType(), False),
        StructField("ts_ms", LongType(), False),
        StructField("actor_kind", IntegerType(), False),
        StructField("actor_id", BinaryType(), False),
        StructField("kind", StringType(), False),
        StructField("body", StringType()),
        StructField("refs", ArrayType(REF)),
    ]
)

SEGMENT = StructType([StructField(n, LongType()) for n in ("byte_start", "byte_end", "locator_kind", "depth", "a", "b")])
FRAME = StructType([StructField("stream_seq", LongType()), StructField("event_kind", StringType()), StructField("data_json", StringType())])

# Fixed limits of the log format.
BODY_BYTES_MAX, REFS_MAX, KIND_CHARS_MAX, ROWS_MAX = 1 << 20, 64, 64, 500
