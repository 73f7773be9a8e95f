"""Stages of the text pipeline: a registry of functions from DataFrame to DataFrame, run one after another, and the embedder's hook.

A stage is registered under a name with the media that it takes; what it does not take passes it by. Plugging in
another normaliser, chunker or embedder is registering another function; nothing else changes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomlake.functions import scalars
from loomlake.operators import text as ops

StageFunction = Callable[[DataFrame], DataFrame]
#: Distinct (content_hash, content) rows to (content_hash, vector) rows, one each.
Embedder = Callable[[DataFrame], DataFrame]

#: What each kind of media is cut by, and the shape of its windows; fixed values.
SHAPES = {"markdown": "heading", "captions": "each", "json": "each", "table": "each", "html": "any", "text": "any"}


class UnknownStage(KeyError):
    """No stage has this name."""


@dataclass
class Registry:
    stages: dict[str, StageFunction] = field(default_factory=dict)

    def register(self, name: str) -> Callable[[StageFunction], StageFunction]:
        def put(f: StageFunction) -> StageFunction:
            self.stages[name] = f
            return f

        return put

    def run(self, df: DataFrame, names: list[str]) -> DataFrame:
        """df through the named stages in order; one plan, nothing is written between them."""
        for name in names:
            if name not in self.stages:
                raise UnknownStage(name)
            df = self.stages[name](df)
        return df


DEFAULT = Registry()


@DEFAULT.register("normalize")
def normalize(items: DataFrame) -> DataFrame:
    """item, text to item, media, text: sniffed and normalised; opaque content has an empty text."""
    media = scalars.media_of(F.substring("text", 1, 4096))
    typed = items.select("item", media.alias("media"), "text")
    return typed.select("item", "media", F.when(F.col("media") == "opaque", "").otherwise(scalars.normalized(F.col("text"))).alias("text"))


@DEFAULT.register("chunk")
def chunk(items: DataFrame) -> DataFrame:
    """item, ordinal, content (bytes as hex digits), content_hash, locator_kind, locator_first, locator_last: paragraphs in greedy windows of the shape that the media asks for, within each item's row.

    A locator says where a chunk comes from: messages of a thread (by their number), else lines; both from 0, the last included, over all segments that the chunk is cut from.
    """
    segs = ops.segment_arrays(items, "item", F.col("text"), "\\n\\n", "text", "media").withColumn("lines", ops.line_spans(F.col("text"), "\\n\\n"))
    segs = segs.withColumn("segs", F.transform("segs", lambda s: s.withField("depth", scalars.heading_depth(s["segment"]))))
    of = F.coalesce(*(F.when(F.col("media") == m, shape) for m, shape in SHAPES.items()), F.lit("any"))
    parts = [ops.chunk_windows(segs.where(of == shape), "item", shape, keep=("text", "media", "lines")) for shape in dict.fromkeys(SHAPES.values())]
    rows = reduce(DataFrame.unionByName, parts)
    cut = F.substr(F.encode("text", "UTF-8"), (F.col("byte_start") + 1).cast("int"), (F.col("byte_end") - F.col("byte_start")).cast("int"))
    thread = F.col("media") == "json"
    at = lambda idx, end: F.when(thread, F.col(idx)).otherwise(F.get("lines", F.col(idx).cast("int"))[end])
    rows = rows.select("item", "ordinal", F.hex(cut).alias("content"), F.when(thread, "message").otherwise("line").alias("locator_kind"), at("first_idx", "first").alias("locator_first"), at("last_idx", "last").alias("locator_last"))
    return rows.withColumn("content_hash", F.sha2("content", 256))


def hashed_embedder(content: DataFrame, dim: int = 8) -> DataFrame:
    """An embedder without a model: unit vectors of dim (at most 8) from the digits of a hash. Reproducible, for tests and dry runs."""
    digest = F.md5("content")
    raw = F.array(*(F.conv(F.substring(digest, 4 * k + 1, 4), 16, 10).cast("double") + 1 for k in range(dim)))
    rows = content.select("content_hash", raw.alias("raw"))
    length = F.sqrt(F.aggregate("raw", F.lit(0.0), lambda acc, x: acc + x * x))
    return rows.select("content_hash", F.transform("raw", lambda x: x / length).alias("vector"))


def embed(chunks: DataFrame, known: DataFrame, embedder: Embedder = hashed_embedder) -> DataFrame:
    """chunks with outcome (reused or computed) and vector. known: content_hash, vector of earlier runs.

    Only content that is not known is embedded, each once; a content for which the embedder gives no vector is an error.
    """
    have = known.groupBy("content_hash").agg(F.first("vector").alias("vector"))
    fresh = chunks.select("content_hash", "content").dropDuplicates(["content_hash"]).join(have, "content_hash", "left_anti")
    vectors = have.withColumn("outcome", F.lit("reused")).unionByName(embedder(fresh).withColumn("outcome", F.lit("computed")))
    joined = chunks.join(vectors, "content_hash", "left")
    whole: Column = F.when(F.col("vector").isNotNull(), F.col("vector")).otherwise(F.raise_error(F.lit("the embedder left out a content")))
    return joined.withColumn("vector", whole)
