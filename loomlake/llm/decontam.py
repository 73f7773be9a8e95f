"""Benchmark decontamination by spaced-seed hashing.

Fixed masks say which of some consecutive words count and which are ignored. Every position of every text gives
one hash per mask, as does every position of the benchmark; equal hashes are hits, whatever the ignored words.
Around a hit the text and the benchmark item are laid side by side and verified: a document is contaminated by
an item if some WINDOW words of the item (all of them, if it has fewer) agree with the text in at least AGREE of
their places.

The masks lose none of these. Two serve all items of WINDOW words or more: wherever two words of a window are
substituted, one of the masks fits between them at some position (the tests enumerate all cases). Shorter items
have masks by their length: with k substitutions allowed, the item is cut into k + 2 parts and each mask leaves
out k of them, so that one mask is untouched; without any allowed, the whole item is the mask. Only the masks that
the benchmark's lengths call for are hashed in the texts.

The benchmark's hashes are counted first. Up to MAX_BROADCAST they are sent to every executor, and texts stream
past them without any shuffle; beyond, positions alone are joined by a shuffle that can be split at hot hashes,
and the words of a text are fetched once for its hits. Hits on the same diagonal are one before the shuffle.

Edge cases: words are lower-cased runs of letters, digits and all beyond ASCII; items of four words or fewer must
stand verbatim, items without words contaminate nothing; null texts are empty; null ids are ids; repeated rows are
found alike, and equal benchmark items each; very long texts are taken whole; with an empty benchmark nothing is
contaminated; other columns are kept, whatever their names.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 13
AGREE = 0.8
#: Places that count, for items of WINDOW words or more.
MASKS = ((0, 1, 2, 4, 6, 7), (0, 1, 3, 6, 7, 8))
#: Benchmark hashes, and contaminated documents, that are broadcast at most: some 24 bytes each, so 50 MB.
MAX_BROADCAST = 2_000_000
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def needed(length: int) -> int:
    """Words that must agree in a window of so many."""
    return math.ceil(round(length * AGREE, 6))


def masks_of(length: int) -> tuple[tuple[int, ...], ...]:
    """Masks for items of so many words."""
    if length >= WINDOW:
        return MASKS
    k = length - needed(length)
    parts = k + 2 if k else 1
    cuts = [length * j // parts for j in range(parts + 1)]
    return tuple(tuple(p for j in kept for p in range(cuts[j], cuts[j + 1])) for kept in combinations(range(parts), parts - k))


def word_hashes(text: Column) -> Column:
    words = F.array_remove(F.split(F.lower(common.whole(text)), SEPARATORS, -1), "")
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(rows: DataFrame, lengths: Column | list[int], *keep: str) -> DataFrame:
    """rows with h (word hashes) to one row per position and mask: keep..., at, seed.

    lengths: those of the items whose masks are wanted, each at most WINDOW; or a column with a row's own.
    """
    # explode_outer, and the filter on its result: a filter on h would be moved down and hash every word twice.
    placed = rows.select(*dict.fromkeys([*keep, "h"]), F.explode_outer(F.sequence(F.lit(0), F.size("h") - 1)).alias("at")).where("at >= 0")
    keys = []
    for n in lengths if isinstance(lengths, list) else range(1, WINDOW + 1):
        for k, mask in enumerate(masks_of(n)):
            inside = F.col("at") + mask[-1] < F.size("h")
            if not isinstance(lengths, list):
                inside = inside & (lengths == n)
            keys.append(F.when(inside, F.xxhash64(F.lit(100 * n + k), *(F.get("h", F.col("at") + p) for p in mask))))
    return placed.select(*keep, "at", F.explode(F.array(*keys)).alias("seed")).where("seed IS NOT NULL")


def overlaps(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, body, item_id, agreeing, window, overlap: one row per document and item that it is contaminated by.

    agreeing of window words agree in the best stretch; overlap: words that agree along the whole item, on the
    best diagonal.
    """
    items = benchmark.select("item_id", word_hashes(F.col("text")).alias("h"))
    items = common.checkpointed(items.select("item_id", F.xxhash64("h").alias("item_key"), F.size("h").alias("length"), "h").where("length > 0"))
    window = F.least("length", F.lit(WINDOW))
    lengths = sorted(r[0] for r in items.select(window).distinct().collect())  # at most WINDOW numbers
    index = seeds(items, window, "item_key", "length").select("item_key", "length", F.col("at").alias("item_at"), F.col("seed").alias("item_seed")).distinct()
    index = common.checkpointed(index)
    texts = docs.select("doc_id", F.xxhash64(common.whole("text")).alias("body"), word_hashes(F.col("text")).alias("h"))
    if not lengths:
        texts = texts.limit(0)
    diagonal = F.col("at") - F.col("item_at")
    beside = F.slice("h", F.greatest(F.col("diagonal"), F.lit(0)) + 1, F.greatest(F.col("length") + F.least(F.col("diagonal"), F.lit(0)), F.lit(0)))
    own = ["doc_id", "body", "item_key", "diagonal"]
    if index.count() <= MAX_BROADCAST:
        hits = seeds(texts, lengths or [WINDOW], "doc_id", "body", "h").join(F.broadcast(index), F.col("seed") == F.col("item_seed"))
        hits = hits.select("doc_id", "body", "item_key", "length", "h", diagonal.alias("diagonal")).select(*own, beside.alias("beside"))
    else:
        hits = seeds(texts, lengths or [WINDOW], "doc_id", "body").join(index, F.col("seed") == F.col("item_seed"))
        hits = hits.select("doc_id", "body", "item_key", "length", diagonal.alias("diagonal")).distinct()
        words = texts.select(F.col("doc_id").alias("doc_id_"), F.col("body").alias("body_"), "h")
        hits = hits.join(words, F.col("doc_id").eqNullSafe(F.col("doc_id_")) & (F.col("body") == F.col("body_"))).select(*own, beside.alias("beside"))
    diagonals = hits.groupBy(*own).agg(F.first("beside").alias("beside"))
    laid = diagonals.join(items.select("item_id", F.col("item_key").alias("key"), F.col("h").alias("item")), F.col("item_key") == F.col("key"))
    skipped = F.greatest(-F.col("diagonal"), F.lit(0)).cast("int")
    same = F.transform("item", lambda w, i: F.coalesce((F.get("beside", i - skipped) == w) & (i >= skipped), F.lit(False)).cast("int"))
    laid = laid.select("doc_id", "body", "item_id", same.alias("same"))
    window = F.least(F.size("same"), F.lit(WINDOW))
    slid = F.aggregate(
        F.transform("same", lambda x, i: F.struct(x.alias("came"), F.when(i >= window, F.get("same", (i - window).cast("int"))).otherwise(0).alias("went"))),
        F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")),
        lambda acc, x: F.struct((acc["now"] + x["came"] - x["went"]).alias("now"), F.greatest(acc["best"], acc["now"] + x["came"] - x["went"]).alias("best")),
        lambda acc: acc["best"],
    )
    laid = laid.select("doc_id", "body", "item_id", slid.alias("agreeing"), window.alias("window"), F.aggregate("same", F.lit(0), lambda a, x: a + x).alias("overlap"))
    enough = F.get(F.array(*(F.lit(needed(n)) for n in range(WINDOW + 1))), F.col("window"))
    found = laid.where(F.col("agreeing") >= enough)
    return found.groupBy("doc_id", "body", "item_id").agg(*(F.max(c).cast("long").alias(c) for c in ("agreeing", "window", "overlap")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without those that any benchmark item contaminates."""
    found = overlaps(docs, benchmark).select(F.col("doc_id").alias("leak_id"), F.col("body").alias("leak_body")).distinct()
    found = common.sized(found, MAX_BROADCAST)
    # The row stands aside as one struct, so that no column of it can clash.
    rows = docs.select(F.struct("*").alias("row"), docs["doc_id"].alias("id"), F.xxhash64(common.whole(docs["text"])).alias("body"))
    return rows.join(found, F.col("id").eqNullSafe(F.col("leak_id")) & (F.col("body") == F.col("leak_body")), "left_anti").select("row.*")


def oracle_ctes(documents: str = "documents") -> str:
    """DuckDB: the table leaks (row of dr, doc_id, item_id, ...) over documents, from all pairs of equal words, without any seed."""
    list_words = lambda t: f"list_filter(string_split_regex(lower(coalesce({t}, '')), '{SEPARATORS}'), lambda x: x <> '')"
    enough = "[" + ", ".join(str(needed(n)) for n in range(1, WINDOW + 1)) + "]"
    return rf"""
dr AS (SELECT row_number() OVER () AS row, * FROM {documents}),
dw AS (SELECT row, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM (SELECT row, {list_words('text')} AS w FROM dr)),
bi AS (SELECT row_number() OVER () AS item, item_id, {list_words('text')} AS w FROM benchmark),
bw AS (SELECT item, unnest(w) AS word, generate_subscripts(w, 1) AS i, least(len(w), {WINDOW}) AS win, {enough}[CAST(least(len(w), {WINDOW}) AS BIGINT)] AS enough FROM bi),
ma AS (SELECT row, item, p - i AS diagonal, i, win, enough FROM dw JOIN bw ON dw.word = bw.word),
mf AS (SELECT *, count(*) OVER (PARTITION BY row, item, diagonal) AS along FROM ma QUALIFY along >= enough),
mo AS (SELECT *, count(*) OVER (PARTITION BY row, item, diagonal ORDER BY i RANGE BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS now FROM mf),
leaks AS (SELECT row, doc_id, item_id, CAST(max(now) AS BIGINT) AS agreeing, CAST(any_value(win) AS BIGINT) AS win, CAST(max(along) AS BIGINT) AS overlap FROM (
  SELECT row, item, diagonal, max(now) AS now, any_value(along) AS along, any_value(win) AS win, any_value(enough) AS enough FROM mo GROUP BY ALL HAVING max(now) >= any_value(enough))
  JOIN dr USING (row) JOIN bi USING (item) GROUP BY row, doc_id, item, item_id)"""


def oracle() -> str:
    return f"""
WITH {oracle_ctes()}
SELECT DISTINCT doc_id, item_id, agreeing, win AS "window", overlap FROM leaks"""
