"""WordPiece: greedy longest matches of a given vocabulary, as a join over distinct words or as a helper in Arrow batches.

The vocabulary is a table (piece, id), read from a file or listed; nothing is trained here. encoded() matches each distinct word once:
all stretches of it that a piece can be as long as meet the vocabulary in one join, and a walk over those found takes the longest at each
place that it comes to; texts then take their words' pieces. wordpiece() does the same within a task, a word at a time, for a text or two.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from loomlake.session import checkpointed, sized

WORD_CHARS_MAX = 100
SPECIAL = ("[PAD]", "[UNK]", "[CLS]", "[SEP]")


def vocabulary(lines: list[str]) -> dict[str, int]:
    """Ids by line; of a repeated piece the first id counts; the special pieces must be there."""
    out: dict[str, int] = {}
    for k, line in enumerate(lines):
        out.setdefault(line.rstrip("\n"), k)
    if missing := [s for s in SPECIAL if s not in out]:
        raise ValueError(f"pieces that a vocabulary needs: {missing}")
    return out


def vocabulary_table(lines: DataFrame) -> DataFrame:
    """The same as a table of (value, id) rows, from a text read whole."""
    pieces = lines.select(F.posexplode(F.split("value", "\n")).alias("id", "piece")).where("piece <> ''")
    return pieces.groupBy("piece").agg(F.min("id").alias("id"))


def _breaks(c: str) -> bool:
    return unicodedata.category(c).startswith("P") or (c < "\x80" and not c.isalnum() and not c.isspace()) or 0x3400 <= ord(c) <= 0x9FFF or 0xF900 <= ord(c) <= 0xFAFF


def words_of(text: str) -> list[str]:
    """Cleaned, lower-cased, without accents; split at white space, punctuation and ideographs."""
    clean = "".join(" " if c.isspace() else c for c in text if c.isspace() or not unicodedata.category(c).startswith("C"))
    plain = "".join(c for c in unicodedata.normalize("NFD", clean.lower()) if unicodedata.category(c) != "Mn")
    return "".join(f" {c} " if _breaks(c) else c for c in plain).split()


def pieces_of(word: str, vocab: dict[str, int]) -> list[int]:
    """Greedy longest match; the unknown piece if a rest has none, or the word is too long."""
    out, start = [], 0
    if len(word) > WORD_CHARS_MAX:
        return [vocab["[UNK]"]]
    while start < len(word):
        for stop in range(len(word), start, -1):
            if (k := vocab.get(("##" if start else "") + word[start:stop])) is not None:
                out.append(k)
                start = stop
                break
        else:
            return [vocab["[UNK]"]]
    return out


def encode(text: str | None, vocab: dict[str, int], limit: int = 512) -> list[int]:
    ids = [k for w in words_of(text or "") for k in pieces_of(w, vocab)][: limit - 2]
    return [vocab["[CLS]"], *ids, vocab["[SEP]"]]


def wordpiece(vocab: dict[str, int], limit: int = 512) -> Column:
    """A pandas UDF over texts; the vocabulary goes with it once per executor."""

    @F.pandas_udf("array<int>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield texts.map(lambda t: encode(t, vocab, limit))

    return run


#: Pieces of a vocabulary that are broadcast at most.
PIECES_MAX = 1_000_000
#: Texts whose stretches are counted together within a task.
ROWS = 4096
#: Words of a block of texts, or a single text.
TOKENS = 1 << 17
#: Letters with accents that have a plain letter as their base, by Unicode's own decompositions.
ACCENTED = "".join(chr(c) for c in range(0xC0, 0x250) if unicodedata.normalize("NFD", chr(c))[0] < "\x80" and len(unicodedata.normalize("NFD", chr(c))) > 1)
PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in ACCENTED)
#: What stands alone: punctuation, other marks of ASCII, ideographs.
ALONE = r"([\p{P}!-/:-@\[-`{-~\u3400-\u9FFF\uF900-\uFAFF])"


def split_words(text: Column) -> Column:
    """words_of() as a column expression, for accents of Latin letters up to U+024F and combining marks."""
    clean = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)[\p{C}&&[^\s]]", "")
    plain = F.regexp_replace(F.translate(F.lower(clean), ACCENTED, PLAIN), r"\p{Mn}", "")
    return F.filter(F.split(F.regexp_replace(plain, ALONE, " $1 "), r"(?U)\s+", -1), lambda w: w != "")


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """stretch, n: what lies between white space of ASCII in the texts of some rows, each as often as it is there."""
    for batch in batches:
        for at in range(0, len(batch), ROWS):
            found = pc.value_counts(pc.ascii_split_whitespace(batch.column(0).slice(at, ROWS)).flatten())
            yield pa.RecordBatch.from_arrays([found.field("values"), found.field("counts")], ["stretch", "n"])


def stretches(texts: DataFrame, text: Column) -> DataFrame:
    """stretch, n: all texts cut at white space of ASCII, and counts. The words of a text are those of its stretches in turn, and there are far fewer distinct ones."""
    return texts.select(text.alias("text")).mapInArrow(_stretches, "stretch string, n long").groupBy("stretch").agg(F.sum("n").alias("n"))


def word_pieces(words: DataFrame, vocab: DataFrame) -> DataFrame:
    """words (distinct, and what columns stand beside them) with ids: the longest piece that begins each, then the longest that goes on, marked by ##; unknown if some rest has none."""
    vocab = sized(vocab.select(F.col("piece"), F.col("id").cast("int").alias("id")), PIECES_MAX)
    special = {r.piece: r.id for r in vocab.where(F.col("piece").isin(*SPECIAL)).collect()}
    if missing := [s for s in SPECIAL if s not in special]:
        raise ValueError(f"pieces that a vocabulary needs: {missing}")
    unknown = F.array(F.lit(special["[UNK]"]))
    first, later = vocab.agg(F.max(F.char_length("piece")), F.coalesce(F.max(F.when(F.col("piece").startswith("##"), F.char_length("piece") - 2)), F.lit(0))).first()
    n = F.char_length("word")
    fits = n.between(1, WORD_CHARS_MAX)
    starts = words.where(fits).select(*words.columns, F.explode(F.sequence(F.lit(0), F.least(n - 1, F.lit(WORD_CHARS_MAX if later else 0)))).alias("at"))
    tried = starts.withColumn("length", F.explode(F.sequence(F.lit(1), F.least(n - F.col("at"), F.when(F.col("at") > 0, max(later, 1)).otherwise(first)))))
    tried = tried.withColumn("own", F.concat(F.when(F.col("at") > 0, "##").otherwise(""), F.substr("word", F.col("at") + 1, F.col("length"))))
    found = tried.join(vocab, F.col("own") == F.col("piece"), "left")
    # One row of each word stays in any case.
    found = found.where(F.col("id").isNotNull() | ((F.col("at") == 0) & (F.col("length") == 1)))
    # At a place the longest comes first.
    best = found.groupBy(*words.columns).agg(F.sort_array(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("at", (-F.col("length")).alias("less"), "id")))).alias("found"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ids"))
    taken = lambda own, x: F.struct((x["at"] - x["less"]).alias("at"), F.concat(own["ids"], F.array(x["id"])).alias("ids"))
    walked = best.withColumn("walk", F.aggregate("found", start, lambda own, x: F.when(x["at"] == own["at"], taken(own, x)).otherwise(own)))
    ids = F.when(F.col("walk.at") == n, F.col("walk.ids")).otherwise(unknown)
    return walked.select(*words.columns, ids.alias("ids")).unionByName(words.where(~fits).select(*words.columns, unknown.alias("ids")))


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """block, of, codes, words: some texts (of, words) at a time, whose words are coded by the block's distinct ones."""
    block = TaskContext.get().partitionId() << 32
    for batch in batches:
        before = np.r_[0, np.cumsum(pc.list_value_length(batch.column("words")).to_numpy())]
        at = 0
        while at < len(batch):
            end = max(at + 1, int(np.searchsorted(before, before[at] + TOKENS, "right")) - 1)
            own = batch.slice(at, end - at)
            coded = own.column("words").flatten().dictionary_encode()
            codes = pa.ListArray.from_arrays(pa.array(before[at : end + 1] - before[at], pa.int32()), coded.indices)
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), _list(own.column("of")), _list(codes), _list(coded.dictionary)], ["block", "of", "codes", "words"])
            at, block = end, block + 1


def _decoded(limit: int, first: int, last: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """of, ids: the texts of a block (of, codes) by its words' pieces (at, ids)."""

    def run(texts: pa.Table, words: pa.Table) -> pa.Table:
        of, codes = (texts.column(c).combine_chunks().flatten() for c in ("of", "codes"))
        words = words.sort_by("at").column("ids").combine_chunks()
        pieces = words.take(codes.flatten())
        ids = pieces.flatten().to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False))]
        ends = ends[np.r_[0, np.cumsum(pc.list_value_length(codes).to_numpy())]].astype(np.int64)
        n = np.minimum(np.diff(ends), limit - 2)
        to = np.r_[0, np.cumsum(n + 2)]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        out = np.empty(to[-1], np.int32)
        out[to[:-1]], out[to[1:] - 1] = first, last
        out[within + np.repeat(to[:-1] + 1, n)] = ids[within + np.repeat(ends[:-1], n)]
        return pa.table([of, pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(out))], ["of", "ids"])

    return run


def encoded(texts: DataFrame, key: list[str], text: Column, vocab: DataFrame, limit: int = 512) -> DataFrame:
    """key, ids of every text: the first and last piece of a text around at most limit - 2 others. Keys are unique.

    A block of texts brings each of its words to the join once, however often it is there.
    """
    # No more words than pieces can count.
    rows = texts.select(F.struct(*key).alias("of"), F.slice(split_words(text), 1, limit - 2).alias("words"))
    of = rows.schema["of"].dataType
    whole = StructType([StructField("block", LongType()), StructField("of", ArrayType(of)), StructField("codes", ArrayType(ArrayType(IntegerType()))), StructField("words", ArrayType(StringType()))])
    blocks = checkpointed(rows.mapInArrow(_blocks, whole))
    words = blocks.select("block", F.posexplode("words").alias("at", "word"))
    pieces = word_pieces(checkpointed(words.select("word").distinct()), vocab)
    ends = {r.piece: r.id for r in vocab.where(F.col("piece").isin("[CLS]", "[SEP]")).collect()}
    own = words.join(pieces, "word").select(F.col("block").alias("home"), "at", "ids").groupBy("home")
    run = _decoded(limit, ends["[CLS]"], ends["[SEP]"])
    found = blocks.select("block", "of", "codes").groupBy("block").cogroup(own).applyInArrow(run, StructType([StructField("of", of), StructField("ids", ArrayType(IntegerType()))]))
    return found.select(*(F.col("of")[k].alias(k) for k in key), "ids")


def listed_pieces(texts: DataFrame, text: Column, words: int = 4096) -> DataFrame:
    """value: a plain list of pieces, a line each, in one text: the special ones, all characters, and the words seen most. By counts alone: a stand-in for a vocabulary file, for want of one."""
    # Splitting costs most, so each distinct stretch is split once.
    seen = checkpointed(stretches(texts, text).select(F.explode(split_words(F.col("stretch"))).alias("word"), "n").groupBy("word").agg(F.sum("n").alias("n")))
    most = seen.where(F.char_length("word") > 1).orderBy(F.desc("n"), "word").limit(words).select(F.lit(2).alias("kind"), (-F.col("n")).alias("rank"), F.col("word").alias("piece"))
    letters = seen.select(F.explode(F.split("word", "")).alias("c")).distinct()
    singles = letters.select(F.lit(1).alias("kind"), F.lit(0).cast("long").alias("rank"), F.explode(F.array("c", F.concat(F.lit("##"), "c"))).alias("piece"))
    special = texts.sparkSession.createDataFrame([(0, k, p) for k, p in enumerate(SPECIAL)], "kind int, rank long, piece string")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("kind", "rank", "piece"))), lambda x: x["piece"])
    return special.unionByName(singles).unionByName(most).agg(F.array_join(lines, "\n").alias("value"))  # bounded by words and the alphabet
