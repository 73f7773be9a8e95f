"""Word pieces by joins against the helper that goes a word at a time."""

import pytest
from pyspark.sql import functions as F

from loomlake.functions import wordpiece

PIECES = ["[PAD]", "[UNK]", "[CLS]", "[SEP]", "a", "ab", "abc", "##c", "##cd", "##d", "cafe", "##s", "un", "##do", ".", "##able", "unable", "字", "ab", "zu", "##"]
TEXTS = ["abcd abccd. Cafés UNDO unable", "", None, " \t\n", "字ab字", "zebra abx", "a" * 120, "ab " * 600, "Ünable\x00 ab\u00adc é", "(ab.cd)"]


@pytest.mark.parametrize("limit", [512, 6])
def test_joins_equal_the_helper(spark, limit):
    vocab = spark.createDataFrame([("\n".join(PIECES),)], "value string")
    table = wordpiece.vocabulary_table(vocab)
    df = spark.createDataFrame(list(enumerate(TEXTS)), "k long, t string")
    known = wordpiece.vocabulary(PIECES)
    got = {r.k: r.ids for r in wordpiece.encoded(df, ["k"], F.col("t"), table, limit).collect()}
    assert got == {k: wordpiece.encode(t, known, limit) for k, t in enumerate(TEXTS)}
    split = {r.k: r.w for r in df.select("k", wordpiece.split_words(F.col("t")).alias("w")).collect()}
    assert split == {k: wordpiece.words_of(t or "") for k, t in enumerate(TEXTS)}


def test_a_vocabulary_without_special_pieces(spark):
    with pytest.raises(ValueError, match="UNK"):
        wordpiece.word_pieces(spark.createDataFrame([("a",)], "word string"), spark.createDataFrame([("a", 1)], "piece string, id int"))


def test_listed_pieces(spark):
    df = spark.createDataFrame([("bb aa bb",), ("c aa bb",)], "t string")
    value = wordpiece.listed_pieces(df, F.col("t"), 1).first().value.split("\n")
    assert value[:4] == list(wordpiece.SPECIAL) and value[-1] == "bb" and set(value[4:-1]) == {"a", "b", "c", "##a", "##b", "##c"}


def _jobs(spark, group, work):
    spark.sparkContext.setJobGroup(group, group)
    try:
        out = work()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_jobs_do_not_grow_with_the_pieces_of_a_word(spark):
    vocab = spark.createDataFrame([(p, k) for k, p in enumerate([*wordpiece.SPECIAL, "a", "##a", "##ab"])], "piece string, id int").localCheckpoint()
    ids, jobs = {}, {}
    for n in (2, 90):
        words = spark.createDataFrame([("a" * n,), ("a" * (n - 1) + "b",), ("b",), ("a" * 101,)], "word string").localCheckpoint()
        got, jobs[n] = _jobs(spark, f"pieces of {n}", lambda words=words: wordpiece.word_pieces(words, vocab).collect())
        ids[n] = {r.word: r.ids for r in got}
    assert ids[90] == {"a" * 90: [4, *[5] * 89], "a" * 89 + "b": [4, *[5] * 87, 6], "b": [1], "a" * 101: [1]}
    assert ids[2] == {"aa": [4, 5], "ab": [1], "b": [1], "a" * 101: [1]}
    assert jobs[90] == jobs[2]


def test_a_vocabulary_without_later_pieces(spark):
    vocab = spark.createDataFrame([(p, k) for k, p in enumerate([*wordpiece.SPECIAL, "ab", "##"])], "piece string, id int")
    words = spark.createDataFrame([("ab", 7), ("abab", 8), ("##", 9)], "word string, n int")
    assert {(r.word, r.n): r.ids for r in wordpiece.word_pieces(words, vocab).collect()} == {("ab", 7): [4], ("abab", 8): [1], ("##", 9): [5]}


def test_the_words_of_a_text_are_those_of_its_stretches(spark):
    texts = [*TEXTS, "a\u001cb C\u0085d e\x0bf\x0cg\rh  i", "ΟΔΟΣ ΟΔΟΣ. Σ", "İx́ ́ ​", "x" * 9000, " lead trail "]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = wordpiece.stretches(df, F.col("t")).select(F.explode(wordpiece.split_words(F.col("stretch"))).alias("w"), "n").groupBy("w").agg(F.sum("n").alias("n"))
    want = df.select(F.explode(wordpiece.split_words(F.col("t"))).alias("w")).groupBy("w").count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_blocks_of_texts(spark):
    vocab = spark.createDataFrame([("\n".join(PIECES),)], "value string")
    known, table = wordpiece.vocabulary(PIECES), wordpiece.vocabulary_table(vocab)
    # More words than a block holds, in one partition; the texts differ in length, and some have no word.
    n = F.col("id").cast("int")
    df = spark.range(0, 900, 1, 1).select(F.when(n > 0, n).alias("k"), F.when(n % 50 != 7, F.repeat(F.lit("ab abcd zu. "), n % 200)).alias("t"))
    got = wordpiece.encoded(df, ["k"], F.col("t"), table).collect()
    texts = {r.k: r.t for r in df.collect()}
    assert len(got) == 900 and {r.k: r.ids for r in got} == {k: wordpiece.encode(t, known) for k, t in texts.items()}
    assert sum(min(len(wordpiece.words_of(t or "")), 510) for t in texts.values()) > 2 * wordpiece.TOKENS


def test_texts_without_words(spark):
    table = wordpiece.vocabulary_table(spark.createDataFrame([("\n".join(PIECES),)], "value string"))
    df = spark.createDataFrame([(1, "x", ""), (1, None, None), (None, None, " \n")], "a long, b string, t string")
    for rows, want in ((df, [(1, "x"), (1, None), (None, None)]), (df.where("false"), [])):
        got = wordpiece.encoded(rows, ["b", "a"], F.col("t"), table)
        assert got.columns == ["b", "a", "ids"]
        assert {(r.a, r.b, *r.ids) for r in got.collect()} == {(*k, 2, 3) for k in want}
