import zlib

from loomlake.llm import common, quality


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    scored = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in scored)
    held = [r for r in scored if r.held_out]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored)
    good, bad = [r.score for r in held if r.quality == 1], [r.score for r in held if r.quality == 0]
    assert sum((g > b) + (g == b) / 2 for g in good for b in bad) / (len(good) * len(bad)) > 0.97
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95


def test_fit_is_the_same_again_and_ignores_held_out_labels(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    read = lambda ls, n: {r.doc_id: r.score for r in quality.score_quality(docs.repartition(n), ls).collect()}
    assert read(labels, 3) == read(turned, 5)


def test_paths_of_a_tree():
    text = "Tree\n  If (feature 0 <= 1.5)\n   If (feature 1 <= 2.0)\n    Predict: 0.0\n   Else (feature 1 > 2.0)\n    Predict: 1.0\n  Else (feature 0 > 1.5)\n   Predict: 1.0\n"
    names = list(quality.FEATURES)
    a, b = names[0], names[1]
    assert quality.tree_rules(text) == [((a, "<=", 1.5),), ((a, "<=", 1.5), (b, "<=", 2.0)), ((a, "<=", 1.5), (b, ">", 2.0)), ((a, ">", 1.5),)]
    assert quality.simplified(((a, "<=", 3.0), (a, "<=", 1.0), (b, ">", 0.0))) == tuple(sorted([(a, "<=", 1.0), (b, ">", 0.0)]))


def test_odd_rows(spark, odd, none, labels):
    scored = quality.score_quality(odd, labels).collect()
    assert len(scored) == odd.count() and all(0 < r.score < 1 for r in scored)
    assert quality.score_quality(none, labels).count() == 0
    unlabelled = quality.score_quality(odd, labels.limit(0)).collect()
    assert {r.score for r in unlabelled} == {0.5}
    kept = quality.filter_quality(odd, labels)
    assert kept.columns == odd.columns


def plain_features(text):
    """The measures of a text, taken in plain Python."""
    import math
    import re

    text = text or ""
    count = lambda chars: sum(c in chars for c in text)
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    chars, n, lines = len(text), len(words), text.count("\n") + 1
    share = lambda x: x / max(chars, 1)
    letters, figures = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    return {
        "log_chars": math.log1p(chars), "log_words": math.log1p(n), "beyond_ascii": share(len(text.encode()) - chars), "upper_share": share(count(letters)), "digit_share": share(count(figures)),
        "mark_share": share(count(".,;:'\"()-")), "symbol_share": share(count("#%*&$@^~=+<>\\/|_{}[]")), "shout_share": share(count("!?")), "line_words": n / max(lines, 1), "word_chars": chars / max(n, 1),
        "distinct_share": len(set(words)) / max(n, 1), "repeats": math.log1p(n - len(set(words))),
    }


def test_compiled_rules_equal_a_plain_evaluation(spark):
    import math

    sf = "/root/testdata/sf0.001"
    docs, labels = common.table(spark, sf, "documents"), common.table(spark, sf, "labels")
    intercept, rules = quality.fit_rules(quality.training_rows(docs, labels))
    assert rules and any(len(r) > 1 for r, _ in rules)
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.score_quality(docs, labels).collect():
        x = plain_features(texts[r.doc_id])
        held = lambda rule: all(x[f] <= v if side == "<=" else x[f] > v for f, side, v in rule)  # noqa: B023, E731
        total = intercept + sum(w for rule, w in rules if held(rule))
        assert abs(r.score - 1 / (1 + math.exp(-total))) < 1e-9


def test_rows_that_repeat_an_id_are_learnt_from_once(spark):
    from pyspark.sql import functions as F

    docs = spark.range(2000).select(F.lit(1).cast("long").alias("doc_id"), F.concat(F.lit("text "), "id").alias("text"))
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert quality.training_rows(docs, labels).count() == 1
