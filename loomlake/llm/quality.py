"""Quality classifier: a sparse rule ensemble.

A forest of shallow trees is grown on statistics of the texts; every path from a root to a node becomes a
conjunctive rule; a logistic regression with lasso penalty weighs the rules, most of them with zero; and what is
left is compiled into one Spark column expression over the statistics. Scoring a corpus is a map.

Fitting uses at most TRAIN_ROWS labelled rows outside the held-out fold, those with the smallest hashes of their
ids; nothing else is bounded. Only the ids of that sample are broadcast (8 bytes each). The fold is fixed: rows
whose crc32(doc_id as text) mod 3 is 1 are never learnt from. Labels, lang, source and doc_id are no inputs.

Edge cases: a null text is empty and is scored like any other; very long texts are measured whole; null labels
are not learnt from, of repeated labels the worst counts; rows that repeat a doc_id are scored each, and the one
with the smallest hash of its text is learnt from; a null doc_id is not held out; without labels every score is one half, with labels of one kind it is their smoothed
share; an empty table gives an empty result; other columns are kept by filter_quality and ignored by score_quality.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

TRAIN_ROWS = 16_384
TREES, TREE_DEPTH, LASSO, SEED = 24, 3, 0.002, 7

Rule = tuple[tuple[str, str, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Measures of a whole text; text must be a plain column, as each is used several times."""
    without = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    words = F.array_remove(F.split(text, f"[{common.SPACE}]+", -1), "")
    return {
        "chars": F.char_length(text).cast("double"),
        "bytes": F.octet_length(text).cast("double"),
        "upper": without("[A-Z]+").cast("double"),
        "digits": without("[0-9]+").cast("double"),
        "marks": without("[.,;:'\"()-]+").cast("double"),
        "symbols": without(r"[#%*&$@^~=+<>\\/|_{}\[\]]+").cast("double"),
        "shouts": without("[!?]+").cast("double"),
        "lines": F.size(F.split(text, "\n", -1)).cast("double"),
        "words": F.size(words).cast("double"),
        "distinct": F.size(F.array_distinct(words)).cast("double"),
    }


FEATURES = {
    "log_chars": lambda: F.log1p("chars"),
    "log_words": lambda: F.log1p("words"),
    "beyond_ascii": lambda: (F.col("bytes") - F.col("chars")) / F.greatest("chars", F.lit(1.0)),
    "upper_share": lambda: F.col("upper") / F.greatest("chars", F.lit(1.0)),
    "digit_share": lambda: F.col("digits") / F.greatest("chars", F.lit(1.0)),
    "mark_share": lambda: F.col("marks") / F.greatest("chars", F.lit(1.0)),
    "symbol_share": lambda: F.col("symbols") / F.greatest("chars", F.lit(1.0)),
    "shout_share": lambda: F.col("shouts") / F.greatest("chars", F.lit(1.0)),
    "line_words": lambda: F.col("words") / F.greatest("lines", F.lit(1.0)),
    "word_chars": lambda: F.col("chars") / F.greatest("words", F.lit(1.0)),
    "distinct_share": lambda: F.col("distinct") / F.greatest("words", F.lit(1.0)),
    "repeats": lambda: F.log1p(F.col("words") - F.col("distinct")),
}


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, body (hash of the text) and the features."""
    docs = docs.select("doc_id", common.whole("text").alias("text"))
    measured = docs.select("doc_id", F.xxhash64("text").alias("body"), *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    return measured.select("doc_id", "body", *(f().cast("double").alias(k) for k, f in FEATURES.items()))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def tree_rules(description: str) -> list[Rule]:
    """All paths from the root to a node, of a tree as Spark prints it."""
    found, path = [], []
    for line in description.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if m:
            level = len(m[1]) // 1
            path = [x for x in path if x[0] < level] + [(level, (list(FEATURES)[int(m[2])], m[3], float(m[4])))]
            found.append(tuple(x[1] for x in path))
    return found


def simplified(rule: Rule) -> Rule:
    """The tightest bound of each feature and side, in a fixed order."""
    bounds: dict[tuple[str, str], float] = {}
    for name, side, value in rule:
        old = bounds.get((name, side), value)
        bounds[name, side] = min(old, value) if side == "<=" else max(old, value)
    return tuple(sorted((n, s, v) for (n, s), v in bounds.items()))


def condition(rule: Rule) -> Column:
    holds = F.lit(True)
    for name, side, value in rule:
        holds = holds & (F.col(name) <= value if side == "<=" else F.col(name) > value)
    return holds


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Features and label of at most so many labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.min("quality").cast("double").alias("label"))
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows).withColumnRenamed("doc_id", "known_id")
    texts = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("known_id"))
    chosen = with_features(texts).join(F.broadcast(sample), F.col("doc_id") == F.col("known_id"))
    # Of rows that repeat an id one is learnt from, so that no more than so many rows are, and the same in every run.
    chosen = chosen.groupBy("doc_id", "label").agg(F.min(F.struct("body", *FEATURES)).alias("row")).select("doc_id", "label", "row.*")
    # One partition in a fixed order, so that the fit is the same; its size is bounded by rows.
    return common.checkpointed(chosen.repartition(1).sortWithinPartitions("doc_id"))


def fit_rules(train: DataFrame) -> tuple[float, list[tuple[Rule, float]]]:
    """Intercept and weighted rules; without two kinds of labels, the smoothed share alone."""
    rows, good = train.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if good in (0, rows):
        import math

        share = (good + 1) / (rows + 2)
        return math.log(share / (1 - share)), []
    train = train.withColumn("features", array_to_vector(F.array(*FEATURES)))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=TREE_DEPTH, maxBins=64, minInstancesPerNode=8, featureSubsetStrategy="onethird", seed=SEED).fit(train)
    rules = sorted({simplified(r) for tree in forest.trees for r in tree_rules(tree.toDebugString)})
    held = array_to_vector(F.array(*(condition(r).cast("double") for r in rules)))
    fit = LogisticRegression(regParam=LASSO, elasticNetParam=1.0, standardization=False, maxIter=60).fit(train.select("label", held.alias("features")))
    return float(fit.intercept), [(r, float(w)) for r, w in zip(rules, fit.coefficients, strict=True) if w]


def compiled(intercept: float, rules: list[tuple[Rule, float]]) -> Column:
    """The ensemble as one column over the features: the chance of label 1."""
    total = F.lit(intercept)
    for rule, weight in rules:
        total = total + F.when(condition(rule), weight).otherwise(0.0)
    return 1.0 / (1.0 + F.exp(-total))


def score_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, body, held_out, score, predicted per document, by rules learnt from these documents and labels."""
    score = compiled(*fit_rules(training_rows(docs, labels, rows)))
    scored = with_features(docs).select("doc_id", "body", held_out(F.col("doc_id")).alias("held_out"), score.alias("score"))
    return scored.select("*", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def filter_quality(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """docs that are predicted to be of quality 1; a map over the documents, with no shuffle of texts."""
    score = compiled(*fit_rules(training_rows(docs, labels, rows)))
    # The row stands aside as one struct, so that no column of it can clash with a measure.
    measured = docs.select(F.struct("*").alias("row"), common.whole(docs["text"]).alias("text"))
    measured = measured.select("row", *(c.alias(k) for k, c in statistics(F.col("text")).items()))
    # A filter is moved below projections, with a copy of its inputs for each use; a position that the filter reads
    # keeps it above, so that every measure is taken once a text.
    measured = measured.select("row", *(f().cast("double").alias(k) for k, f in FEATURES.items()), F.monotonically_increasing_id().alias("position"))
    return measured.where((score >= 0.5) & (F.col("position") >= 0)).select("row.*")
