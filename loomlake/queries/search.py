"""Searches in a stored index of all documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomlake.operators import search as ops
from loomlake.registry import query
from loomlake.session import checkpointed, scratch
from loomlake.sources import folders
from loomlake.sources.tables import table

TERMS, PHRASE = ["licensed", "the", "warranty"], ["licensed", "under", "the"]
_WORDS = rf"w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '{ops.NOT_TERM}'), lambda x: x <> '') AS t FROM documents)"


def _searched(spark: SparkSession, sf_dir: str, search) -> DataFrame:
    folder = scratch(spark, "index")
    ops.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", folder)
    found = checkpointed(search(folder).withColumnRenamed("key", "doc_id"))
    folders.remove(spark, folder)
    return found


@query(f"""WITH {_WORDS}, l AS (SELECT doc_id, len(t) AS length FROM w), s AS (SELECT count(*) AS n, avg(length) AS mean FROM l),
p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM w) WHERE term IN ({', '.join(map(repr, TERMS))}) GROUP BY ALL), d AS (SELECT term, count(*) AS df FROM p GROUP BY term)
SELECT doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {ops.K1 + 1} / (tf + {ops.K1} * ({1 - ops.B} + {ops.B} * length / mean))), 6) AS score FROM p JOIN d USING (term) JOIN l USING (doc_id), s GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 50""")
def text_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fifty best documents for three terms by BM25, from an index stored in buckets."""
    return _searched(spark, sf_dir, lambda folder: ops.ranked(spark, folder, TERMS, 50))


@query(f"""WITH {_WORDS}, x AS (SELECT doc_id, t, unnest(range(1, len(t) - {len(PHRASE) - 2})) AS i FROM w)
SELECT doc_id, count(*) AS n, min(i) - 1 AS first FROM x WHERE {' AND '.join(f"t[i + {k}] = '{t}'" for k, t in enumerate(PHRASE))} GROUP BY doc_id""")
def phrase_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a phrase, how often and where first, by the positions of the index."""
    return _searched(spark, sf_dir, lambda folder: ops.phrases(spark, folder, PHRASE))
