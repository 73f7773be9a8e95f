import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent.parent))

LONG = "word of a very long text, " * 20_000
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, words string, row string, fp string, score double"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in any column, empty and very long texts, repeated rows, and columns whose names clash."""
    def row(doc_id, text, lang="en", source="s"):
        return (doc_id, text, lang, source, len(text or ""), 1, "x", "y", "z", 0.5)

    rows = [row(1, None), row(2, ""), row(3, " \n\t\n"), row(4, LONG), row(5, "same text here"), row(5, "same text here"), row(6, "same text here"), row(None, "a text without an id"), row(None, None, None, None), row(7, "x", None, None), row(8, "Ünïcödé 文字\n文字 only")]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark, odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (5, 1, None), (None, 1, 0), (6, None, None), (5, 0, 0)], "doc_id long, quality int, toxic int")
