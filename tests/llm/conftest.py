import pytest
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "alpha beta gamma delta " * 30_000


@pytest.fixture(scope="session")
def docs(spark):
    """A documents table from ``(doc_id, text)`` pairs."""

    def build(rows, partitions=3):
        full = [(i, t, None if t is None else "en", "web", len(t or "")) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def awkward(docs):
    """Nulls in every column, empty and very long texts, repeated rows, clashing extra columns."""
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, LONG), (4, LONG), (None, "some text here"), (5, "日本語 😀 é"), (6, "a\x00b")]
    clashing = "n_tokens n_bytes words word family part slice h low high k node score shard slot curve kept n_words item_id root t u".split()
    return docs(rows).withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="session")
def nothing(docs):
    return docs([])


def rows_of(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}
