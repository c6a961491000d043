"""Helpers of the tests for training text."""

import pytest


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture
def odd(spark):
    """Null and empty texts, a null id, repeated rows and a clashing column."""
    long = "word " * 30000
    rows = [(1, None, "x"), (2, "", None), (3, "one", "y"), (4, "a b c d e f g", None), (4, "a b c d e f g", None), (None, "a b c d e f g", "z"), (5, long, "x"), (6, " \t\n", "x")]
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash") for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string")
