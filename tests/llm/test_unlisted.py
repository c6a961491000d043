"""Mixing where languages are missing from the targets, or null."""

import numpy as np

from editstrata.llm import source_mixing


def test_unlisted_and_null_languages(spark):
    langs = ["en"] * 5 + ["de"] * 3 + ["it"] * 2 + [None] * 2
    rows = [(k, "word " * (20 + k % 7) + ("License" if k % 3 else ""), langs[k % 12], f"s{k % 5}") for k in range(1200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = source_mixing.mixture(docs).toPandas()
    assert len(got) == 1200 and (got.probability > 0).all()
    present = got.groupby("lang").n_tokens.sum() / got.n_tokens.sum()
    weight = got.drop_duplicates(list(source_mixing.TARGETS)).groupby("lang").weight.sum()
    left = 1 - present["it"] - present["(none)"]
    want = {"it": present["it"], "(none)": present["(none)"], "en": left * 0.5 / 0.7, "de": left * 0.2 / 0.7}
    assert all(np.isclose(weight[k], v, atol=1e-4) for k, v in want.items())
    kept = source_mixing.sampled(docs).toPandas()
    assert set(kept.doc_id) == set(got[got.kept].doc_id) and {"it", "en", "de"} <= set(kept.lang.dropna()) and kept.lang.isna().any()


def test_only_unlisted(spark):
    docs = spark.createDataFrame([(k, "one two three", None, "s") for k in range(200)], "doc_id long, text string, lang string, source string")
    assert (source_mixing.mixture(docs).toPandas().probability > 0).all() and source_mixing.sampled(docs).count() > 0


def test_zero_target(spark):
    """A value that is listed with 0 is left out as asked for."""
    docs = spark.createDataFrame([(k, "one two three", "en" if k % 2 else "de", "s") for k in range(200)], "doc_id long, text string, lang string, source string")
    got = source_mixing.mixture(docs, {"lang": {"en": 1.0, "de": 0.0}}).toPandas()
    assert (got[got.lang == "en"].probability > 0).all() and (got[got.lang == "de"].probability == 0).all()
