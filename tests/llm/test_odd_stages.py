"""The pipeline's stages on odd rows: nulls, empty and long texts, repeated rows, ties, clashing columns, empty tables."""

import pytest

import corpus_pipeline
from editstrata.llm._store import written

CLASHES = ["_row", "row", "kept", "first", "fp", "component_id", "_cell_lang", "_probability", "weight", "probability", "shard", "slot", "size", "features", "doc_id_"]


@pytest.fixture(scope="module")
def table(spark):
    prose = " ".join(f"word{k} holds another{k % 7} thing{k % 11} of note." for k in range(60))
    long = " ".join(f"token{k}" for k in range(60_000))
    rows = [(1, None, "en", "a"), (2, "", None, None), (3, "one", "xx", "a"), (4, prose, "en", "a"), (4, prose, "en", "a"), (5, prose, "en", "b"), (None, prose, None, "a"), (6, long, "de", "a"), (7, " \t\n", "en", "a"), (8, prose.replace("word", "term"), "fr", None)]
    return spark.createDataFrame([(*r, len(r[1] or ""), *([f"c{k}"] * len(CLASHES))) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stage(spark, sf_dir, table, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    before = {tuple(r) for r in table.collect()}
    after = stage(spark, table, sf_dir)
    rows = after.collect()
    if name != "sharding":
        assert after.columns == table.columns and {tuple(r) for r in rows} <= before
    ids = sorted((r.doc_id for r in rows), key=str)
    if name == "quality_rules":
        assert {1, 2, 3, 7}.isdisjoint(ids)
    elif name == "minhash_dedup":
        assert ids == sorted([1, 2, 3, 4, 6, 7, 8], key=str)
    elif name == "decontamination":
        assert len(rows) == 10
    elif name == "sharding":
        assert len(rows) == 10 and after.columns == ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert stage(spark, table.limit(0), sf_dir).count() == 0


def test_stages_one_after_another(spark, sf_dir, table):
    docs = table
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        assert docs.columns == table.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == docs.count()
