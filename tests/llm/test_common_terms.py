"""Benchmarks whose terms are all common: few items, equal items and items that share a template."""

import pytest

from editstrata.llm import decontamination

WORDS = "amber basin cedar delta ember fjord grove heron islet jetty knoll larch mound north ocean pearl quail ridge slope tower umbra vault wheat xenon yield zebra".split()


def item(k):
    return " ".join(WORDS[(k * 5 + j * (k + 1)) % 26] + str(k) for j in range(18))


def found(spark, items):
    """(doc_id, item_id) of documents that hold each item's text word for word, and the ids that clean() keeps."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1000 + k, f"before it {t} and after") for k, (_, t) in enumerate(items)] + [(1, "nothing of any of these is held by this text")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in decontamination.clean(frame, bench).collect()}
    return {(r.doc_id, r.item_id) for r in decontamination.contaminations(frame, bench).collect()}, kept


@pytest.mark.parametrize("n", [1, 2, 3, 4])
def test_few_items(spark, n):
    got, kept = found(spark, [(k, item(k)) for k in range(n)])
    assert got == {(1000 + k, k) for k in range(n)} and kept == {1}


def test_equal_items(spark):
    items = [(k, item(0) if k % 3 == 0 else item(k)) for k in range(24)]
    got, kept = found(spark, items)
    same = range(0, 24, 3)
    assert got == {(1000 + a, b) for a in same for b in same} | {(1000 + k, k) for k in range(24) if k % 3} and kept == {1}


def test_template(spark):
    """A third of the items are the same words in eight orders."""
    words = item(0).split()
    orders = [" ".join(words[k:] + words[:k]) for k in range(8)]
    items = list(enumerate(orders + [item(k) for k in range(1, 17)]))
    got, kept = found(spark, items)
    assert {(1000 + k, k) for k in range(24)} <= got and kept == {1}
