"""The risk of positive and unlabelled texts against its definition, and the fit by rounds against a fit that sees all texts at once."""

import numpy as np
import pyarrow as pa

from editstrata.llm import toxicity
from editstrata.llm.toxicity import LEVELS, Rows


def lists(rng, n, words):
    return [sorted({int(w) * len(LEVELS) + int(rng.integers(0, len(LEVELS))) for w in rng.choice(words, rng.integers(0, 4), replace=False)}) for _ in range(n)]


def dense(packed, words):
    x = np.zeros((len(packed), words * len(LEVELS) + 1))
    x[:, -1] = 1
    for row, codes in enumerate(packed):
        for c in codes:
            x[row, c - c % len(LEVELS) : c + 1] = 1
    return x


def objective(w, p, u, prior, ridge=1e-4):
    s = lambda z: 1 / (1 + np.exp(-z))
    negative = np.mean(-np.log(1 - s(u @ w))) - prior * np.mean(-np.log(1 - s(p @ w)))
    return prior * np.mean(-np.log(s(p @ w))) + max(0.0, negative) + ridge / 2 * float(w[:-1] @ w[:-1])


def test_losses_and_gradients():
    rng = np.random.default_rng(3)
    packed = lists(rng, 50, 6)
    rows, x = Rows.of(pa.array(packed, pa.list_(pa.int32()))), dense(packed, 6)
    w = rng.normal(size=x.shape[1])
    assert np.allclose(rows.margin(w), x @ w)
    loss, g = toxicity.as_negative(rows, w)
    p = 1 / (1 + np.exp(-(x @ w)))
    assert np.isclose(loss, -np.log(1 - p).sum()) and np.allclose(g, x.T @ p)


def test_fit_follows_all_texts(spark):
    """A sample of a tenth whose words are shared out otherwise than in all texts, tilted in rounds, comes near the minimum over all."""
    rng = np.random.default_rng(4)
    positive = [sorted({*x, 2}) for x in lists(rng, 60, 6)]
    sample, rest = lists(rng, 60, 6), [[c for c in x if c < 12] for x in lists(rng, 600, 6)]
    rows = [(k, 1, x) for k, x in enumerate(positive)] + [(100 + k, 2, x) for k, x in enumerate(sample)] + [(1000 + k, 0, x) for k, x in enumerate(rest)]
    frame = spark.createDataFrame(rows, "doc_id long, role int, words array<int>")
    p, u = dense(positive, 6), dense(positive + sample + rest, 6)
    whole = objective(toxicity.fit(frame.selectExpr("doc_id", "role | 2 as role", "words"), 18, 0.3, rounds=1, steps=2000), p, u, 0.3)
    alone = objective(toxicity.fit(frame, 18, 0.3, rounds=1, steps=500), p, u, 0.3)
    tilted = objective(toxicity.fit(frame, 18, 0.3, rounds=8, steps=500), p, u, 0.3)
    assert alone - whole > 0.01 and tilted - whole < 0.2 * (alone - whole), (whole, alone, tilted)


def test_rare_and_null_rows(spark, odd):
    labels = spark.createDataFrame([(4, 0, 1), (3, 0, 0), (5, 1, 0), (None, 1, 1), (77, 0, 1)], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity_scores(odd, labels).collect()
    assert len(rows) == 8 and all(0 <= r.score <= 1 for r in rows) and len({r.score for r in rows if r.doc_id == 4}) == 1
    assert toxicity.toxicity_scores(odd.limit(0), labels).count() == 0
