"""Language models against counts in dictionaries: exact counts, own tokens taken out, background scaled to the target."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from editstrata.llm import lm_scoring


def brute_force(corpus, target, hot):
    """Losses of each text by the definition, from counters. corpus: words by id."""
    whole = Counter(w for ws in corpus.values() for w in ws)
    total = sum(whole.values())
    often = {w for w, n in whole.items() if n > total / hot}
    cls = lambda w: w if w in often else "RARE"
    sides = []
    for inside in (True, False):
        words, classes, history, pairs = Counter(), Counter(), Counter(), Counter()
        for i, ws in corpus.items():
            if (i in target) == inside:
                c = ["START", *map(cls, ws)]
                words.update(ws), classes.update(c[1:]), history.update(c[:-1]), pairs.update(zip(c, c[1:], strict=False))
        sides.append((words, classes, history, pairs))
    sizes = [sum(x[1].values()) for x in sides]
    scale = sizes[0] / sizes[1] if all(sizes) else 1.0
    v_rare, v_class = max(len(whole) - len(often), 1), len(often) + 2
    out = {}
    for i, ws in corpus.items():
        c = ["START", *map(cls, ws)]
        own = [Counter(ws), Counter(c[:-1]), Counter(zip(c, c[1:], strict=False)), Counter(c[1:])]
        got = []
        for m, (words, classes, history, pairs) in enumerate(sides):
            mine, s = (i in target) == (m == 0), scale if m else 1.0
            less = lambda n, k: (n - (k if mine else 0)) * s  # noqa: B023, E731
            loss = 0.0
            for a, b, w in zip(c, c[1:], ws, strict=False):
                prior = lm_scoring.PRIOR * (classes[b] * s + 1) / (sizes[m] * s + v_class)
                p = (less(pairs[a, b], own[2][a, b]) + prior) / (less(history[a], own[1][a]) + lm_scoring.PRIOR)
                if b == "RARE":
                    p *= (less(words[w], own[0][w]) + 1) / (less(classes["RARE"], own[3]["RARE"]) + v_rare)
                loss -= math.log2(p)
            got.append(loss / max(len(ws), 1))
        out[i] = got
    return out


def compared(spark, corpus, target):
    frame = spark.createDataFrame([(i, " ".join(ws)) for i, ws in corpus.items()], "doc_id long, text string")
    want = brute_force(corpus, target, lm_scoring.HOT)
    rows = lm_scoring.cross_entropy_differences(frame, F.col("doc_id").isin(*target)).collect()
    assert sorted(r.doc_id for r in rows) == sorted(corpus)
    for r in rows:
        assert r.n_tokens == len(corpus[r.doc_id])
        assert (r.target_loss, r.background_loss) == pytest.approx(want[r.doc_id], abs=1e-9) and r.score == pytest.approx(r.target_loss - r.background_loss)


@pytest.mark.parametrize("hot", [20, 300, 1 << 16])
def test_losses(spark, texts, hot, monkeypatch):
    """Whole texts, with few, some and all words frequent, and with frequent and other pairs."""
    monkeypatch.setattr(lm_scoring, "HOT", hot)
    monkeypatch.setattr(lm_scoring, "HOT_PAIRS", 4 * hot)
    corpus = {i: [w.decode() for w in (t or "").encode().lower().split()] for i, t in list(texts.items())[:60]}
    compared(spark, corpus, [i for i in corpus if i % 3 == 0])


def test_losses_of_many_pairs(spark):
    """More pairs than tasks count at once are summed exactly."""
    rng = np.random.default_rng(5)
    compared(spark, {k: [f"w{x}" for x in rng.integers(0, 3000, 5000)] for k in range(300)}, range(0, 300, 2))


def test_copies_are_scored_apart(spark):
    """A text whose copy is in the background is likelier there; one of the target's copies the other way; a text without a copy is not taken for its own model's."""
    rng = np.random.default_rng(6)
    fresh = [" ".join(f"w{x}" for x in rng.integers(0, 400, 60)) for _ in range(200)]
    rows = [(k, t, k % 2 == 0) for k, t in enumerate(fresh)] + [(900, fresh[1], False), (901, fresh[2], True)]
    got = {r.doc_id: r.score for r in lm_scoring.cross_entropy_differences(spark.createDataFrame(rows, "doc_id long, text string, t boolean"), F.col("t")).collect()}
    others = [s for k, s in got.items() if k not in (1, 2, 900, 901)]
    assert min(got[1], got[900]) > max(others) and max(got[2], got[901]) < min(others)


def test_odd_rows(spark, odd):
    for target in (F.lit(False), F.lit(True), F.lit(None).cast("boolean"), F.col("doc_id") == 4):
        rows = lm_scoring.cross_entropy_differences(odd, target).collect()
        assert len(rows) == 8 and all(r.score == 0 for r in rows if not r.n_tokens) and sum(r.n_tokens for r in rows) == 30022
    assert lm_scoring.cross_entropy_differences(odd.limit(0), F.lit(True)).count() == 0
