"""Raking, probabilities and the sample against plain loops."""

import numpy as np
import pytest

from editstrata.llm import source_mixing


def plain(cells, targets, rounds=40, error=1e-6):
    """Iterative proportional fitting over a dictionary of cells (values by dimension) and tokens."""
    dims = list(targets)
    total = sum(cells.values())
    marginals = []
    for d, dim in enumerate(dims):
        tokens = {}
        for key, n in cells.items():
            tokens[key[d]] = tokens.get(key[d], 0) + n
        t = targets[dim]
        if isinstance(t, dict):
            rest = sum(n for v, n in tokens.items() if v not in t) / total
            given = sum(t[v] for v in tokens if v in t)
            share = {v: t[v] / given * (1 - rest) if v in t else n / total for v, n in tokens.items()}
        else:
            share = {v: n**t for v, n in tokens.items()}
        whole = sum(share.values())
        marginals.append({v: x / whole for v, x in share.items()})
    weight = {k: float(n) for k, n in cells.items() if all(marginals[d][k[d]] > 0 for d in range(len(dims)))}
    for _ in range(rounds):
        off = 0.0
        for d in range(len(dims)):
            sums = {}
            for k, w in weight.items():
                sums[k[d]] = sums.get(k[d], 0.0) + w
            factor = {v: marginals[d][v] / s for v, s in sums.items()}
            off = max([off, *(abs(f - 1) for f in factor.values())])
            weight = {k: w * factor[k[d]] for k, w in weight.items()}
        if off <= error:
            break
    whole = sum(weight.values())
    return {k: w / whole for k, w in weight.items()}


TARGETS = [source_mixing.TARGETS, {"source": 0.0, "lang": {"en": 1.0, "de": 0.0, "xx": 3.0}}, {"source": 1.0, "lang": 0.3, "topic": {"prose": 1.0, "table": 1.0}}]


@pytest.mark.parametrize("targets", TARGETS)
def test_weights_and_probabilities(spark, targets):
    rng = np.random.default_rng(5)
    dims = list(targets)
    values = {"source": [f"s{k}" for k in range(9)], "lang": ["en", "de", "fr", "xx", "(none)"], "topic": ["prose", "table", "record"]}
    cells = {tuple(rng.choice(values[d]) for d in dims): int(rng.integers(1, 10_000)) for _ in range(60)}
    frame = spark.createDataFrame([(*map(str, k), n) for k, n in cells.items()], ", ".join(f"{d} string" for d in dims) + ", tokens long")
    want = plain({tuple(map(str, k)): n for k, n in cells.items()}, targets)
    fitted = source_mixing.with_probability(source_mixing.raked(frame, targets), 0.4).collect()
    got = {tuple(r[d] for d in dims): r.weight for r in fitted}
    assert got.keys() == want.keys() and got == pytest.approx(want, abs=1e-9)
    # the probabilities' factor: any more for cells below 1 would sample more than asked for
    n = {tuple(r[d] for d in dims): r.tokens for r in fitted}
    p = {tuple(r[d] for d in dims): r.probability for r in fitted}
    goal = min(0.4 * sum(n.values()), sum(n.values()))
    assert sum(n[k] * p[k] for k in n) == pytest.approx(goal, rel=1e-4)
    ratio = {k: want[k] / n[k] for k in n}
    free = [p[k] / ratio[k] for k in n if p[k] < 1]
    assert np.allclose(free, free[0], rtol=1e-4) and all(ratio[k] >= max(ratio[j] for j in n if p[j] < 1) * (1 - 1e-4) for k in n if p[k] == 1)


def test_sample_follows_the_draw(spark, odd):
    """Each row is kept where its id's draw is below its cell's probability, row by row; sampled() keeps the same rows."""
    rows = [(k, "word " * (1 + k % 7), ["en", "de", None][k % 3], f"s{k % 4}", 1) for k in range(400)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = source_mixing.mixture(frame).collect()
    kept = {r.doc_id for r in got if r.kept}
    assert kept == {r.doc_id for r in source_mixing.sampled(frame).collect()} and 100 < len(kept) < 300
    draws = {r.doc_id: r.d for r in frame.select("doc_id", source_mixing._draw(1).alias("d")).collect()}
    assert all(r.kept == (draws[r.doc_id] < r.probability) for r in got)
    topical = frame.selectExpr("*", "concat('t', doc_id % 2) as topic")
    assert {r.topic for r in source_mixing.mixture(topical).collect()} == {"t0", "t1"}


@pytest.mark.parametrize("few", [0, 4])
def test_dimensions_of_many_values(spark, monkeypatch, few):
    """Factors joined by shuffles, for all dimensions or for those of over four values, give the weights of plain loops too."""
    monkeypatch.setattr(source_mixing, "FEW_VALUES", few)
    rng = np.random.default_rng(7)
    cells = {(f"s{rng.integers(9)}", str(rng.choice(["en", "de", "xx"])), str(rng.choice(["prose", "table"]))): int(rng.integers(1, 10_000)) for _ in range(40)}
    frame = spark.createDataFrame([(*k, n) for k, n in cells.items()], "source string, lang string, topic string, tokens long")
    got = {(r.source, r.lang, r.topic): r.weight for r in source_mixing.raked(frame).collect()}
    assert got == pytest.approx(plain(cells, source_mixing.TARGETS), abs=1e-9)


def test_contradicting_targets(spark):
    """Factors of a dimension leave the doubles (5e8 to the power of 40), weights do not; nulls take no part."""
    frame = spark.createDataFrame([("a", "x", 10), ("b", "y", 10), (None, "y", 5)], "source string, lang string, tokens long")
    got = source_mixing.raked(frame.filter("source is not null"), {"source": {"a": 1e-9, "b": 1.0}, "lang": {"x": 1.0, "y": 1.0}}).collect()
    assert {r.source: r.weight for r in got} == pytest.approx({"a": 0.5, "b": 0.5}, abs=1e-9)
    assert {(r.source, r.lang) for r in source_mixing.raked(frame, {"source": 1.0, "lang": 1.0}).collect()} == {("a", "x"), ("b", "y")}


def test_rounds_plan_little(spark):
    """All of a fit's jobs are planned by the driver, whose memory they take: a round has three small ones, of two stages with an exchange between."""
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", lang, topic, int(rng.integers(1, 10_000))) for k in range(9) for lang in ("en", "de", "fr") for topic in ("prose", "table")]
    frame = spark.createDataFrame(rows, "source string, lang string, topic string, tokens long")
    sc, stages = spark.sparkContext, {}
    for rounds in (1, 4):
        sc.setJobGroup(f"raking {rounds}", "")
        try:
            assert len(source_mixing.raked(frame, rounds=rounds, error=0.0).collect()) == len(rows)
        finally:
            sc.setLocalProperty("spark.jobGroup.id", None)
        jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup(f"raking {rounds}")]
        stages[rounds] = sum(len(job.stageIds) for job in jobs)
    assert (stages[4] - stages[1]) / 3 <= 9, stages  # a stage that is done counts again where it is read
