"""Whitening against numpy's eigenvectors of the covariance, and exact sums against whole numbers."""

import math

import numpy as np
import pytest

from editstrata.llm import registry
from editstrata.llm import whitening as op

SCHEMA = "vec_id long, embedding array<float>, component string, n string"


def whole(v):
    return [math.floor(1024 * float(np.float32(c))) + 100_000 for c in v]


def compare(got, rows, most=8, near=1e-8):
    """All columns against plain sums and eigh; components are compared up to their sign, where their eigenvalue stands alone."""
    x = np.array([whole(v) for _, v in rows], object)
    n, total = len(x), x.sum(0)
    exact = ((n * x - total) ** 2).sum(1)
    y = ((n * x - total).astype(float)) / n
    e, axes = np.linalg.eigh(y.T @ y / n)
    e, axes = e[::-1], axes[:, ::-1]
    kept = [k for k in range(min(most, len(e))) if e[k] > 1e-14 * e[0]]
    assert len(got) == n * len(kept)
    by = {}
    for r in got:
        by.setdefault(r.vec_id, {})[r.component] = r
    w = np.array([[by[i][k + 1].whitened for k in kept] for i, _ in rows])
    want = y @ axes[:, kept] / np.sqrt(e[kept])
    for k in kept:
        gap = min([abs(e[k] - e[j]) for j in range(len(e)) if j != k], default=1) / e[0]
        if gap > 1e-6:
            assert np.abs(w[:, k] * np.sign(w[:, k] @ want[:, k]) - want[:, k]).max() < near / gap
        assert by[rows[0][0]][k + 1].explained == pytest.approx(e[k] / e.sum(), rel=1e-9)
    assert [by[i][1].deviation for i, _ in rows] == [d if d < 2**63 else None for d in exact.tolist()]
    assert {r.n for r in got} == {n}
    error = np.abs(w.T @ w / n - np.eye(len(kept))).max()
    assert {r.identity_error for r in got} == {got[0].identity_error} and got[0].identity_error < 1e-9 and error < 1e-9


def run(spark, rows, **more):
    return op.whitened(spark.createDataFrame([(i, v, "clash", None) for i, v in rows], SCHEMA), **more).collect()


@pytest.mark.parametrize("kind", ["normal", "dependent", "equal", "few", "large"])
def test_against_eigh(spark, monkeypatch, kind):
    monkeypatch.setattr(op, "BLOCK_VALUES", 100)
    monkeypatch.setattr(op, "FAN", 2)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 12)) * np.arange(1, 13) / 40
    if kind == "dependent":  # constant and dependent dimensions
        x[:, 3], x[:, 5] = 0.25, x[:, 4]
    if kind == "equal":  # every eigenvalue occurs twice: signs of two dimensions in all combinations
        x = np.array([[(a * 2 - 1) * s / 4 for s in (1, 2, 3, 4) for a in (k & 1, k >> 1 & 1)] for k in range(4)] * 5)
    if kind == "few":
        x = x[:4]
    if kind == "large":
        x *= 2.0**19
    rows = [(k, np.float32(v).tolist()) for k, v in enumerate(x)]
    compare(run(spark, rows), rows)


def test_odd_rows(spark):
    rng = np.random.default_rng(4)
    good = [(k, np.float32(rng.normal(size=3)).tolist()) for k in range(20)]
    odd = [(100, None), (101, []), (102, [1.0, float("nan"), 0.0]), (103, [1.0, float("-inf"), 0.0]), (104, [1.0, None, 0.0]), (105, [1.0, 2.0])]
    compare(run(spark, odd + good), good)
    repeated = run(spark, [(None, v) for _, v in good] + good)
    assert len(repeated) == 2 * 3 * 20 and sum(r.vec_id is None for r in repeated) == 60
    for none in ([], odd, good[:1], [(k, [0.5, 0.25]) for k in range(9)]):
        assert run(spark, none if none is not odd else odd[:5]) == []


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    compare(registry.op13_embedding_whitening(spark, sf_dir).collect(), rows)
