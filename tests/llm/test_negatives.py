"""Hard negatives against a plain search over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from editstrata.llm import hard_negatives as op
from editstrata.llm import registry

SCHEMA = "vec_id long, embedding array<float>, label int, score string, window string"


def plain(rows, positives=5, negatives=3, low=50, high=95):
    """(anchor, positive, rank, negative, scores) by sorting all pairs; the best of a repeated id counts."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], y) for i, v, y in rows if None not in (i, v, y) and all(x is not None and math.isfinite(x) for x in v)]
    asking = {}
    for i, v, y in sorted((r for r in kept if r[0] % 50 == 0), key=lambda r: (r[2], r[1])):
        asking.setdefault(i, (v, y))
    out = []
    for a, (v, y) in asking.items():
        best = {}
        for i, w, z in kept:
            if i != a and len(w) == len(v):
                s = sum(p * q for p, q in zip(v, w, strict=True))
                best.setdefault((z == y, i), []).append(s)
        ordered = lambda same, fits: sorted({i: max(s for s in scores if fits(s)) for (k, i), scores in best.items() if k == same and any(map(fits, scores))}.items(), key=lambda x: (-x[1], x[0]))
        for p, s in ordered(True, lambda s: True)[:positives]:
            for rank, (n, t) in enumerate(ordered(False, lambda t, s=s: low * s <= 100 * t <= high * s)[:negatives], 1):
                out.append((a, p, rank, n, s, t))
    return sorted(out)


def got(spark, rows):
    found = op.hard_negatives(spark.createDataFrame([(*r, "clash", None) for r in rows], SCHEMA), F.col("vec_id") % 50 == 0)
    return sorted(map(tuple, found.collect()))


def rows_of(kind):
    rng = np.random.default_rng(5)
    if kind == "ties":  # few values: many equal scores, and a third of all rows are one vector
        vectors = rng.integers(-2, 3, (400, 6)) / 8
        vectors[::3] = 0.25
    elif kind == "repeats":  # ids come several times, with equal and with other vectors and labels
        vectors = rng.normal(size=(400, 9)) / 3
        vectors[200:300] = vectors[:100]
    elif kind == "large":  # the bounds do not fit 64 bits
        vectors = rng.choice([-1.0, 1.0, 0.0], (300, 5)) * 2.0**20
        vectors[:, 0] = 2.0**21.5
    else:
        vectors = rng.normal(size=(500, 16)) / 4
    rows = [(k, [float(np.float32(x)) for x in v], int(rng.integers(0, 3))) for k, v in enumerate(vectors)]
    if kind == "repeats":
        rows = [(i % 200, v, y) for i, v, y in rows]
    if kind == "lengths":
        rows = [(i, v[: 4 + 6 * (i % 3 > 0)], y) for i, v, y in rows]
    return rows


@pytest.mark.parametrize("kind", ["normal", "ties", "repeats", "lengths", "large"])
@pytest.mark.parametrize(("block", "step", "group"), [(8192, 8, 1 << 20), (37, 2, 40)])
def test_all_pairs(spark, monkeypatch, kind, block, step, group):
    """Blocks, steps and groups of any size lose nothing."""
    for name, value in (("BLOCK", block), ("STEP", step), ("GROUP_VALUES", group)):
        monkeypatch.setattr(op, name, value)
    rows = rows_of(kind)
    assert got(spark, rows) == plain(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    odd = [(0, None, 1), (50, [1.0, nan], 1), (100, [1.0, inf], 1), (150, [1.0, None], 1), (None, [1.0, 0.5], 1), (200, [1.0, 0.5], None), (250, [], 1), (251, [], 1), (252, [], 2), (300, [1.0, 0.5], 1), (301, [1.0, 0.5], 1), (302, [0.7, 0.4], 2), (350, [-0.1, 0.0], 3), (351, [0.1, 0.0], 3)]
    assert got(spark, odd) == plain(odd) != []
    assert got(spark, []) == [] and got(spark, odd[:6]) == []


def test_bitmap_shrinks():
    """Most rows are left after a part of the dimensions, and what stays has exact scores."""
    rng = np.random.default_rng(1)
    values = op.whole_numbers(rng.normal(size=(64, 4000)) * 2.0 ** -np.arange(0, 8, 0.125)[:, None], 256)
    block = op.Block(np.arange(4000), np.zeros(4000, np.int64), values)
    anchor = values[:, 7]
    exact = anchor @ values
    rows, scores = op.scanned(block, anchor, np.ones(4000, bool), np.array([[op._NONE, 2**62]]), np.array([op._NONE]), 5)
    assert len(rows) < 20 and (scores == exact[rows]).all() and set(np.argsort(-exact)[:5]) <= set(rows)


def test_query(spark, sf_dir):
    rows = [(r.vec_id, r.embedding, (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert sorted(map(tuple, registry.op12_hard_negatives(spark, sf_dir).collect())) == plain(rows)
