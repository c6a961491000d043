"""World matrices and bounds against products in numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from editstrata.operators import transforms


def turned(q):
    w, x, y, z = q
    return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])


@pytest.mark.parametrize("seed", [1, 2])
def test_chain(spark, seed):
    """A tree six levels deep with missing, partial and resetting transforms; several scenes."""
    rng = np.random.default_rng(seed)
    paths = ["/A", "/A/B", "/A/B/C", "/A/B/C/D", "/A/B/C/D/E", "/A/B/C/D/E/F", "/A/X", "/A/X/Y", "/Z"]
    local, rows, points = {}, [], []
    for scene in ("s", "t"):
        for p in paths:
            if p == "/A/B/C/D" or rng.random() < 0.2:
                continue
            t, q, s = rng.normal(size=3), rng.normal(size=4), rng.uniform(-2, 2, 3)
            q /= np.linalg.norm(q)
            resets = bool(rng.random() < 0.2)
            m = np.eye(4)
            m[:3, :3] = np.diag(s) @ turned(q).T
            m[3, :3] = t
            local[scene, p] = (m, resets)
            rows.append((scene, p, t.tolist(), q.tolist(), s.tolist(), resets))
        for p in ("/A/B/C/D/E/F", "/A/X/Y", "/A/B", "/Z"):
            points += [(scene, p, *map(float, rng.normal(size=3))) for _ in range(4)]
    world = {}
    for scene in ("s", "t"):
        for p in paths:
            m, resets = local.get((scene, p), (np.eye(4), False))
            up = world.get((scene, p.rsplit("/", 1)[0]), np.eye(4))
            world[scene, p] = m if resets else m @ up
    table = spark.createDataFrame(rows, "scene_id string, prim string, t array<double>, r array<double>, s array<double>, resets boolean")
    table = table.select("scene_id", "prim", transforms.local_matrix(F.col("t"), F.col("r"), F.col("s")).alias("matrix"), "resets")
    dots = spark.createDataFrame(points, "scene_id string, prim string, x double, y double, z double")
    for r in transforms.world_matrices(dots, table).collect():
        assert np.allclose(np.array(r.world).reshape(4, 4), world[r.scene_id, r.prim])
    boxes = {}
    for scene, p in {(s, p) for s, p, *_ in points}:
        own = np.array([x[2:] for x in points if x[:2] == (scene, p)])
        lo, hi = own.min(0), own.max(0)
        corners = np.array([[*np.where([i & 1, i & 2, i & 4], hi, lo), 1] for i in range(8)]) @ world[scene, p]
        for k in range(1, len(p.split("/"))):
            boxes.setdefault((scene, "/".join(p.split("/")[: k + 1])), []).append(corners[:, :3])
    got = {(r.scene_id, r.prim): r for r in transforms.world_bounds(dots, table).collect()}
    assert got.keys() == boxes.keys()
    for k, parts in boxes.items():
        every = np.concatenate(parts)
        assert np.allclose([got[k][f"{c}_min"] for c in "xyz"], every.min(0)) and np.allclose([got[k][f"{c}_max"] for c in "xyz"], every.max(0))


def test_nothing(spark):
    none = spark.createDataFrame([], "scene_id string, prim string, x double, y double, z double")
    table = spark.createDataFrame([], "scene_id string, prim string, matrix array<double>, resets boolean")
    assert transforms.world_bounds(none, table).count() == 0
    one = spark.createDataFrame([("s", "/A/B", 1.0, 2.0, 3.0)], none.schema)
    assert {r.prim: (r.x_min, r.z_max) for r in transforms.world_bounds(one, table).collect()} == {"/A": (1.0, 3.0), "/A/B": (1.0, 3.0)}
