"""The namespace that a log leaves, against a fold over its edits; and ranks and runs over groups that many parts share."""

import math
import random

import pytest

from editstrata.functions import math3d
from editstrata.operators import renames, running
from editstrata.plans.full_log import full_edits


def folded(rows):
    """Prims by scene, edit by edit: made, deleted and renamed with what is below them."""
    prims = {}
    for r in sorted(rows, key=lambda r: r.seq):
        here = prims.setdefault(r.scene_id, {})
        below = [p for p in here if p == r.prim or p.startswith(r.prim + "/")]
        if r.k == "ensure_prim":
            here[r.prim] = r.type_name or ""
        elif r.k == "delete_prim":
            for p in below:
                del here[p]
        elif r.k == "rename_prim":
            root = r.prim.rsplit("/", 1)[0] + "/" + r.new_name
            moved = {p: here.pop(p) for p in below}
            for p, t in moved.items():
                here[root + p[len(r.prim) :]] = t
            here.setdefault(root, "Xform")
    return {(s, p, t) for s, x in prims.items() for p, t in x.items()}


def test_namespace(spark, sf_dir):
    log = full_edits(spark, sf_dir)
    rows = log.filter("k in ('ensure_prim', 'delete_prim', 'rename_prim')").select("scene_id", "seq", "k", "prim", "type_name", "new_name").collect()
    got = {(r.scene_id, r.prim, r.type_name) for r in renames.namespace(log).collect()}
    assert got == folded(rows)


SCHEMA = "scene_id string, seq long, k string, prim string, type_name string, new_name string"


def random_moves(seed, n):
    rng = random.Random(seed)
    names, rows = list("abc"), []
    for seq in range(1, n + 1):
        path = "/" + "/".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
        k = rng.choices(["ensure_prim", "rename_prim", "delete_prim"], [5, 6, 1])[0]
        rows.append((f"s{rng.randrange(3)}", seq, k, path, f"T{seq}" if k == "ensure_prim" else None, f"n{seq}" if k == "rename_prim" else None))
        if rng.random() < 0.3:  # back to a path that renames have freed, below new names, too
            names = [*names[-6:], f"n{rng.randint(1, seq)}"]
    return rows


def test_random_moves(spark):
    """Subtrees move again and again, names come back, prims are made again where others were moved away; whole and in two batches."""
    rows = random_moves(1, 130)
    log = spark.createDataFrame(rows, SCHEMA)
    want = folded(log.collect())
    assert {(r.scene_id, r.prim, r.type_name) for r in renames.namespace(log).collect()} == want
    state = None
    for low, high in ((0, 60), (60, 999)):
        state = renames.placed(log.filter(f"seq > {low} and seq <= {high}"), state)
    assert {(r.scene_id, r.prim, r.type_name) for r in renames.standing(state).collect()} == want


def test_many_renames_of_one_subtree(spark):
    """10,000 renames: 15 levels, whatever their number."""
    n = 10_000
    moves = spark.range(1, n + 1).selectExpr("'s' as scene_id", "id as seq", "concat('/W/n', id - 1) as source", "concat('/W/n', id) as target")
    paths = spark.createDataFrame([("s", -1, "/W/n0"), ("s", -1, "/W/n0/x/y"), ("s", 4000, "/W/n4000/z"), ("s", 5000, "/W/n0"), ("s", n, f"/W/n{n}"), ("t", 1, "/W/n1")], "scene_id string, seq long, path string")
    got = {(r.scene_id, r.seq, r.path.count("/")): (r.path, r.moved_at) for r in renames.moved(paths, moves).collect()}
    assert got == {("s", -1, 2): (f"/W/n{n}", n), ("s", -1, 4): (f"/W/n{n}/x/y", n), ("s", 4000, 3): (f"/W/n{n}/z", n), ("s", 5000, 2): ("/W/n0", None), ("s", n, 2): (f"/W/n{n}", None), ("t", 1, 2): ("/W/n1", None)}


def test_dependencies_move(spark):
    deps = spark.createDataFrame([("s", "/A/x", 1, "a.usd"), ("s", "/B", 2, "b.usd"), ("s", "/A/y", 9, "c.usd")], "scene_id string, prim string, seq long, asset_path string")
    moves = spark.createDataFrame([("s", 3, "/A", "/C"), ("s", 4, "/C/x", "/C/z"), ("s", 5, "/B", None)], "scene_id string, seq long, source string, target string")
    assert {(r.prim, r.asset_path) for r in renames.moved_dependencies(deps, moves).collect()} == {("/C/z", "a.usd"), ("/A/y", "c.usd")}
    assert renames.moved_dependencies(deps, moves.limit(0)).count() == 3


@pytest.mark.parametrize("groups", [1, 7])
def test_running(spark, groups):
    """Sums, runs and ranks in parts; gaps in the order, empty parts, null values."""
    rnd = random.Random(groups)
    rows = [(f"g{rnd.randrange(groups)}", n * 3 + (10_000 if n > 300 else 0), rnd.choice(["a", "a", "b", None]), rnd.randrange(5)) for n in range(600)]
    frame = spark.createDataFrame(rows, "g string, at long, v string, x int").repartition(3)
    sums, runs, last = {}, {}, {}
    for g, at, v, x in sorted(rows, key=lambda r: r[1]):
        sums[g] = sums.get(g, 0) + x
        runs[g] = runs.get(g, 0) + int(g not in last or last[g] != v)
        last[g] = v
        last[g, at] = (sums[g], sums[g] - x, runs[g])
    first = running.with_running(frame, ["g"], "at", {"s": frame["x"]})
    second = running.with_running(first.select("g", "at", "v", "x", "s"), ["g"], "at", {"b": frame["x"]}, own=False)
    got = running.with_runs(second, ["g"], "at", "v", "run").collect()
    assert {(r.g, r.at): (r.s, r.b, r.run) for r in got} == {k: v for k, v in last.items() if isinstance(k, tuple)}
    ranked = running.with_rank(frame, ["g"], ["x", "at"], "nth").collect()
    for g in {r[0] for r in rows}:
        mine = sorted((r.x, r.at, r.nth) for r in ranked if r.g == g)
        assert [n for _, _, n in mine] == list(range(1, len(mine) + 1))
    assert running.with_running(frame.limit(0), ["g"], "at", {"s": frame["x"]}).count() == 0 == running.with_rank(frame.limit(0), ["g"], ["at"], "nth").count()


def test_waves_and_faces(spark):
    """A grid's heights and faces against loops."""
    waves = [(1.0, 0.5, 0.2), (3.0, 0.25, 1.0)]
    for r in math3d.wave_grid(spark, 5, 4.0, waves).collect():
        x, z = r.i - 2.0, r.j - 2.0
        assert (r.x, r.z) == (x, z) and r.y == pytest.approx(sum(a * math.sin(f * x + p) * math.cos(f * z + p) for f, a, p in waves))
    faces = {tuple(r)[1:] for r in math3d.grid_faces(spark, 4).collect()}
    assert faces == {(j * 4 + i, j * 4 + i + 1, (j + 1) * 4 + i + 1, (j + 1) * 4 + i) for i in range(3) for j in range(3)}
