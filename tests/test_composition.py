"""Composition against a fold over the edits: deletions, renames and new creations in several layers."""

import random

import pytest

from editstrata.operators import compose, diff

LAYERS = [("a", 1, False), ("b", 2, False), ("c", 3, True), ("d", 4, False)]
SCHEMA = "scene_id string, seq long, layer_key string, k string, prim string, field string, time double, value double"


def fold(rows):
    """Each layer's values after all edits, then the strongest unmuted layer's of each field and domain."""
    said = {}
    for scene, _, layer, k, prim, field, time, value in sorted(rows, key=lambda r: r[1]):
        if k in ("delete_prim", "rename_prim"):
            for key in [x for x in said if x[:2] == (scene, layer) and (x[2] == prim or x[2].startswith(prim + "/"))]:
                del said[key]
        elif field:
            said[scene, layer, prim, field, time] = value
    rank = {name: r for name, r, muted in LAYERS if not muted}
    best = {}
    for scene, layer, prim, field, time in said:
        if layer in rank:
            domain = (scene, prim, field, time is None)
            best[domain] = min(best.get(domain, 99), rank[layer])
    return {(s, p, f, t): v for (s, layer, p, f, t), v in said.items() if layer in rank and best[s, p, f, t is None] == rank[layer]}, said


def random_log(seed, n=400):
    rng = random.Random(seed)
    prims = ["/W", "/W/A", "/W/A/x", "/W/A/y", "/W/AB", "/W/B", "/W/B/x"]
    rows = []
    for seq in range(1, n + 1):
        k = rng.choices(["set_gprim_attrs", "ensure_prim", "delete_prim", "rename_prim"], [12, 2, 1, 1])[0]
        value = k == "set_gprim_attrs"
        rows.append((f"s{rng.randrange(2)}", seq, rng.choice("abcd"), k, rng.choice(prims), rng.choice("uv") if value else "", rng.choice([None, 0.0, 1.0]) if value else None, float(rng.randrange(9)) if value else 0.0))
    return rows


@pytest.fixture(scope="module")
def layers(spark):
    return spark.createDataFrame(LAYERS, "layer_key string, rank int, muted boolean")


@pytest.mark.parametrize("seed", range(4))
def test_fold(spark, layers, seed):
    rows = random_log(seed)
    log = spark.createDataFrame(rows, SCHEMA)
    want, said = fold(rows)
    assert {(r.scene_id, r.prim, r.field, r.time): r.value for r in compose.composed(log, layers).collect()} == want
    assert {(r.scene_id, r.prim, r.field, r.time): r.value for r in compose.layer_opinions(log, "b").collect()} == {(s, p, f, t): v for (s, layer, p, f, t), v in said.items() if layer == "b"}
    merged = {(s, p, f, t): v for name in ("d", "a") for (s, layer, p, f, t), v in said.items() if layer == name}
    assert {(r.scene_id, r.prim, r.field, r.time): r.value for r in compose.merged_into(log, "a", "d").collect()} == merged


@pytest.mark.parametrize("upto", [0, 150, 399, 400])
def test_two_states(spark, layers, upto):
    rows = random_log(9)
    log = spark.createDataFrame(rows, SCHEMA)
    before, after = fold([r for r in rows if r[1] <= upto])[0], fold(rows)[0]
    want = {k: ("create" if k not in before else "remove" if k not in after else "change", before.get(k), after.get(k)) for k in before.keys() | after.keys() if (k in before, before.get(k)) != (k in after, after.get(k))}
    got = diff.value_changes(compose.composed_twice(log, layers, upto)).collect()
    assert {(r.scene_id, r.prim, r.field, r.time): (r.change, r.old_value, r.new_value) for r in got} == want


def test_two_layers(spark, layers):
    """A stronger layer's deletion shows the weaker one's value; what is made again counts; a rename takes its own layer's values along with their old path."""
    rows = [(1, "a", "set", "/P/x", 1.0), (2, "b", "set", "/P/x", 2.0), (3, "a", "delete_prim", "/P", None)]
    more = [(4, "a", "ensure_prim", "/P/x", None), (5, "a", "set", "/P/x", 5.0)]
    renamed = [(6, "a", "rename_prim", "/P/x", None), (7, "a", "set", "/P/y", 7.0)]

    def state(rows):
        log = spark.createDataFrame([("s", q, y, k, p, "f" if k == "set" else "", None, v) for q, y, k, p, v in rows], SCHEMA)
        return {r.prim: (r.value, r.layer_key) for r in compose.composed(log, layers).collect()}

    assert state(rows) == {"/P/x": (2.0, "b")}
    assert state(rows + more) == {"/P/x": (5.0, "a")}
    assert state(rows + more + renamed) == {"/P/x": (2.0, "b"), "/P/y": (7.0, "a")}
