"""Graphs deeper than any fixed number of steps, with cycles."""

import pytest

from editstrata.operators import graph


def test_reachable_to_the_end(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(55)] + [(55, 3), (100, 101)], "parent long, child long")
    roots = spark.createDataFrame([(0,)], "node long")
    assert {r.node: r.steps for r in graph.reachable(edges, roots).collect()} == {k: k for k in range(56)}
    with pytest.raises(RuntimeError):
        graph.reachable(edges, roots, 3).collect()


def test_flattened_long_chains_and_cycles(spark):
    links = [(f"c{k}", f"c{k + 1}") for k in range(70)] + [("x", "y"), ("y", "z"), ("z", "x"), ("into", "x"), ("self", "self")]
    rows = spark.createDataFrame([(p, "i", s, "i") for p, s in links], "prim string, attr string, source_prim string, source_attr string")
    got = {r.prim: (r.source_prim, r.hops) for r in graph.flattened_inputs(rows).collect()}
    assert got == {f"c{k}": ("c70", 70 - k) for k in range(70)}


def test_flattened_cycles_alone(spark):
    rows = spark.createDataFrame([("a", "i", "b", "i"), ("b", "i", "a", "i")], "prim string, attr string, source_prim string, source_attr string")
    assert graph.flattened_inputs(rows).count() == 0 and graph.flattened_inputs(rows.limit(0)).count() == 0
