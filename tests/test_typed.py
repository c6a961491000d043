"""Typed values and the reader of JSON lines."""

import itertools
import json

import pytest
from pyspark.sql import functions as F

from editstrata.functions import typed
from editstrata.operators import reduce
from editstrata.sources.edit_log import json_lines, parsed_edits

VALUES = ["1", "1.0", "1e0", "1.5", "true", "false", '"1"', '"x"', "[1,2]", "[1.0,2.0]", "[[1,2],[3]]", "[[1.0,2],[3.0]]", "[]", '["a"]', '[1,"a"]', "[1,null]", '{"a":1,"b":2}', '{"b":2,"a":1}', "9007199254740993", "9007199254740992", "null"]


def equal(a, b):
    """Python's equality, but truth values are no numbers."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    return type(a) is type(b) and len(a) == len(b) and all(map(equal, a, b)) if isinstance(a, list) and isinstance(b, list) else a == b


def test_equality(spark):
    pairs = [(a, b) for a, b in itertools.product(VALUES, VALUES)]
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", F.parse_json("a").alias("x"), F.parse_json("b").alias("y"))
    rows = rows.select("a", "b", typed.same(F.col("x"), F.col("y")).alias("same"), (typed.fingerprint(F.col("x")) == typed.fingerprint(F.col("y"))).alias("marks"), typed.near(F.col("x"), F.col("y"), 0.5).alias("near"))
    for r in rows.collect():
        a, b = json.loads(r.a), json.loads(r.b)
        want = equal(a, b)
        assert r.same == r.marks == want, (r.a, r.b)
        if want:
            assert r.near
        elif not isinstance(a, bool) and not isinstance(b, bool) and isinstance(a, (int, float)) and isinstance(b, (int, float)) and a < 9 and b < 9:
            assert r.near == (abs(a - b) <= 0.5)


def test_kinds_and_checks(spark):
    rows = spark.createDataFrame([(v,) for v in VALUES], "v string").withColumn("x", F.parse_json("v"))
    got = {r.v: r for r in rows.select("v", typed.kind_of(F.col("x")).alias("kind"), typed.has_width(F.col("x"), 2).alias("two"), typed.is_vector(F.col("x"), 2).alias("vector"), typed.numbers(F.col("x")).alias("n")).collect()}
    kinds = {"1.5": "number", "true": "bool", '"x"': "text", "[1,2]": "numbers", "[[1,2],[3]]": "rows", "[]": "numbers", '["a"]': "array", '[1,"a"]': "array", "[1,null]": "array", '{"a":1,"b":2}': "object", "null": "null"}
    assert {v: got[v].kind for v in kinds} == kinds
    assert [v for v in VALUES if got[v].two] == ["[1,2]", "[1.0,2.0]", "[]"] and [v for v in VALUES if got[v].vector] == ["[1,2]", "[1.0,2.0]"]
    assert got["[[1,2],[3]]"].n == [1.0, 2.0, 3.0] and got['"x"'].n is None


LINES = [
    '{"k": "set_gprim_attrs", "prim": "/A", "seq": 1, "attrs": {"points": [0, 1, 2], "radius": 2.0, "name": "x"}}',
    '{"k": "set_xform_trs", "prim": "/A", "seq": 2, "fields": ["t"], "t": [1, 2.5, 3]}',
    '{"k": "ensure_prim", "prim": "/A", "seq": 3, "typeName": "Mesh", "colour": "red"}',
    '{"k": "set_visibility", "prim": "/A", "seq": 4, "visible": false}',
    '{"k": "set_connectable_connection", "prim": "/A", "seq": 5, "connections": {"inputs:a": {"source_prim": "/B", "source_attr": "outputs:o"}}}',
    '{"k": "set_reference", "prim": "/A", "seq": 6, "refs": [{"asset_path": "a.usd", "list_position": "explicit"}]}',
    '{"k": "set_gprim_attrs", "prim": "/A", "seq": 7, "attrs": 5, "time": "late"}',
    '{"k": "set_xform_trs", "prim": "/A", "seq": 8, "vals": {"t": 1.5}}',
    '{"seq": 9, "k": "broken',
    "  ",
    '{"k": "set_gprim_attrs", "prim": "/A", "seq": 10, "attrs": {"points": [9]}, "inputs": {"radius": "big"}}',
]


def test_reader(spark, tmp_path):
    """Nothing is lost: other names, other types, unknown fields, broken lines."""
    (tmp_path / "a.jsonl").write_text("\n".join(LINES))
    log = json_lines(spark, f"file://{tmp_path}/a.jsonl")
    rows = {r.seq: r for r in log.collect()}
    vals = lambda k: {n: v.toPython() for n, v in rows[k].vals.items()}
    assert {n: v if not isinstance(v, list) else [float(x) for x in v] for n, v in vals(1).items()} == {"points": [0.0, 1.0, 2.0], "radius": 2, "name": "x"}
    assert [float(x) for x in vals(2)["t"]] == [1.0, 2.5, 3.0] and rows[2].fields == ["t"] and sorted(rows[1].fields) == ["name", "points", "radius"]
    assert rows[3].type_name == "Mesh" and json.loads(rows[3].rescued) == {"colour": "red"}
    assert rows[4].flag is False and rows[5].connections["inputs:a"].prim == "/B" and rows[5].connections["inputs:a"].attr == "outputs:o" and rows[6].arcs[0].asset_path == "a.usd"
    assert rows[7].rescued == LINES[6] and not rows[7].vals and float(vals(8)["t"]) == 1.5
    assert rows[None].rescued == LINES[8] and len(rows) == 10
    assert [r.rescued for k, r in rows.items() if k in (1, 2, 4, 5, 6, 8, 10)] == [None] * 7


def test_merge_of_types(spark):
    """The last value of a name stays, of another type too."""
    rows = parsed_edits(spark.createDataFrame([(x,) for x in (LINES[0], LINES[10])], "value string")).fillna({"scene_id": "s", "client_id": "c", "layer_key": "l"})
    got = reduce.compacted(rows.withColumn("removed", F.lit(False))).collect()
    assert len(got) == 1 and {n: str(v.toPython()) for n, v in got[0].vals.items()} == {"points": "[9]", "radius": "big", "name": "x"}


@pytest.mark.parametrize("empty", [[], [("",)]])
def test_no_lines(spark, empty):
    assert parsed_edits(spark.createDataFrame(empty, "value string")).count() == 0
