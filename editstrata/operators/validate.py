"""Validation of edits as rules over columns; each violation is a row.

A rule is a condition that a faulty edit fulfils. All rules are evaluated in one projection; of an edit the
first that holds is reported. A transaction fails with any of its edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.paths import is_prim_path
from ..functions.scalars import finite, finite_vector
from ..sources.edit_log import EDIT_SCHEMA
from .scans import kinds

IDENTIFIER = r"^[\p{L}_][\p{L}\p{N}_]*$"
NAMED = r"^[\p{L}_][\p{L}\p{N}_]*(:[\p{L}_][\p{L}\p{N}_]*)*$"
#: Positions of arcs, purposes of bindings, kinds of specs, up axes and instancer fields with their widths.
POSITIONS = ("explicit", "added", "prepended", "appended", "deleted", "ordered")
SPEC_KINDS = ("prim", "attribute", "relationship", "variant", "variantSet", "layer")
INSTANCER_WIDTHS = {"positions": 3, "orientations": 4, "scales": 3, "velocities": 3, "angular_velocities": 3, "accelerations": 3}
UNTIMED = ("prototypes", "inactive_ids")
INTERPOLATIONS = ("constant", "uniform", "varying", "vertex", "faceVarying")
UP_AXES = ("Y", "Z")


def _is(*k: str) -> Column:
    return F.col("k").isin(*k)


def _bad_time() -> Column:
    return F.col("time").isNotNull() & ~finite(F.col("time"))


def _missing(column: str) -> Column:
    return F.col(column).isNull()


def _any(array: Column, test) -> Column:
    return F.coalesce(F.exists(array, test), F.lit(False))


def _typed_faults() -> dict[str, Column]:
    """Faults of typed values by kind of edit: what is no number or vector where one has to be, arrays of another width, names and ids of another type."""
    value = lambda name: F.try_element_at("vals", F.lit(name))
    wrong = lambda names, ok: F.greatest(F.lit(False), *(F.coalesce(value(n).isNotNull() & ~ok(n), F.lit(False)) for n in names))
    vectors = {"t": 3, "r": 4, "s": 3}
    numbers = ("timeCodesPerSecond", "framesPerSecond", "startTimeCode", "endTimeCode", "metersPerUnit")
    ids = ("proto_indices", "ids", "invisible_ids", "inactive_ids")
    texts = lambda v: F.try_variant_get(v, "$", "array<string>").isNotNull() & ~F.coalesce(typed.kind_of(v).isin("numbers", "rows"), F.lit(False))
    whole = lambda v: (typed.kind_of(v) == "numbers") & F.forall(typed.numbers(v), lambda x: x == F.floor(x))
    empty = lambda v: F.coalesce(F.size(F.try_variant_get(v, "$", "array<variant>")) == 0, F.lit(False))
    return {
        "set_xform_trs": wrong(vectors, lambda n: typed.is_vector(value(n), vectors[n])),
        "set_stage_metadata": wrong(numbers, lambda n: typed.finite(value(n)) & (typed.kind_of(value(n)) == "number")),
        "set_point_instancer": wrong(INSTANCER_WIDTHS, lambda n: empty(value(n)) | typed.has_width(value(n), INSTANCER_WIDTHS[n]) & typed.finite(value(n))) | wrong(ids, lambda n: empty(value(n)) | whole(value(n))) | wrong(("prototypes",), lambda n: empty(value(n)) | texts(value(n))),
    }


def rules(mode: str = "managed", with_types: bool = False) -> list[tuple[str, Column]]:
    """(name, fault) in order of precedence, over the columns of EDIT_SCHEMA and of `kinds`. with_types: vals holds typed values, else numbers."""
    names, values = F.map_keys("vals"), F.map_values("vals")
    is_finite = typed.finite if with_types else finite
    of_type = _typed_faults() if with_types else {}
    wrong_type = lambda k: of_type.get(k, F.lit(False))
    amount = typed.number if with_types else (lambda v: v)
    keys = F.coalesce(F.col("fields"), F.array().cast("array<string>"))
    supplied = F.coalesce(names, F.array().cast("array<string>"))
    off_fields = (F.size(F.array_except(keys, supplied)) > 0) | (F.size(F.array_except(supplied, keys)) > 0) | (F.size(F.array_distinct(keys)) != F.size(keys)) | (F.size(keys) == 0)
    numbers = _any(values, lambda v: ~is_finite(v))
    arc = _any(F.col("arcs"), lambda a: ~F.coalesce(a["list_position"].isin(*POSITIONS), F.lit(False)) | ((F.coalesce(a["asset_path"], F.lit("")) == "") & (F.coalesce(a["prim_path"], F.lit("")) == "")) | ~finite(F.coalesce(a["layer_offset"], F.lit(0.0))) | ~finite(F.coalesce(a["layer_scale"], F.lit(1.0))))
    mixed = _any(F.col("arcs"), lambda a: a["list_position"] == "explicit") & _any(F.col("arcs"), lambda a: a["list_position"] != "explicit")
    interpolation = lambda i: ~F.coalesce(i.isin(*INTERPOLATIONS), F.lit(False))
    bad_meta = _any(F.map_entries("primvar_meta"), lambda e: ~F.array_contains(supplied, e["key"]) | (F.coalesce(e["value"]["type_name"], F.lit("")) == "") | interpolation(e["value"]["interpolation"])) | _any(F.map_entries("attr_interp"), lambda e: ~F.array_contains(supplied, e["key"]) | interpolation(e["value"]))
    sub = F.col("sublayers")
    portable = lambda p: F.coalesce((p != "") & ~p.rlike(r"^[A-Za-z]:|\\\\"), F.lit(False))
    bad_topology = _any(sub, lambda l: ~portable(l["authored_path"]) | ~finite(F.coalesce(l["offset"], F.lit(0.0))) | ~finite(F.coalesce(l["scale"], F.lit(1.0)))) | (F.size(F.array_distinct(F.transform(sub, lambda l: l["authored_path"]))) != F.size(sub))
    qualified = lambda n: ~n.rlike(r"^(inputs|outputs):.+$")
    return [
        ("unknown_kind", F.col("creates").isNull()),
        ("wrong_mode", ~F.coalesce(F.col(mode), F.lit(True))),
        ("bad_prim", ~is_prim_path(F.col("prim")) & ~(_is("replace_sdf_layer_content", "set_sublayers", "set_stage_metadata") & (F.col("prim") == "/"))),
        ("bad_time", _bad_time()),
        ("bad_schema", _is("ensure_prim") & (_missing("type_name") | _any(F.col("api_schemas"), lambda a: ~a.rlike(NAMED)))),
        ("bad_transform", _is("set_xform_trs") & (off_fields | (F.size(F.array_except(keys, F.array(*map(F.lit, "trs")))) > 0) | numbers | wrong_type("set_xform_trs"))),
        ("missing_flag", _is("deactivate_prim", "set_visibility", "set_instanceable") & _missing("flag")),
        ("bad_name", _is("rename_prim") & ~F.coalesce(F.col("new_name").rlike(IDENTIFIER), F.lit(False))),
        ("bad_attributes", _is("set_gprim_attrs") & ((F.size(supplied) == 0) | _any(names, lambda n: ~n.rlike(NAMED)) | numbers | bad_meta)),
        ("bad_arcs", _is("set_reference", "set_payload") & (_missing("arcs") | arc | mixed)),
        ("bad_variants", _is("set_variant_selections") & ((F.coalesce(F.size("selections"), F.lit(0)) <= 0) | _any(F.map_keys("selections"), lambda n: ~n.rlike(IDENTIFIER)))),
        ("bad_binding", _is("set_material_binding") & (~F.coalesce(F.col("material_purpose").isin("", "full", "preview"), F.lit(True)) | ((F.coalesce(F.col("material_path"), F.lit("")) != "") & ~is_prim_path(F.col("material_path"))))),
        ("bad_inputs", _is("set_connectable_input") & (_any(keys, lambda f: ~F.array_contains(supplied, f)) | _any(names, lambda n: ~n.rlike(NAMED)) | numbers | _any(F.map_keys("input_types"), lambda n: ~F.array_contains(supplied, n)))),
        ("bad_connections", _is("set_connectable_connection") & (_any(F.map_keys("connections"), qualified) | _any(F.col("disconnections"), qualified) | (F.coalesce(F.size("connections"), F.lit(0)) + F.coalesce(F.size("disconnections"), F.lit(0)) <= 0))),
        ("bad_metadata", _is("set_stage_metadata") & (((F.size(supplied) == 0) & _missing("up_axis")) | numbers | ~F.coalesce(F.col("up_axis").isin(*UP_AXES), F.lit(True)) | _any(F.map_entries("vals"), lambda e: e["key"].isin("timeCodesPerSecond", "framesPerSecond", "metersPerUnit") & (amount(e["value"]) <= 0)) | wrong_type("set_stage_metadata"))),
        ("bad_instancer", _is("set_point_instancer") & (off_fields | wrong_type("set_point_instancer") | (F.col("time").isNotNull() & (F.size(F.array_intersect(keys, F.array(*map(F.lit, UNTIMED)))) > 0)))),
        ("bad_erase", _is("erase_time_samples") & (~F.coalesce(F.col("spec_path").startswith(F.concat("prim", F.lit("."))), F.lit(False)) | (F.coalesce(F.size("times"), F.lit(0)) <= 0) | _any(F.col("times"), lambda t: ~finite(t)))),
        ("bad_spec", _is("set_sdf_spec_fields") & (~F.coalesce(F.col("spec_kind").isin(*SPEC_KINDS), F.lit(False)) | (F.coalesce(F.col("spec_path"), F.lit("")) == "") | _missing("removed") | (F.col("removed") & (F.size(keys) > 0)))),
        ("bad_replacement", _is("replace_sdf_layer_content") & (F.col("prim") != "/")),
        ("bad_sublayers", _is("set_sublayers") & (_missing("sublayers") | bad_topology | (F.coalesce(F.col("generation"), F.lit("")) == "") | ~F.coalesce(F.col("revision") >= 0, F.lit(False)))),
    ]


def violations(log: DataFrame, mode: str = "managed") -> DataFrame:
    """scene_id, seq, client_id, session_id, txn_id, rule of the first rule that each faulty edit breaks."""
    absent = {f.name: F.lit(None).cast(f.dataType) for f in log.sparkSession.createDataFrame([], EDIT_SCHEMA).schema if f.name not in log.columns}
    rows = log.withColumns(absent).join(F.broadcast(kinds(log.sparkSession)), "k", "left")
    first = None
    for name, fault in rules(mode, typed.is_typed(rows.schema["vals"].dataType)):
        hit = F.coalesce(fault, F.lit(False))
        first = F.when(hit, name) if first is None else first.when(hit, name)
    return rows.withColumn("rule", first).filter("rule is not null").select("scene_id", "seq", "client_id", "session_id", "txn_id", "rule")


def failed_transactions(log: DataFrame, mode: str = "managed") -> DataFrame:
    """Transactions that fail, with the seq and rule of the first fault: an edit's, or more than one topology or content replacement."""
    txn = ["client_id", "session_id", "txn_id"]
    bad = violations(log, mode).groupBy(*txn).agg(F.min(F.struct("seq", "rule")).alias("f")).select(*txn, "f.seq", "f.rule")
    many = log.groupBy(*txn).agg(F.count_if(F.col("k") == "set_sublayers").alias("a"), F.count_if(F.col("k") == "replace_sdf_layer_content").alias("b"), F.max("seq").alias("seq"))
    many = many.filter("a > 1 or b > 1").select(*txn, "seq", F.lit("many_replacements").alias("rule"))
    return bad.unionByName(many).groupBy(*txn).agg(F.min(F.struct("seq", "rule")).alias("f")).select(*txn, "f.seq", "f.rule")


def instancer_faults(rows: DataFrame) -> DataFrame:
    """Instancer arrays (id, field, items, n: number of instances) whose length is not n times the field's width: id and field."""
    width = F.create_map(*(F.lit(x) for kv in INSTANCER_WIDTHS.items() for x in kv))[F.col("field")]
    return rows.filter(F.size("items") != F.col("n") * F.coalesce(width, F.lit(1))).select("id", "field")


def vector_faults(rows: DataFrame) -> DataFrame:
    """Rows (id, t, r, s) whose given vectors are not of 3, 4 and 3 finite numbers, with the field."""
    bad = F.array_compact(F.array(*(F.when(F.col(f).isNotNull() & ~finite_vector(F.col(f), n), f) for f, n in (("t", 3), ("r", 4), ("s", 3)))))
    return rows.select("id", F.explode(bad).alias("field"))


def priority_faults(departments: DataFrame) -> DataFrame:
    """Departments (pos, department) of a priority list that are empty or listed before: pos and fault."""
    first = departments.groupBy("department").agg(F.min("pos").alias("_first"))
    rows = departments.join(first, "department", "left")
    fault = F.when(F.coalesce(F.trim("department"), F.lit("")) == "", "empty").when(F.col("pos") > F.col("_first"), "listed_twice")
    return rows.withColumn("fault", fault).filter("fault is not null").select("pos", "fault")


def identity_faults(snapshots: DataFrame) -> DataFrame:
    """Snapshots (id, scene_id, epoch, seq) without a scene or with missing or negative numbers."""
    bad = (F.coalesce("scene_id", F.lit("")) == "") | (F.coalesce("epoch", F.lit(-1)) < 0) | (F.coalesce("seq", F.lit(-1)) < 0)
    return snapshots.filter(bad).select("id")
