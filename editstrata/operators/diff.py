"""Change data: what turns one keyed state into another.

Every channel is `state_diff` with its own key, values and rules; all of them are one full outer
join on the key, in which a null time is a key value like others.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import typed
from ..functions.paths import ancestors, depth, lineage, parent
from ..sources.shared import written
from .running import with_rank


def state_diff(before: DataFrame, after: DataFrame, keys: list[str], values: list[str], same: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Rows of keys with change (create, change, remove), and old_ and new_ values; equal rows are left out.

    Keys may be null: nulls are equal. `same` compares two values; without it nulls, arrays and typed values compare by content.
    """
    equal = lambda v: same or (typed.same if typed.is_typed(after.schema[v].dataType) else lambda a, b: a.eqNullSafe(b))
    a = before.select(*(F.col(k).alias(f"_a_{k}") for k in keys), *(F.col(v).alias(f"old_{v}") for v in values), F.lit(True).alias("_old"))
    b = after.select(*(F.col(k).alias(f"_b_{k}") for k in keys), *(F.col(v).alias(f"new_{v}") for v in values), F.lit(True).alias("_new"))
    both = a.join(b, [F.col(f"_a_{k}").eqNullSafe(F.col(f"_b_{k}")) for k in keys], "full")
    change = F.when(F.col("_old").isNull(), "create").when(F.col("_new").isNull(), "remove").otherwise("change")
    differs = F.lit(False)
    for v in values:
        differs = differs | ~F.coalesce(equal(v)(F.col(f"old_{v}"), F.col(f"new_{v}")), F.lit(False))
    rows = both.withColumn("change", change).filter((F.col("change") != "change") | differs)
    return rows.select(*(F.coalesce(f"_a_{k}", f"_b_{k}").alias(k) for k in keys), "change", *(f"old_{v}" for v in values), *(f"new_{v}" for v in values))


def value_changes(states: DataFrame) -> DataFrame:
    """As state_diff, from both states side by side: the keys, old_value, new_value, was and is (whether a state has the key)."""
    was, is_ = F.coalesce("was", F.lit(False)), F.coalesce("is", F.lit(False))
    change = F.when(~was, "create").when(~is_, "remove").otherwise("change")
    old, new = F.col("old_value"), F.col("new_value")
    equal = typed.same(old, new) if typed.is_typed(states.schema["new_value"].dataType) else old.eqNullSafe(new)
    return states.withColumn("change", change).filter((was | is_) & ((F.col("change") != "change") | ~equal)).drop("was", "is")


@dataclass(frozen=True)
class Channel:
    """A diff channel: the state's key and values, which changes are told, and those that are not worth telling."""

    name: str
    kind: str
    keys: tuple[str, ...]
    values: tuple[str, ...]
    changes: tuple[str, ...] = ("create", "change", "remove")
    silent: str = "false"

    def diff(self, before: DataFrame, after: DataFrame) -> DataFrame:
        rows = state_diff(before, after, list(self.keys), list(self.values))
        return rows.filter(F.col("change").isin(*self.changes)).filter(f"not coalesce({self.silent}, false)").withColumn("k", F.lit(self.kind))


#: The channels that differ in key, values or rules alone; users add their own.
CHANNELS = {
    c.name: c
    for c in (
        Channel("attributes", "set_gprim_attrs", ("scene_id", "prim", "time", "field"), ("value",), ("create", "change")),
        Channel("transforms", "set_xform_trs", ("scene_id", "prim", "time", "field"), ("value",), ("create", "change")),
        Channel("instancers", "set_point_instancer", ("scene_id", "prim", "time", "field"), ("fingerprint",)),
        Channel("variants", "set_variant_selections", ("scene_id", "prim", "variant_set"), ("selection",)),
        Channel("materials", "set_material_binding", ("scene_id", "prim", "purpose"), ("material",)),
        Channel("inputs", "set_connectable_input", ("scene_id", "prim", "time", "input"), ("value",), ("create", "change")),
        Channel("connections", "set_connectable_connection", ("scene_id", "prim", "local_attr"), ("source",)),
        Channel("arcs", "set_reference", ("scene_id", "prim", "kind"), ("arcs",)),
        Channel("active", "deactivate_prim", ("scene_id", "prim"), ("active",), ("create", "change"), "change = 'create' and new_active"),
        Channel("visibility", "set_visibility", ("scene_id", "prim", "time"), ("visible",), ("create", "change")),
        Channel("instanceable", "set_instanceable", ("scene_id", "prim"), ("instanceable",), ("create", "change"), "change = 'create' and not new_instanceable"),
        Channel("payloads", "load_payload", ("scene_id", "prim"), ("loaded",), ("create", "change")),
        Channel("metadata", "set_stage_metadata", ("scene_id", "key"), ("value",), ("create", "change")),
        Channel("specs", "set_sdf_spec_fields", ("scene_id", "spec_kind", "spec_path", "field"), ("value",)),
        Channel("topology", "set_sublayers", ("parent_key",), ("sublayers",)),
        Channel("samples", "erase_time_samples", ("scene_id", "prim", "field", "time"), ("fingerprint",)),
    )
}


def lifecycle(before: DataFrame, after: DataFrame) -> DataFrame:
    """ensure_prim and delete_prim of two states (scene_id, prim, type_name), with nth: deletions from below, then creations from above.

    A prim of another type is deleted and made again.
    """
    rows = state_diff(before, after, ["scene_id", "prim"], ["type_name"])
    gone = rows.filter("change <> 'create'").select("scene_id", "prim", F.lit("delete_prim").alias("k"), F.lit(None).cast("string").alias("type_name"))
    made = rows.filter("change <> 'remove'").select("scene_id", "prim", F.lit("ensure_prim").alias("k"), F.col("new_type_name").alias("type_name"))
    both = gone.unionByName(made)
    deep = depth(F.col("prim"))
    order = [F.col("k") == "ensure_prim", F.when(F.col("k") == "delete_prim", -deep).otherwise(deep), "prim"]
    return with_rank(both, ["scene_id"], order, "nth")


def erased_samples(before: DataFrame, after: DataFrame) -> DataFrame:
    """Times that an attribute's samples lost: scene_id, prim, field, time. Untimed values are no samples."""
    timed = [df.filter("time is not null") for df in (before, after)]
    return timed[0].join(timed[1].select("scene_id", "prim", "field", "time"), ["scene_id", "prim", "field", "time"], "left_anti").select("scene_id", "prim", "field", "time")


def valid_renames(pairs: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Rename pairs (scene_id, old, new) whose old prim existed and is gone, and whose new one did not and does."""
    key = lambda df, c: df.select("scene_id", F.col("prim").alias(c))
    kept = pairs.join(key(before, "old"), ["scene_id", "old"], "left_semi").join(key(after, "old"), ["scene_id", "old"], "left_anti")
    return kept.join(key(after, "new"), ["scene_id", "new"], "left_semi").join(key(before, "new"), ["scene_id", "new"], "left_anti")


def with_cleared_variants(before: DataFrame, after: DataFrame) -> DataFrame:
    """The variant selections to send: changed ones, and an empty selection for sets that went."""
    rows = CHANNELS["variants"].diff(before, after)
    return rows.select("scene_id", "prim", "variant_set", F.coalesce("new_selection", F.lit("")).alias("selection"))


def snapshot_analysis(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row a scene: counts of prims before and after, created, removed and retyped, and whether the upload looks destructively incomplete.

    It does if prims went and the upload is empty, or a prim near the root other than /Root went, or at least four fifths of ten prims or more.
    """
    rows = state_diff(before, after, ["scene_id", "prim"], ["type_name"])
    changes = rows.groupBy("scene_id").agg(
        F.count_if(F.col("change") == "create").alias("created"),
        F.count_if(F.col("change") == "remove").alias("removed"),
        F.count_if(F.col("change") == "change").alias("type_changed"),
        F.max((F.col("change") == "remove") & (depth(F.col("prim")) <= 1) & (F.col("prim") != "/Root")).alias("_top"),
    )
    counts = before.groupBy("scene_id").agg(F.count("*").alias("n_before")).join(after.groupBy("scene_id").agg(F.count("*").alias("n_after")), "scene_id", "full")
    out = counts.join(changes, "scene_id", "left").fillna(0, ["n_before", "n_after", "created", "removed", "type_changed"])
    bad = (F.col("removed") > 0) & ((F.col("n_after") == 0) | F.coalesce("_top", F.lit(False)) | ((F.col("n_before") >= 10) & (F.col("removed") >= 0.8 * F.col("n_before"))))
    return out.withColumn("destructive", bad).drop("_top")


def deactivations(before: DataFrame, after: DataFrame) -> DataFrame:
    """deactivate_prim edits (flag false) for the topmost prims that an upload left out; what is below one goes with it. Their last type is told along."""
    gone = state_diff(before, after, ["scene_id", "prim"], ["type_name"]).filter("change = 'remove'").select("scene_id", "prim", F.col("old_type_name").alias("type_name"))
    return minimal_roots(gone).withColumns({"k": F.lit("deactivate_prim"), "flag": F.lit(False)})


def snapshot_status(uploads: DataFrame) -> DataFrame:
    """Adds status, the first check that fails: layers, metadata, scene, token, sublayers, content; else accepted.

    `uploads`: extra_layers, has_metadata, scene_id, own_scene_id, epoch, seq, own_epoch, own_seq, has_sublayers, destructive, reject_stale, reject_ambiguous.
    """
    stale = (F.col("epoch") < F.col("own_epoch")) | ((F.col("epoch") == F.col("own_epoch")) & (F.col("seq") < F.col("own_seq")))
    future = (F.col("epoch") > F.col("own_epoch")) | ((F.col("epoch") == F.col("own_epoch")) & (F.col("seq") > F.col("own_seq")))
    status = F.when(F.col("extra_layers"), "non_default_layers").when(~F.col("has_metadata"), "missing_metadata").when(F.col("scene_id") != F.col("own_scene_id"), "other_scene").when(future, "future_token").when(stale & F.col("reject_stale"), "stale_token").when(F.col("has_sublayers"), "sublayers").when(F.col("destructive") & F.col("reject_ambiguous"), "ambiguous").otherwise("accepted")
    return uploads.withColumn("status", status)


def minimal_roots(paths: DataFrame) -> DataFrame:
    """Paths (scene_id, prim) that are not below another listed one."""
    below = paths.select("scene_id", "prim", F.explode(ancestors(F.col("prim"))).alias("_above"))
    covered = below.join(paths.select("scene_id", F.col("prim").alias("_above")), ["scene_id", "_above"], "left_semi").select("scene_id", "prim").distinct()
    return paths.join(covered, ["scene_id", "prim"], "left_anti")


def owning_roots(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """The nearest root at or above each path; null without one."""
    spread = paths.select("scene_id", "prim").distinct().withColumn("root", F.explode(lineage(F.col("prim"))))
    near = spread.join(roots.select("scene_id", F.col("prim").alias("root")).distinct(), ["scene_id", "root"]).groupBy("scene_id", "prim").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(near, ["scene_id", "prim"], "left")


def deferred_lifecycle(rows: DataFrame, controls: DataFrame) -> DataFrame:
    """Adds nth: lifecycle edits below a controlled root come right after the root's last arc edit. `rows`: scene_id, seq, k, prim; `controls`: scene_id, prim, seq."""
    last = controls.groupBy("scene_id", "prim").agg(F.max("seq").alias("_at"))
    owned = owning_roots(rows, last).join(last.select("scene_id", F.col("prim").alias("root"), "_at"), ["scene_id", "root"], "left")
    moves = F.col("k").isin("ensure_prim", "delete_prim", "rename_prim") & (F.col("_at") > F.col("seq")) & (F.col("prim") != F.col("root"))
    at = F.when(F.coalesce(moves, F.lit(False)), F.col("_at")).otherwise(F.col("seq"))
    return with_rank(owned.withColumn("_pos", at), ["scene_id"], ["_pos", at != F.col("seq"), "seq"], "nth").drop("_at", "_pos")


def missing_ancestors(log: DataFrame, existing: DataFrame) -> DataFrame:
    """Paths (scene_id, prim) above edits' prims that do not exist and must be made first, with their depth."""
    need = log.select("scene_id", F.explode(ancestors(F.col("prim"))).alias("prim")).distinct()
    return need.join(existing.select("scene_id", "prim"), ["scene_id", "prim"], "left_anti").withColumn("depth", depth(F.col("prim")))


def same_content(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows as often."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def tree(prims: DataFrame) -> DataFrame:
    """The prims (scene_id, prim and others, as instanceable and is_point_instancer) with parent, depth, n_children and has_children."""
    rows = prims.withColumn("parent", parent(F.col("prim"))).withColumn("depth", depth(F.col("prim")))
    counts = rows.groupBy("scene_id", F.col("parent").alias("prim")).agg(F.count("*").alias("n_children"))
    return rows.join(counts, ["scene_id", "prim"], "left").fillna(0, ["n_children"]).withColumn("has_children", F.col("n_children") > 0)


#: The order of spec kinds among removals (first what is inside) and among creations (first what holds others).
REMOVE_ORDER = ("attribute", "relationship", "variant", "variantSet", "prim", "layer")
CREATE_ORDER = ("layer", "prim", "variantSet", "variant", "attribute", "relationship")


def spec_delta_order(rows: DataFrame) -> DataFrame:
    """Adds nth to spec edits (scene_id, seq, spec_path, spec_kind, removed): removals from below, by kind, then creations from above, by kind."""
    gone = F.coalesce("removed", F.lit(False))
    deep = depth(F.substring_index("spec_path", ".", 1)) + F.col("spec_path").contains(".").cast("int")
    place = lambda order: F.array_position(F.array(*map(F.lit, order)), F.col("spec_kind"))
    return with_rank(rows, ["scene_id"], [~gone, F.when(gone, -deep).otherwise(deep), F.when(gone, place(REMOVE_ORDER)).otherwise(place(CREATE_ORDER)), "spec_path", "seq"], "nth")


def authored_paths(log: DataFrame) -> DataFrame:
    """The distinct paths that each layer authored, with the last seq and nth: from the top, then by name."""
    rows = log.groupBy("scene_id", "layer_key", "prim").agg(F.max("seq").alias("last"))
    return with_rank(rows, ["scene_id", "layer_key"], [depth(F.col("prim")), "prim"], "nth")


def snapshot_events(values: DataFrame, prims: DataFrame) -> DataFrame:
    """A composed state as a stream of edits, as if newly authored: prims from above, then values; scene_id, nth, k, prim, type_name, field, time, value.

    `values`: scene_id, prim, field, time, value; `prims`: scene_id, prim, type_name. Values of prims that are not there are left out.
    """
    nothing = values.limit(0)
    changes = state_diff(nothing, values, ["scene_id", "prim", "field", "time"], ["value"]).join(prims.select("scene_id", "prim"), ["scene_id", "prim"], "left_semi")
    kind = F.when(F.col("field").isin("t", "r", "s"), "set_xform_trs").when(F.col("field") == "visibility", "set_visibility").otherwise("set_gprim_attrs")
    text, number = F.lit(None).cast("string"), F.lit(None).cast("double")
    made = prims.select("scene_id", F.lit("ensure_prim").alias("k"), "prim", "type_name", text.alias("field"), number.alias("time"), number.alias("value"))
    told = changes.select("scene_id", kind.alias("k"), "prim", text.alias("type_name"), "field", "time", F.col("new_value").alias("value"))
    order = [F.col("k") != "ensure_prim", F.when(F.col("k") == "ensure_prim", depth(F.col("prim"))).otherwise(0), "prim", F.coalesce("field", F.lit("")), F.col("time").isNotNull(), F.coalesce("time", F.lit(0.0))]
    return with_rank(made.unionByName(told), ["scene_id"], order, "nth")


def connectable_changes(before: DataFrame, after: DataFrame, shaders_before: DataFrame, shaders_after: DataFrame) -> DataFrame:
    """Changed inputs (scene_id, prim, time, input, value); of a shader whose info_id changed, all it has now. `shaders_*`: scene_id, prim, info_id."""
    keys = ["scene_id", "prim", "time", "input"]
    changed = CHANNELS["inputs"].diff(before, after).select(*keys, F.col("new_value").alias("value"))
    remade = state_diff(shaders_before, shaders_after, ["scene_id", "prim"], ["info_id"]).filter("change = 'change'").select("scene_id", "prim")
    return changed.unionByName(after.select(*keys, "value").join(remade, ["scene_id", "prim"], "left_semi")).distinct()


def transform_events(changes: DataFrame, with_ops: DataFrame) -> DataFrame:
    """Transform changes as edits in order (nth): ensure_xform_ops once for each prim that has none, then its values, default time first; prims from above.

    `changes`: scene_id, prim, time, field, value; `with_ops`: scene_id, prim.
    """
    first = changes.select("scene_id", "prim").distinct().join(with_ops.select("scene_id", "prim").distinct(), ["scene_id", "prim"], "left_anti")
    number, text = F.lit(None).cast("double"), F.lit(None).cast("string")
    made = first.select("scene_id", "prim", F.lit("ensure_xform_ops").alias("k"), number.alias("time"), text.alias("field"), number.alias("value"))
    rows = made.unionByName(changes.select("scene_id", "prim", F.lit("set_xform_trs").alias("k"), "time", "field", "value"))
    return with_rank(rows, ["scene_id"], [depth(F.col("prim")), "prim", F.col("k") != "ensure_xform_ops", F.col("time").isNotNull(), F.coalesce("time", F.lit(0.0)), F.coalesce("field", F.lit(""))], "nth")


def unowned_attributes(before: DataFrame, after: DataFrame, owned: list[str], same: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Changed default attributes (scene_id, prim, field, value) without the names, or name spaces ending in :, that other channels own; `same` may compare with a tolerance."""
    theirs = F.lit(False)
    for name in owned:
        theirs = theirs | (F.col("field").startswith(name) if name.endswith(":") else F.col("field") == name)
    return state_diff(before.filter(~theirs), after.filter(~theirs), ["scene_id", "prim", "field"], ["value"], same).filter("change <> 'remove'")
