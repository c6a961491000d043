"""Reading parts of the log: ranges, pages, searches, routing and kind flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Kind, create, structural, stage_sync, arc, imports, projection, managed, shared_stage, target.
KINDS = (
    ("erase_time_samples", False, True, True, False, False, "field_routed", True, True, "collaboration_layer"),
    ("ensure_prim", True, True, False, False, False, "project", True, False, "collaboration_layer"),
    ("ensure_xform_ops", False, True, False, False, False, "project", True, False, "collaboration_layer"),
    ("set_xform_trs", False, False, False, False, False, "project", True, False, "collaboration_layer"),
    ("delete_prim", False, False, False, False, False, "project", True, False, "collaboration_layer"),
    ("deactivate_prim", False, False, False, False, False, "project", True, False, "collaboration_layer"),
    ("rename_prim", False, False, False, False, False, "project", True, False, "collaboration_layer"),
    ("set_visibility", False, False, False, False, False, "project", True, False, "collaboration_layer"),
    ("set_gprim_attrs", False, False, False, False, False, "project", True, False, "collaboration_layer"),
    ("set_reference", False, True, True, True, True, "project", True, False, "collaboration_layer"),
    ("set_payload", False, True, True, True, False, "project", True, False, "collaboration_layer"),
    ("load_payload", False, True, True, False, True, "direct", True, False, "stage_state"),
    ("unload_payload", False, True, True, False, False, "direct", True, False, "stage_state"),
    ("set_variant_selections", False, True, True, True, False, "project", True, False, "collaboration_layer"),
    ("set_material_binding", False, True, True, False, False, "project", True, False, "collaboration_layer"),
    ("set_connectable_input", False, True, True, False, False, "project", True, False, "collaboration_layer"),
    ("set_connectable_connection", False, True, True, False, False, "project", True, False, "collaboration_layer"),
    ("set_stage_metadata", True, True, True, False, False, "direct", True, False, "session_layer"),
    ("set_instanceable", False, True, True, False, False, "project", True, False, "collaboration_layer"),
    ("set_point_instancer", False, False, False, False, False, "project", True, False, "collaboration_layer"),
    ("set_sdf_spec_fields", False, True, True, False, False, "field_routed", True, True, "collaboration_layer"),
    ("replace_sdf_layer_content", False, True, True, False, False, "direct", False, True, "collaboration_layer"),
    ("set_sublayers", False, True, True, False, False, "direct", False, True, "collaboration_layer"),
)


def kinds(spark: SparkSession) -> DataFrame:
    """The table of edit kinds with their flags; always 23 rows."""
    return spark.createDataFrame(KINDS, "k string, creates boolean, structural boolean, stage_sync boolean, arc boolean, imports boolean, projection string, managed boolean, shared_stage boolean, target string")


def _kinds_where(test) -> list[str]:
    return [row[0] for row in KINDS if test(row)]


def with_tier(log: DataFrame) -> DataFrame:
    """Adds tier: 0 creates, 1 other structural kinds, 2 values and deletions; unknown kinds have none."""
    k = F.col("k")
    tier = F.when(k.isin(*_kinds_where(lambda r: r[1])), 0).when(k.isin(*_kinds_where(lambda r: r[2])), 1).when(k.isin(*_kinds_where(lambda r: True)), 2)
    return log.withColumn("tier", tier)


def routing_layer(log: DataFrame) -> DataFrame:
    """Replaces layer_key by the empty key where the kind does not author into a collaboration layer; unknown kinds go."""
    k = F.col("k")
    own = k.isin(*_kinds_where(lambda r: r[9] == "collaboration_layer"))
    return log.filter(k.isin(*_kinds_where(lambda r: True))).withColumn("layer_key", F.when(own, F.col("layer_key")).otherwise(""))


def valid_in_mode(log: DataFrame, mode: str) -> DataFrame:
    """Edits whose kind is valid in managed or shared_stage mode."""
    return log.join(F.broadcast(kinds(log.sparkSession).filter(F.col(mode)).select("k")), "k", "left_semi")


def sequence_range(log: DataFrame, first: int, last: int | None = None) -> DataFrame:
    """Edits from first to last, both included; open above without last. The filter reaches the files."""
    return log.filter(F.col("seq").between(first, last) if last is not None else F.col("seq") >= first)


def searched(log: DataFrame, *, k: str = "", prim_contains: str = "") -> DataFrame:
    """Edits of a kind whose prim contains a pattern (% and _ are wildcards, case is ignored); empty arguments do not filter."""
    if k:
        log = log.filter(F.col("k") == k)
    return log.filter(F.col("prim").ilike(f"%{prim_contains}%")) if prim_contains else log


def page(log: DataFrame, *, offset: int = 0, limit: int = 50, newest_first: bool = True) -> DataFrame:
    """One page by seq, with the number of all rows as total."""
    total = log.agg(F.count("*").alias("total"))
    rows = log.orderBy(F.desc("seq") if newest_first else F.asc("seq")).offset(offset).limit(limit)
    return rows.join(F.broadcast(total))


def under_prefix(log: DataFrame, prefix: str, only: list[str]) -> DataFrame:
    """Edits of some kinds whose prim starts with a prefix; both filters reach the files."""
    return log.filter(F.col("prim").startswith(prefix) & F.col("k").isin(only))


def department_key(department: Column) -> Column:
    """The layer key of a department; without one the default layer's."""
    return F.when(F.coalesce(department, F.lit("")) == "", "default").otherwise(F.concat(F.lit("department:"), department))


def department_of(layer_key: Column) -> Column:
    """The department of a layer key, null for other keys."""
    return F.nullif(F.regexp_extract(layer_key, r"^department:(.+)$", 1), F.lit(""))


def layer_label(layer_key: Column) -> Column:
    return F.coalesce(department_of(layer_key), layer_key)


def is_sample_barrier(k: Column, fields: Column, removed: Column) -> Column:
    """Edits across which values written before must not be merged: erased samples, removed specs and replaced sample tables."""
    return F.coalesce((k == "erase_time_samples") | ((k == "set_sdf_spec_fields") & (F.coalesce(F.array_contains(fields, "timeSamples"), F.lit(False)) | F.coalesce(removed, F.lit(False)))), F.lit(False))


def is_exact_deletion(k: Column, removed: Column) -> Column:
    """Spec deltas that remove a spec, and erased samples."""
    return (k == "erase_time_samples") | ((k == "set_sdf_spec_fields") & F.coalesce(removed, F.lit(False)))


def batch_is_transforms(log: DataFrame, *batch: str) -> DataFrame:
    """Whether a batch holds transforms alone."""
    return log.groupBy(*batch).agg(F.every(F.col("k") == "set_xform_trs").alias("transform_only"))


def asset_paths(log: DataFrame) -> DataFrame:
    """seq, prim and asset_path of the assets that arcs bring in: explicit, or added, prepended or appended."""
    arcs = F.filter("arcs", lambda a: a["list_position"].isin("explicit", "added", "prepended", "appended") & (a["asset_path"] != ""))
    return log.filter(F.col("k").isin("set_reference", "set_payload")).select("seq", "prim", F.explode(arcs).alias("a")).select("seq", "prim", F.col("a.asset_path").alias("asset_path"))


def receivers_of(batches: DataFrame, receivers: DataFrame) -> DataFrame:
    """Which receiver gets which batch: its audience (all, layered, flat) fits and it is not the origin.

    `receivers` are the live connections, a bounded table that is broadcast.
    """
    fits = (F.col("audience") == "all") | (F.col("audience") == F.col("mode"))
    return batches.join(F.broadcast(receivers), fits & ~F.col("origin").eqNullSafe(F.col("receiver_id")))


def write_set(log: DataFrame) -> DataFrame:
    """Per transaction the prims that it writes or reads; whole is true where an edit concerns the whole layer."""
    touched = F.array_distinct(F.concat(F.array("prim"), F.when(F.col("new_name").isNotNull(), F.array(F.concat(F.regexp_replace("prim", "[^/]+$", ""), F.col("new_name")))).otherwise(F.array().cast("array<string>")), F.coalesce(F.transform(F.map_values("connections"), lambda c: c["prim"]), F.array().cast("array<string>"))))
    rows = log.select("client_id", "session_id", "txn_id", (F.col("k").isin("replace_sdf_layer_content", "set_sublayers")).alias("whole"), F.explode(touched).alias("path"))
    return rows.groupBy("client_id", "session_id", "txn_id", "path").agg(F.max("whole").alias("whole"))


def payload_loads(log: DataFrame) -> DataFrame:
    """Per transaction the paths whose payloads it loads, sorted and distinct; transactions without one are left out."""
    rows = log.filter("k = 'load_payload'").select("client_id", "session_id", "txn_id", "prim").distinct()
    return rows.groupBy("client_id", "session_id", "txn_id").agg(F.sort_array(F.collect_list("prim")).alias("paths"))


def outside_instances(log: DataFrame, prims: DataFrame) -> DataFrame:
    """Edits without those whose nearest existing ancestor is an instance. `prims`: scene_id, prim, is_instance; where it names a prim twice, any counts."""
    from ..functions.paths import ancestors

    held = log.select("scene_id", "prim").distinct().withColumn("_above", F.explode(ancestors(F.col("prim"))))
    there = prims.groupBy("scene_id", F.col("prim").alias("_above")).agg(F.max("is_instance").alias("_inside"))
    near = held.join(there, ["scene_id", "_above"]).groupBy("scene_id", "prim").agg(F.max_by("_inside", F.length("_above")).alias("_inside"))
    return log.join(near.filter("_inside").select("scene_id", "prim"), ["scene_id", "prim"], "left_anti")


def needs_read(dirty: DataFrame, channels: DataFrame) -> DataFrame:
    """Which channel reads which prim in this cycle. `dirty`: prim, attrs (null or empty: all is read); `channels`, a small table: channel, attrs, prefixes, resync_only.

    A channel reads if all is to be read, or if it is not for resyncs only and watches nothing in particular, a dirty attribute or a prefix of one.
    """
    all_of = F.coalesce(F.size("dirty"), F.lit(0)) <= 0
    nothing = F.array().cast("array<string>")
    names, starts = F.coalesce("attrs", nothing), F.coalesce("prefixes", nothing)
    hit = F.arrays_overlap("dirty", names) | F.exists("dirty", lambda a: F.exists(starts, lambda p: a.startswith(p)))
    reads = all_of | (~F.col("resync_only") & (((F.size(names) == 0) & (F.size(starts) == 0)) | hit))
    return dirty.withColumnRenamed("attrs", "dirty").crossJoin(F.broadcast(channels)).filter(F.coalesce(reads, F.lit(False))).select("prim", "channel")


def replicated_schemas(log: DataFrame, allowed: list[str]) -> DataFrame:
    """Edits whose applied schemas are cut to the allowed names; a multiple-apply schema name:instance counts by its name."""
    kept = F.filter("api_schemas", lambda s: F.substring_index(s, ":", 1).isin(*allowed))
    return log.withColumn("api_schemas", kept)


def first_encounters(log: DataFrame, *key: str) -> DataFrame:
    """The first edit of every key, which needs the structural prelude."""
    return log.groupBy(*key).agg(F.min("seq").alias("seq"))


