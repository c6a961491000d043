"""Composition: the strongest unmuted layer's opinion wins, and inside a layer the last edit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import lineage


def routed(log: DataFrame, layers: DataFrame) -> DataFrame:
    """Edits with their layer's rank and muting. `layers` is the scene's layer stack, a few rows, and is broadcast."""
    return log.join(F.broadcast(layers), "layer_key")


def unrouted(log: DataFrame, layers: DataFrame) -> DataFrame:
    """Edits whose layer key is missing or unknown."""
    return log.join(F.broadcast(layers), "layer_key", "left_anti")


LAYER = ["scene_id", "layer_key"]


def composed(log: DataFrame, layers: DataFrame) -> DataFrame:
    """scene_id, prim, field, time, value, layer_key, seq: one row for every composed value.

    Default values (null time) and time samples are separate domains; the strongest layer with any
    sample of a field owns all of its times. A deletion or rename takes away what its layer said before at its prim and below; other
    layers' opinions stay, and a weaker one's shows where a stronger one's was taken away. Edits are reduced to the last of a layer before
    deletions and layers are compared, so the shuffle carries one row a value and layer, not the log.
    """
    own = routed(log, layers.filter("not muted"))
    last = own.filter("field != ''").groupBy(*LAYER, "prim", "field", "time", "rank").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    last = last.join(_killed(last, _kills(own)), [*LAYER, "prim"], "left").filter("killed is null or seq > killed")
    domain = Window.partitionBy("scene_id", "prim", "field", F.col("time").isNull())
    return last.withColumn("_best", F.min("rank").over(domain)).filter("rank = _best").select("scene_id", "prim", "field", "time", "value", "layer_key", "seq")


def composed_twice(log: DataFrame, layers: DataFrame, upto: int) -> DataFrame:
    """scene_id, prim, field, time with old_value, composed from the edits up to a seq, and new_value from all; null where the state has none.

    Both states come from one aggregation of the log: of a layer the last edit, and the last up to the seq; of a path the last deletion, and the last up to the seq.
    """
    own = routed(log, layers.filter("not muted"))
    early = F.when(F.col("seq") <= upto, F.col("seq"))
    last = own.filter("field != ''").groupBy(*LAYER, "prim", "field", "time", "rank").agg(F.max_by("value", early).alias("_old"), F.max(early).alias("_at"), F.max_by("value", "seq").alias("_new"), F.max("seq").alias("seq"))
    last = last.join(_killed(last, _kills(own, early)), [*LAYER, "prim"], "left")
    was, is_ = F.coalesce(F.col("_at") > F.coalesce("killed_early", F.lit(-1)), F.lit(False)), F.col("seq") > F.coalesce("killed", F.lit(-1))
    return compared(last.withColumns({"_was": was, "_is": is_}))


def compared(last: DataFrame) -> DataFrame:
    """scene_id, prim, field, time, old_value, new_value, was and is of two composed states, from each layer's _old and _new value, its rank, and whether it stands in either (_was, _is)."""
    domain = Window.partitionBy("scene_id", "prim", "field", F.col("time").isNull())
    best = last.withColumns({"_r": F.when(F.col("_was"), F.col("rank")), "_s": F.when(F.col("_is"), F.col("rank"))}).withColumns({"_o": F.min("_r").over(domain), "_n": F.min("_s").over(domain)})
    best = best.filter("_r = _o or _s = _n")
    return best.groupBy("scene_id", "prim", "field", "time").agg(F.max_by("_old", F.when(F.expr("_r = _o"), 1)).alias("old_value"), F.max_by("_new", F.when(F.expr("_s = _n"), 1)).alias("new_value"), F.max(F.expr("_r = _o")).alias("was"), F.max(F.expr("_s = _n")).alias("is"))


def _kills(log: DataFrame, early: Column | None = None) -> DataFrame:
    """The last deletion or rename of each path in its layer, and the last that `early` (a seq or null) tells."""
    early = F.lit(None).cast("long") if early is None else early
    return log.filter(F.col("k").isin("delete_prim", "rename_prim")).groupBy(*LAYER, F.col("prim").alias("_above")).agg(F.max("seq").alias("killed"), F.max(early).alias("killed_early"))


def _killed(prims: DataFrame, kills: DataFrame) -> DataFrame:
    """For each prim and layer of `prims` the last of `kills` at or above it. The distinct prims are spread over their ancestors, not the edits."""
    spread = prims.select(*LAYER, "prim").distinct().withColumn("_above", F.explode(lineage(F.col("prim"))))
    return spread.join(kills, [*LAYER, "_above"]).groupBy(*LAYER, "prim").agg(F.max("killed").alias("killed"), F.max("killed_early").alias("killed_early"))


def tombstones(log: DataFrame) -> DataFrame:
    """For each prim that an edit names, in its layer, the last deletion or rename at or above it."""
    return _killed(log, _kills(log)).drop("killed_early")


def survivors(log: DataFrame) -> DataFrame:
    """Edits that no later deletion or rename at or above their prim, in the same layer, has undone."""
    dead = tombstones(log)
    return log.join(dead, [*LAYER, "prim"], "left").filter("killed is null or seq >= killed").drop("killed")


def opinions(log: DataFrame) -> DataFrame:
    """scene_id, layer_key, prim, field, time, value and seq: what each layer says by itself, deletions and renames applied."""
    last = log.filter("field != ''").groupBy(*LAYER, "prim", "field", "time").agg(F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"))
    return last.join(_killed(last, _kills(log)), [*LAYER, "prim"], "left").filter("killed is null or seq > killed").drop("killed", "killed_early")


def layer_opinions(log: DataFrame, layer_key: str) -> DataFrame:
    """One layer's own values, for export."""
    return opinions(log.filter(F.col("layer_key") == layer_key)).select("scene_id", "prim", "field", "time", "value")


def merged_into(log: DataFrame, source: str, target: str) -> DataFrame:
    """The target layer's values after the source layer was merged into it: the source's values win, others stay. What a layer deleted before is in neither."""
    own = opinions(log.filter(F.col("layer_key").isin(source, target)))
    return own.groupBy("scene_id", "prim", "field", "time").agg(F.max_by("value", F.col("layer_key") == source).alias("value")).withColumn("layer_key", F.lit(target))


def snapshot_manifest(layers: DataFrame, labels: DataFrame) -> DataFrame:
    """role, name and layer_key of a snapshot's files: the flattened scene, the root, and each unmuted layer with a name of its own."""
    own = layers.filter("not muted").join(labels, "layer_key", "left").withColumn("label", F.coalesce("label", "layer_key"))
    nth = F.row_number().over(Window.partitionBy("label").orderBy("rank"))
    named = own.select(F.lit("layer").alias("role"), F.concat("label", F.when(nth > 1, F.concat(F.lit("_"), nth.cast("string"))).otherwise(""), F.lit(".usda")).alias("name"), "layer_key")
    fixed = own.sparkSession.createDataFrame([("flattened", "flattened.usda", None), ("root", "root.usda", None)], "role string, name string, layer_key string")
    return fixed.unionByName(named)


def owned(values: DataFrame, log: DataFrame, layer_key: str) -> DataFrame:
    """Composed values of the fields that a layer itself has opinions on."""
    own = layer_opinions(log, layer_key).select("scene_id", "prim", "field").distinct()
    return values.join(own, ["scene_id", "prim", "field"], "left_semi")
