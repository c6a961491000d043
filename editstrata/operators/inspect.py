"""Inspection and metrics queries over the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.paths import depth, lineage, parent
from ..functions.scalars import frame_file
from .running import with_rank


def wire_metrics(log: DataFrame) -> DataFrame:
    """Number and bytes of edits by channel (layer_key) and kind, with totals by channel and over all; totals have nulls."""
    return log.rollup("layer_key", "k").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))


def wire_shares(log: DataFrame) -> DataFrame:
    """By kind: number, bytes, mean size as a whole number and share of all bytes in per cent, with its rank by bytes."""
    by = log.groupBy("k").agg(F.count("*").alias("n"), F.sum("n_bytes").alias("bytes"))
    whole = F.sum("bytes").over(Window.partitionBy())
    return by.select("k", "n", "bytes", F.expr("bytes div greatest(n, 1)").alias("mean_bytes"), F.round(100 * F.col("bytes") / whole, 4).alias("share"), F.row_number().over(Window.orderBy(F.desc("bytes"), "k")).alias("rank"))


def heads(log: DataFrame) -> DataFrame:
    """Per scene the greatest seq and the number of edits."""
    return log.groupBy("scene_id").agg(F.max("seq").alias("max_seq"), F.count("*").alias("n"))


def live_prims(log: DataFrame) -> DataFrame:
    """scene_id, prim, type_name and seq of prims that an edit made after the last deletion at or above, in any layer."""
    made = log.filter("k = 'ensure_prim'").groupBy("scene_id", "prim").agg(F.max("seq").alias("seq"))
    cuts = log.filter("k = 'delete_prim'").groupBy("scene_id", F.col("prim").alias("_above")).agg(F.max("seq").alias("_at"))
    spread = made.select("scene_id", "prim", F.explode(lineage(F.col("prim"))).alias("_above"))
    dead = spread.join(cuts, ["scene_id", "_above"]).groupBy("scene_id", "prim").agg(F.max("_at").alias("_at"))
    return made.join(dead, ["scene_id", "prim"], "left").filter("_at is null or seq > _at").drop("_at")


def scene_summary(prims: DataFrame) -> DataFrame:
    """By scene: prims and greatest depth."""
    return prims.groupBy("scene_id").agg(F.count("*").alias("n_prims"), F.max(depth(F.col("prim"))).alias("max_depth"))


def kind_histogram(log: DataFrame) -> DataFrame:
    return log.groupBy("scene_id", "k").agg(F.count("*").alias("n"))


def changes_since(log: DataFrame, since: int, limit: int) -> DataFrame:
    """The prims that changed after a seq, oldest change first, so many at most, with the number of all as total."""
    last = log.groupBy("scene_id", "prim").agg(F.max("seq").alias("last_seq")).filter(F.col("last_seq") > since)
    total = last.agg(F.count("*").alias("total"))
    return last.orderBy("last_seq", "scene_id", "prim").limit(limit).join(F.broadcast(total))


def path_page(prims: DataFrame, *, offset: int = 0, limit: int = 500) -> DataFrame:
    """One page of prims in depth-first order, with total and next_offset (null at the end)."""
    total = prims.agg(F.count("*").alias("total"))
    rows = prims.orderBy("scene_id", F.split("prim", "/")).offset(offset).limit(limit).join(F.broadcast(total))
    return rows.withColumn("next_offset", F.when(F.col("total") > offset + limit, F.lit(offset + limit)))


def stack_totals(stacks: DataFrame) -> DataFrame:
    """Samples by frame: inclusive (a frame counts once in a stack) and self (as the last frame)."""
    inclusive = stacks.select(F.explode(F.array_distinct("frames")).alias("frame"), "samples").groupBy("frame").agg(F.sum("samples").alias("inclusive"))
    leaf = stacks.select(F.element_at("frames", -1).alias("frame"), "samples").groupBy("frame").agg(F.sum("samples").alias("self"))
    return inclusive.join(leaf, "frame", "left").fillna(0, ["self"])


def top_frames(totals: DataFrame, n: int = 30) -> DataFrame:
    """The frames with most inclusive samples."""
    return totals.orderBy(F.desc("inclusive"), "frame").limit(n)


def nearest_ranks(rows: DataFrame, key: str, value: str) -> DataFrame:
    """By key: number, median, 95th percentile and greatest value, as values that occur: the sorted values at n div 2 and at 0.95 * (n - 1), rounded down.

    Ranks come from counts of equal values, so a key's values are not gathered.
    """
    counts = rows.groupBy(key, value).agg(F.count("*").alias("_n"))
    along = Window.partitionBy(key).orderBy(value)
    run = counts.withColumn("_upto", F.sum("_n").over(along)).withColumn("_all", F.sum("_n").over(Window.partitionBy(key)))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col(value)))
    return run.groupBy(key).agg(F.max("_all").alias("n"), at(F.expr("_all div 2")).alias("median"), at(F.floor((F.col("_all") - 1) * 0.95)).alias("p95"), F.max(value).alias("max"))


def clients(log: DataFrame, now, roles: DataFrame | None = None) -> DataFrame:
    """By client: edits and seconds since the last one, at a given time, and the role that `roles` (client_id, role) tells, else viewer."""
    rows = log.groupBy("client_id").agg(F.count("*").alias("n"), F.max("ts").alias("_last")).select("client_id", "n", F.round(F.unix_micros(now) / 1e6 - F.unix_micros("_last") / 1e6, 3).alias("idle_s"))
    if roles is None:
        return rows
    return rows.join(roles.select("client_id", "role"), "client_id", "left").fillna("viewer", ["role"])


def last_assignment(log: DataFrame) -> DataFrame:
    """The layer that each client wrote to last, by scene."""
    return log.groupBy("scene_id", "client_id").agg(F.max_by("layer_key", "seq").alias("layer_key"))


def layer_order(layers: DataFrame, wanted: list[str]) -> DataFrame:
    """Layers ranked anew: the wanted ones as listed, then the others as they were, the default last."""
    place = F.create_map(*(F.lit(x) for i, k in enumerate(wanted) for x in (k, i))) if wanted else F.create_map().cast("map<string,int>")
    at = place[F.col("layer_key")]
    order = [F.col("layer_key") == "default", at.isNull(), at, "rank"]
    return layers.select("layer_key", F.row_number().over(Window.orderBy(*order)).alias("rank"), "muted")


def order_faults(layers: DataFrame, wanted: DataFrame) -> DataFrame:
    """Keys that a wanted order lacks or does not know: layer_key and fault."""
    lacks = layers.select("layer_key").join(wanted.select("layer_key"), "layer_key", "left_anti").withColumn("fault", F.lit("missing"))
    unknown = wanted.select("layer_key").join(layers.select("layer_key"), "layer_key", "left_anti").withColumn("fault", F.lit("unknown"))
    return lacks.unionByName(unknown)


def bounds(points: DataFrame) -> DataFrame:
    """Bounds of every subtree: least and greatest coordinates of the points at or below each prim. `points`: scene_id, prim, x, y, z."""
    own = points.groupBy("scene_id", "prim").agg(*(f(c).alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    up = own.withColumn("root", F.explode(lineage(F.col("prim"))))
    return up.groupBy("scene_id", F.col("root").alias("prim")).agg(*(f(f"{c}_{n}").alias(f"{c}_{n}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))



def status(log: DataFrame, prims: DataFrame) -> DataFrame:
    """One row: edits, clients, live prims and layers."""
    row = log.agg(F.count("*").alias("n_edits"), F.countDistinct("client_id").alias("n_clients"), F.countDistinct("layer_key").alias("n_layers"))
    return row.join(F.broadcast(prims.agg(F.count("*").alias("n_prims")))).select("n_edits", "n_clients", "n_prims", "n_layers")


def layers_in_order(log: DataFrame, key: str) -> DataFrame:
    """By key the number of edits and the layers in the order in which they first occur; only first occurrences are gathered."""
    first = log.groupBy(key, "layer_key").agg(F.min("seq").alias("first"), F.count("*").alias("n"))
    return first.groupBy(key).agg(F.sum("n").alias("events"), F.array_join(F.array_sort(F.collect_list(F.struct("first", "layer_key"))).getField("layer_key"), ",").alias("layer_keys"))


def stack_rows(layers: DataFrame, log: DataFrame) -> DataFrame:
    """The layer stack with each layer's clients and values; layers without either are hidden."""
    use = log.groupBy("layer_key").agg(F.countDistinct("client_id").alias("n_clients"), F.count_if(F.col("field") != "").alias("n_values"))
    return layers.join(use, "layer_key", "left").fillna(0, ["n_clients", "n_values"]).filter("n_clients > 0 or n_values > 0")


def scene_overview(prims: DataFrame) -> DataFrame:
    """By scene: all and active prims, materials, greatest depth, instances and instancers. `prims`: scene_id, prim, material, inactive, instanceable, is_point_instancer."""
    is_true = lambda c: F.coalesce(F.col(c), F.lit(False))
    return prims.groupBy("scene_id").agg(F.count("*").alias("total"), F.count_if(~is_true("inactive")).alias("active"), F.count_distinct("material").alias("materials"), F.max(depth(F.col("prim"))).alias("max_depth"), F.count_if(is_true("instanceable")).alias("instances"), F.count_if(is_true("is_point_instancer")).alias("instancers"))


def type_histogram(prims: DataFrame) -> DataFrame:
    return prims.groupBy("scene_id", "type_name").agg(F.count("*").alias("n"))


def listed(prims: DataFrame, *, under: str = "/", type_name: str = "", is_a: str = "", hierarchy: DataFrame | None = None, depth_limit: int = 0) -> DataFrame:
    """Prims below a root, of exactly a type, of a type or one derived from it, and at most so many levels below the root; empty arguments do not filter.

    `hierarchy`: type_name, base, a row for each type and each of its bases, itself included; a small table, broadcast.
    """
    top = under.rstrip("/")
    rows = prims.filter(F.col("prim").startswith(f"{top}/"))
    if type_name:
        rows = rows.filter(F.col("type_name") == type_name)
    if is_a:
        rows = rows.join(F.broadcast(hierarchy.filter(F.col("base") == is_a).select("type_name").distinct()), "type_name", "left_semi")
    if depth_limit:
        rows = rows.filter(depth(F.col("prim")) - top.count("/") <= depth_limit)
    return rows


def details(prims: DataFrame, sections: list[str]) -> DataFrame:
    """scene_id, prim and the wanted sections of it; the others are not read."""
    return prims.select("scene_id", "prim", *sections)


def bounded_children(prims: DataFrame, *, most: int = 64) -> DataFrame:
    """By parent the number of children and the first of their names in order. Ranks are worked out in parts, so only names that stay are gathered."""
    rows = prims.select("scene_id", parent(F.col("prim")).alias("parent"), F.substring_index("prim", "/", -1).alias("name"))
    counts = rows.groupBy("scene_id", "parent").agg(F.count("*").alias("n_children"))
    first = with_rank(rows, ["scene_id", "parent"], ["name"], "nth").filter(F.col("nth") <= most)
    names = first.groupBy("scene_id", "parent").agg(F.sort_array(F.collect_list("name")).alias("children"))
    return counts.join(names, ["scene_id", "parent"])


def array_rows(attributes: DataFrame, item: str, *, most: int = 16) -> DataFrame:
    """Array attributes (items and other columns) as type, size, a sample of the first items and cut: whether there are more."""
    size = F.size("items").cast("long")
    rest = [c for c in attributes.columns if c != "items"]
    return attributes.select(*rest, F.lit(f"{item}[]").alias("type"), size.alias("size"), F.slice("items", 1, most).alias("items"), (size > most).alias("cut"))


def authored_transforms(prims: DataFrame) -> DataFrame:
    """Prims with a transform of their own (t, r or s, arrays), rounded to five places."""
    rows = prims.filter("t is not null or r is not null or s is not null")
    return rows.withColumns({f: F.transform(f, lambda x: F.round(x, 5)) for f in "trs"})


def instancer_summary(rows: DataFrame) -> DataFrame:
    """Per instancer its prototypes, instances, animated arrays and hidden instances. `rows`: prim, field, time, n (length), targets (prototypes' paths), of the state as it is.

    Instances are counted by the untimed prototype indices, else by the first sample; an array is animated if it has a sample.
    """
    indices = F.col("field") == "proto_indices"
    first = F.min_by("n", F.when(indices, F.struct(F.col("time").isNotNull().alias("timed"), "time")))
    return rows.groupBy("prim").agg(
        F.sort_array(F.array_distinct(F.flatten(F.collect_set(F.when(F.col("field") == "prototypes", F.col("targets")))))).alias("prototypes"),
        F.coalesce(first, F.lit(0)).alias("instances"),
        F.sort_array(F.collect_set(F.when(F.col("time").isNotNull(), F.col("field")))).alias("animated"),
        F.max(F.when(F.col("field") == "inactive_ids", F.col("n"))).alias("inactive"),
    )


def flat_replay(layers: DataFrame, departments: DataFrame) -> DataFrame:
    """One row: whether a receiver without layers can mirror the scene, and why not. `layers`: layer_key, muted; `departments`: department, the priority list."""
    state = layers.agg(F.count("*").alias("n"), F.max("muted").alias("muted")).crossJoin(departments.agg(F.count("*").alias("d")))
    reason = F.when(F.col("d") > 0, "departments need layered replay").when(F.col("n") != 1, "several layers need layered replay").when(F.col("muted"), "muted layers need layered replay").otherwise("")
    return state.select((reason == "").alias("admissible"), reason.alias("reason"))


def with_unmanaged(stacks: DataFrame) -> DataFrame:
    """Sublayers after a managed block is set: the managed paths in order, then the present ones that are not managed. `stacks`: scene_id, current, managed, known (all managed identifiers)."""
    return stacks.withColumn("sublayers", F.concat("managed", F.filter("current", lambda p: ~F.array_contains("known", p))))


def status_with_instances(log: DataFrame, prims: DataFrame) -> DataFrame:
    """status() with the number of instances; `prims` has instanceable."""
    more = prims.agg(F.count_if(F.coalesce("instanceable", F.lit(False))).alias("n_instances"))
    return status(log, prims).join(F.broadcast(more))


def file_totals(stacks: DataFrame) -> DataFrame:
    """Inclusive samples by source file: a file counts once in a stack; frames without one are left out."""
    files = F.array_distinct(F.array_compact(F.transform("frames", frame_file)))
    return stacks.select(F.explode(files).alias("file"), "samples").groupBy("file").agg(F.sum("samples").alias("inclusive"))


def workload(transactions: DataFrame) -> DataFrame:
    """By department: transactions, transactions a second between the first and the last, and median, 95th percentile and greatest latency. `transactions`: department, at (seconds), latency."""
    counts = transactions.groupBy("department").agg(F.count("*").alias("transactions"), (F.max("at") - F.min("at")).alias("_span"))
    ranks = nearest_ranks(transactions, "department", "latency")
    return counts.join(ranks, "department").select("department", "transactions", F.when(F.col("_span") > 0, F.col("transactions") / F.col("_span")).alias("throughput"), "median", "p95", "max")


def boxes(prims: DataFrame, bounds_of: DataFrame) -> DataFrame:
    """For each prim (scene_id, prim) the center and size of its bounds, and empty: whether nothing at or below it has a point."""
    rows = prims.select("scene_id", "prim").join(bounds_of, ["scene_id", "prim"], "left")
    middle = {f"{c}_center": (F.col(f"{c}_min") + F.col(f"{c}_max")) / 2 for c in "xyz"}
    size = {f"{c}_size": F.col(f"{c}_max") - F.col(f"{c}_min") for c in "xyz"}
    return rows.withColumns(middle | size | {"empty": F.col("x_min").isNull()})


def bindings(log: DataFrame) -> DataFrame:
    """The present material of each prim by purpose; an empty path unbinds."""
    last = log.filter("k = 'set_material_binding'").groupBy("scene_id", "layer_key", "prim", F.coalesce("material_purpose", F.lit("")).alias("purpose")).agg(F.max_by("material_path", "seq").alias("material"))
    return last.filter("material <> ''")
