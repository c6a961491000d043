"""Graphs of layers, shaders and assets, and as-of reads of time samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written
from .renames import moved
from .reduce import alive


#: Steps after which the nodes met so far are made one table again.
_MERGE = 20


def reachable(edges: DataFrame, roots: DataFrame, most_steps: int | None = None) -> DataFrame:
    """Nodes that are reachable from the roots, with the number of steps. `edges`: parent, child; `roots`: node.

    The frontier alone is joined in each step, and nodes met before are left out, so cycles end. Steps go on until
    no node is new; where that takes more than most_steps, if given, an error is raised. Frontiers are saved.
    """
    seen = front = roots.select("node").distinct().withColumn("steps", F.lit(0))
    step = 0
    while True:
        step += 1
        new = written(front.join(edges, front["node"] == edges["parent"]).select(F.col("child").alias("node")).distinct().join(seen.select("node"), "node", "left_anti").withColumn("steps", F.lit(step)), "front")
        if new.isEmpty():
            return seen
        if most_steps is not None and step > most_steps:
            raise RuntimeError(f"nodes more than {most_steps} steps from the roots")
        seen = seen.unionByName(new)
        if step % _MERGE == 0:
            seen = written(seen.coalesce(int(seen.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "seen")
        front = new


def graph_faults(edges: DataFrame, declared: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Edges to layers that are not declared, keys declared twice, and roots (layer_key) that are not declared: layer_key and fault."""
    keys = declared.select("layer_key").distinct()
    loose = edges.select(F.col("child").alias("layer_key")).distinct().join(keys, "layer_key", "left_anti").withColumn("fault", F.lit("undeclared"))
    twice = declared.groupBy("layer_key").count().filter("count > 1").select("layer_key", F.lit("declared_twice").alias("fault"))
    out = loose.unionByName(twice)
    if roots is not None:
        out = out.unionByName(roots.select("layer_key").distinct().join(keys, "layer_key", "left_anti").withColumn("fault", F.lit("undeclared_root")))
    return out


def flattened_inputs(connections: DataFrame) -> DataFrame:
    """Follows connections (prim, attr, source_prim, source_attr) from input to input until one has no source: prim, attr, source_prim, source_attr, hops.

    Pointers are doubled: each round joins the saved table with itself, so chains of n hops take log n rounds, until all have
    ended. A chain of more hops than there are inputs has met one twice: cycles, and what leads into them, are left out.
    """
    now = written(connections.select("prim", "attr", "source_prim", "source_attr", F.lit(1).cast("long").alias("hops")), "hops")
    most = now.select("prim", "attr").distinct().count()
    hops, ended = 1, False
    while hops <= most and not ended:
        on = now.select(F.col("prim").alias("source_prim"), F.col("attr").alias("source_attr"), F.col("source_prim").alias("_p"), F.col("source_attr").alias("_a"), F.col("hops").alias("_h"))
        after = written(now.join(on, ["source_prim", "source_attr"], "left").select("prim", "attr", F.coalesce("_p", "source_prim").alias("source_prim"), F.coalesce("_a", "source_attr").alias("source_attr"), (F.col("hops") + F.coalesce("_h", F.lit(0))).alias("hops"), F.col("_h").isNotNull().alias("_on")), "hops")
        ended = after.filter("_on").isEmpty()
        now = after.drop("_on")
        hops *= 2
    return now.filter(F.col("hops") <= most)


def one_hop(requests: DataFrame, connections: DataFrame) -> DataFrame:
    """The inner source of a node graph's output, or the output itself where nothing is connected."""
    on = connections.select("prim", "attr", F.col("source_prim").alias("_p"), F.col("source_attr").alias("_a"))
    return requests.join(on, ["prim", "attr"], "left").select("prim", "attr", F.coalesce("_p", "prim").alias("source_prim"), F.coalesce("_a", "attr").alias("source_attr"))


def dangling_sources(connections: DataFrame, prims: DataFrame) -> DataFrame:
    """Connections whose source prim neither exists nor is made in the batch."""
    return connections.join(prims.select(F.col("prim").alias("source_prim")).distinct(), "source_prim", "left_anti")


def arc_assets(arcs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """The latest arc of each (scene, k, layer, prim) with its resolved asset, and pending where the catalogue has none."""
    last = arcs.groupBy("scene_id", "k", "layer_key", "prim").agg(F.max_by("asset_path", "seq").alias("asset_path"))
    return last.join(catalogue.select("asset_path", "resolved"), "asset_path", "left").withColumn("pending", F.col("resolved").isNull())


def arc_dependencies(log: DataFrame, catalogue: DataFrame) -> DataFrame:
    """arc_assets() of the arcs that live: those of deleted or renamed prims, and of what was below them, no longer count. `log` is one of all kinds."""
    living = alive(log).filter("not dead and k in ('set_reference', 'set_payload')")
    arcs = living.select("scene_id", "k", "layer_key", "prim", "seq", F.explode("arcs").alias("a")).select("scene_id", "k", "layer_key", "prim", "seq", F.col("a.asset_path").alias("asset_path"))
    return arc_assets(arcs, catalogue)


def refreshed_arcs(arcs: DataFrame, old: DataFrame, new: DataFrame) -> DataFrame:
    """Arcs whose asset resolves otherwise than before."""
    a = old.select("asset_path", F.col("resolved").alias("_old"))
    b = new.select("asset_path", F.col("resolved").alias("_new"))
    return arcs.join(a, "asset_path", "left").join(b, "asset_path", "left").filter("not (_old <=> _new)").drop("_old").withColumnRenamed("_new", "resolved")


def samples_at(samples: DataFrame, probes: DataFrame) -> DataFrame:
    """Values of attributes at time codes: the held value (last sample at or before, else the first after) and the linear blend.

    `samples`: scene_id, prim, field, time, value; `probes`: scene_id, prim, field, at. Samples and probes are merged and
    read along time in one window, so nothing is joined by range.
    """
    key = ["scene_id", "prim", "field"]
    both = samples.select(*key, F.col("time").alias("_t"), "value", F.lit(0).alias("_probe")).unionByName(probes.distinct().select(*key, F.col("at").alias("_t"), F.lit(None).cast("double").alias("value"), F.lit(1).alias("_probe")))
    up = Window.partitionBy(*key).orderBy("_t", "_probe")
    both = both.withColumn("_mark", F.when(F.col("_probe") == 0, F.struct(F.col("_t").alias("t"), F.col("value").alias("v"))))
    after = F.expr(f"lead(_mark, 1) IGNORE NULLS OVER (PARTITION BY {', '.join(key)} ORDER BY _t, _probe)")  # one sort for both sides
    both = both.withColumns({"_a": F.last("_mark", True).over(up), "_b": after}).filter("_probe = 1")
    share = (F.col("_t") - F.col("_a.t")) / (F.col("_b.t") - F.col("_a.t"))
    linear = F.when(F.col("_a").isNull(), F.col("_b.v")).when(F.col("_b").isNull() | (F.col("_a.t") == F.col("_t")), F.col("_a.v")).otherwise(F.col("_a.v") + share * (F.col("_b.v") - F.col("_a.v")))
    return both.select(*key, F.col("_t").alias("at"), F.coalesce(F.col("_a.v"), F.col("_b.v")).alias("held"), linear.alias("linear"))


def instances_of(arcs: DataFrame, prims: DataFrame) -> DataFrame:
    """How many prims refer to each prototype inside the scene. `arcs`: scene_id, prim, asset_path, prim_path."""
    inner = arcs.filter("asset_path = ''").select("scene_id", F.col("prim_path").alias("prototype"), "prim")
    return inner.join(prims.select("scene_id", F.col("prim").alias("prototype")), ["scene_id", "prototype"]).groupBy("scene_id", "prototype").agg(F.countDistinct("prim").alias("instances"))


def expanded_instancers(rows: DataFrame, hidden: DataFrame) -> DataFrame:
    """One row an instance: prim, id, prototype, position, orientation and scale. `rows`: prim, prototypes, proto_indices, ids, positions, orientations, scales (flat, of 3, 4 and 3 numbers an instance; null or short: none); `hidden`: prim, id."""
    flat = {"positions": 3, "orientations": 4, "scales": 3}
    have = [c for c in flat if c in rows.columns]
    at = rows.select("prim", "prototypes", *have, F.posexplode(F.arrays_zip("proto_indices", "ids")).alias("i", "e"))
    part = lambda c: F.when(F.size(c) >= (F.col("i") + 1) * flat[c], F.slice(c, F.col("i") * flat[c] + 1, flat[c]))
    out = at.select("prim", F.col("e.ids").alias("id"), F.try_element_at("prototypes", (F.col("e.proto_indices") + 1).cast("int")).alias("prototype"), *(part(c).alias(c[:-1]) for c in have))
    return out.join(hidden, ["prim", "id"], "left_anti")


def resolved_keys(names: DataFrame, clients: DataFrame, layers: DataFrame) -> DataFrame:
    """The layer key of a name: as a client's, else as a department's, else as a key itself. The layers are few and broadcast; clients grow with the users, so Spark chooses by their size."""
    rows = names.join(clients.select(F.col("client_id").alias("name"), F.col("layer_key").alias("_c")), "name", "left")
    keys = layers.select(F.col("layer_key").alias("_k"))
    rows = rows.join(F.broadcast(keys.select(F.col("_k").alias("_d"))), F.col("_d") == F.concat(F.lit("department:"), F.col("name")), "left")
    rows = rows.join(F.broadcast(keys), F.col("_k") == F.col("name"), "left")
    return rows.select("name", F.coalesce("_c", "_d", "_k").alias("layer_key"))


def adopted_children(edges: DataFrame, identities: DataFrame) -> DataFrame:
    """Edges (parent_key, pos, identifier) with the child's known key, or a new one made from the identifier, and adopted: whether it was known."""
    known = identities.select("identifier", F.col("layer_key").alias("_known"))
    new = F.concat(F.lit("shared:"), F.sha1("identifier").substr(1, 16))
    return edges.join(known, "identifier", "left").withColumn("child_key", F.coalesce("_known", new)).withColumn("adopted", F.col("_known").isNotNull()).drop("_known")


def child_outcomes(edges: DataFrame, identities: DataFrame) -> DataFrame:
    """Edges (parent_key, pos, identifier, key or null) with outcome: adopted (the identifier's known key), new, or stale: another key than the known one, which is rejected."""
    known = identities.select("identifier", F.col("layer_key").alias("_known"))
    outcome = F.when(F.col("_known").isNull(), "new").when(F.col("key").isNull() | (F.col("key") == F.col("_known")), "adopted").otherwise("stale")
    return edges.join(known, "identifier", "left").withColumn("outcome", outcome).drop("_known")


def newly_reachable(edges: DataFrame, roots: DataFrame, known: DataFrame) -> DataFrame:
    """Layers (node) that can be reached now and have no state yet, with the number of their own sublayers. `known`: node."""
    reached = reachable(edges, roots).select("node").join(known.select("node").distinct(), "node", "left_anti")
    counts = edges.groupBy(F.col("parent").alias("node")).agg(F.count("*").alias("n_sublayers"))
    return reached.join(counts, "node", "left").fillna(0, ["n_sublayers"])


def resolved_edges(edges: DataFrame, identities: DataFrame) -> DataFrame:
    """Edges without a key whose identifier has become known: parent, pos and the key to write."""
    return edges.filter("child is null").join(identities.select("identifier", F.col("layer_key").alias("child_key")), "identifier").select("parent", "pos", "child_key")


def pruned(states: DataFrame, edges: DataFrame, roots: DataFrame) -> DataFrame:
    """The states (node and others) of layers that the roots still reach."""
    return states.join(reachable(edges, roots).select("node"), "node", "left_semi")


def reanchored(paths: DataFrame, layers: DataFrame) -> DataFrame:
    """Asset paths (layer_key, asset_path) as identifiers that hold elsewhere: anchored.

    Empty paths, and those of anonymous layers, stay; absolute ones and search paths (no ./ or ../ in front) too; relative ones are anchored at the
    layer's folder, with . and .. resolved. `layers`: layer_key, folder (null: anonymous).
    """
    rows = paths.join(layers.select("layer_key", "folder"), "layer_key", "left")
    start = F.struct(F.array().cast("array<string>").alias("a"))

    def step(acc: Column, part: Column) -> Column:
        up = F.slice(acc["a"], 1, F.greatest(F.size(acc["a"]) - 1, F.lit(0)))
        return F.struct(F.when((part == "") | (part == "."), acc["a"]).when(part == "..", up).otherwise(F.concat(acc["a"], F.array(part))).alias("a"))

    whole = F.aggregate(F.split(F.concat("folder", F.lit("/"), "asset_path"), "/"), start, step, lambda x: F.concat(F.lit("/"), F.array_join(x["a"], "/")))
    relative = F.col("asset_path").startswith("./") | F.col("asset_path").startswith("../")
    return rows.withColumn("anchored", F.when(relative & F.col("folder").isNotNull(), whole).otherwise(F.col("asset_path"))).drop("folder")


#: Buckets of an arc list in the order in which they are kept.
BUCKETS = ("added", "prepended", "appended", "deleted", "ordered")


def canonical_arcs(rows: DataFrame) -> DataFrame:
    """arcs in one comparable form: \\ as /, a given position only where it is not the usual one, entries that are not explicit in the buckets' order.

    `rows`: arcs, explicit. Offsets of 0 and scales of 1 become null, as positions that go without saying do.
    """
    usual = F.when(F.col("explicit"), "explicit").otherwise("prepended")
    place = lambda a: F.array_position(F.array(*map(F.lit, BUCKETS)), F.coalesce(a["list_position"], F.lit("prepended")))
    numbered = F.transform("arcs", lambda a, i: F.struct(F.when(F.col("explicit"), F.lit(0).cast("long")).otherwise(place(a)).alias("p"), i.alias("i"), a.alias("a")))
    default = lambda x, usual_one: F.when(~x.eqNullSafe(F.lit(usual_one)), x)

    def entry(x: Column) -> Column:
        a = x["a"]
        return F.struct(F.nullif(F.translate(a["asset_path"], "\\", "/"), F.lit("")).alias("asset_path"), F.nullif(a["prim_path"], F.lit("")).alias("prim_path"), F.when(a["list_position"] != usual, a["list_position"]).alias("list_position"), default(a["layer_offset"], 0.0).alias("layer_offset"), default(a["layer_scale"], 1.0).alias("layer_scale"))

    return rows.withColumn("arcs", F.transform(F.array_sort(numbered), entry))


def mapped_parameters(inputs: DataFrame, mapping: DataFrame, *, native: str) -> DataFrame:
    """Shader inputs under a renderer's own names: by the mapping (shader, native, name, native_name), a small table, else as they are; node tells whether the shader is known there."""
    known = mapping.filter(F.col("native") == native)
    nodes = known.select("shader").distinct().withColumn("node", F.lit(True))
    rows = inputs.join(F.broadcast(known.select("shader", "name", "native_name")), ["shader", "name"], "left").join(F.broadcast(nodes), "shader", "left")
    return rows.withColumn("native_name", F.coalesce("native_name", "name")).withColumn("node", F.coalesce("node", F.lit(False)))


def token_outcomes(attempts: DataFrame, registry: DataFrame) -> DataFrame:
    """registered, accepted or rejected for each attempt (client_id, token, arrival): a client's first use registers its token."""
    first = attempts.join(registry.select("client_id", F.col("token").alias("_t")), "client_id", "left")
    along = Window.partitionBy("client_id").orderBy("arrival")
    own = F.coalesce("_t", F.first("token").over(along))
    new = F.col("_t").isNull() & (F.row_number().over(along) == 1)
    return first.withColumn("outcome", F.when(new, "registered").when(F.col("token") == own, "accepted").otherwise("rejected")).drop("_t", "token")


def renamed_paths(paths: DataFrame, renames: DataFrame) -> DataFrame:
    """Paths (scene_id, prim) with path, what they are after renames (scene_id, seq, old, new): a rename moves its subtree; they apply in order of seq."""
    moves = renames.select("scene_id", "seq", F.col("old").alias("source"), F.col("new").alias("target"))
    return moved(paths.withColumns({"path": F.col("prim"), "seq": F.lit(-1).cast("long")}), moves).select(*paths.columns, "path")
