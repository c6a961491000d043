"""Queries on the upkeep of layers, assets and namespaces, on every rule of validation, and on the small functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import math3d, paths, scalars
from ..operators import compose, diff, graph, inspect, renames, scans, validate
from ..sources.edit_log import EDITS_SQL, edits, layers
from .full_log import FULL_SQL, flat, full_edits
from .full_queries import LIVING
from .graph_queries import EDGES, layer_edges
from .log_queries import COMPOSED, LIVE
from .registry import query


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/customer.parquet")


_REACHED = f"WITH RECURSIVE {EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.child FROM r JOIN edges e ON e.parent = r.node)"
_ROOT = "node long"


@query(_REACHED + ", k AS (SELECT c_custkey AS node FROM customer WHERE c_acctbal > 0), c AS (SELECT parent AS node, count(*) AS n FROM edges GROUP BY 1) SELECT node, coalesce(n, 0) AS n_sublayers FROM r LEFT JOIN c USING (node) WHERE node NOT IN (SELECT node FROM k)")
def newly_reachable_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layers that the root reaches and that have no state yet; customers in credit have one."""
    known = _customers(spark, sf_dir).filter("c_acctbal > 0").select(F.col("c_custkey").alias("node"))
    return graph.newly_reachable(layer_edges(spark, sf_dir), spark.createDataFrame([(1,)], _ROOT), known)


@query(_REACHED + " SELECT c_custkey AS node, c_name AS name FROM customer WHERE c_custkey IN (SELECT node FROM r)")
def reachable_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = _customers(spark, sf_dir).select(F.col("c_custkey").alias("node"), F.col("c_name").alias("name"))
    return graph.pruned(states, layer_edges(spark, sf_dir), spark.createDataFrame([(1,)], _ROOT))


@query("SELECT o_custkey AS parent, o_orderkey AS pos, c_name AS child_key FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'F' AND c_acctbal > 0")
def resolvable_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges of finished orders have their key; of the others those that can get one now."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    edges = o.select(F.col("o_custkey").alias("parent"), F.col("o_orderkey").alias("pos"), F.concat(F.lit("id-"), "o_custkey").alias("identifier"), F.when(F.col("o_orderstatus") == "F", "known").alias("child"))
    ids = _customers(spark, sf_dir).filter("c_acctbal > 0").select(F.concat(F.lit("id-"), "c_custkey").alias("identifier"), F.col("c_name").alias("layer_key"))
    return graph.resolved_edges(edges, ids)


@query(LIVING + ", l AS (SELECT scene_id, k, layer_key, prim, arg_max(asset, seq) AS asset_path FROM living WHERE asset IS NOT NULL GROUP BY 1, 2, 3, 4), c AS (SELECT 'assets/a' || p_partkey || '.usd' AS asset_path, p_brand AS resolved FROM part WHERE p_size > 20) SELECT l.*, resolved, resolved IS NULL AS pending FROM l LEFT JOIN c USING (asset_path)")
def arc_dependencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Assets that living arcs bring in; parts of over size 20 can be resolved."""
    catalogue = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size > 20").select(F.concat(F.lit("assets/a"), "p_partkey", F.lit(".usd")).alias("asset_path"), F.col("p_brand").alias("resolved"))
    return graph.arc_dependencies(full_edits(spark, sf_dir), catalogue)


@query("SELECT lang, source, count(*) AS n, count(DISTINCT text) AS texts FROM documents GROUP BY 1, 2")
def distinct_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts told apart by their fingerprints alone."""
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.groupBy("lang", "source").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("text").isNotNull(), scalars.fingerprint(F.col("text")))).alias("texts"))


_PATHS = FULL_SQL + """, p AS (SELECT seq, layer_key, CASE seq % 6 WHEN 0 THEN '' WHEN 1 THEN './' || asset WHEN 2 THEN '../' || asset WHEN 3 THEN '/abs/' || asset WHEN 4 THEN asset ELSE '.././x/../' || asset END AS asset_path FROM full_log WHERE asset IS NOT NULL)
"""


@query(_PATHS + "SELECT seq, layer_key, asset_path, CASE WHEN layer_key = 'default' OR seq % 6 IN (0, 3, 4) THEN asset_path WHEN seq % 6 = 1 THEN '/show/' || replace(layer_key, 'department:', '') || '/' || asset_path[3:] WHEN seq % 6 = 2 THEN '/show/' || asset_path[4:] ELSE '/show/' || asset_path[11:] END AS anchored FROM p")
def reanchored_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relative paths anchored at their layer's folder; the default layer has none."""
    forms = "CASE seq % 6 WHEN 0 THEN '' WHEN 1 THEN concat('./', asset) WHEN 2 THEN concat('../', asset) WHEN 3 THEN concat('/abs/', asset) WHEN 4 THEN asset ELSE concat('.././x/../', asset) END"
    rows = flat(spark, sf_dir).filter("asset is not null").select("seq", "layer_key", F.expr(forms).alias("asset_path"))
    folders = layers(spark).select("layer_key", F.when(F.col("layer_key") != "default", F.concat(F.lit("/show/"), F.replace("layer_key", F.lit("department:")))).alias("folder"))
    return graph.reanchored(rows, folders)


@query(FULL_SQL + """, e AS (SELECT seq, asset, v1, CAST(v1 AS BIGINT) % 3 AS q FROM full_log WHERE asset IS NOT NULL)
SELECT seq, CASE WHEN seq % 2 = 0 THEN asset || ',b,c' ELSE CASE q WHEN 2 THEN 'c,b,' || asset ELSE asset || ',c,b' END END AS assets, CASE WHEN seq % 2 = 0 THEN ',,' ELSE CASE q WHEN 0 THEN 'added,,appended' WHEN 1 THEN ',,appended' ELSE ',appended,deleted' END END AS positions FROM e""")
def canonical_arc_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three arcs an edit, the first with backslashes: explicit lists keep their order, others are put in the buckets' order."""
    rows = flat(spark, sf_dir).filter("asset is not null").withColumn("q", F.col("v1").cast("long") % 3)
    explicit = F.col("seq") % 2 == 0
    first = F.when(explicit, "explicit").otherwise(F.element_at(F.array(F.lit("added"), F.lit("prepended"), F.lit("deleted")), (F.col("q") + 1).cast("int")))

    def arc(path, position):
        return F.struct(path.alias("asset_path"), F.lit("").alias("prim_path"), position.alias("list_position"), F.lit(0.0).alias("layer_offset"), F.lit(1.0).alias("layer_scale"))

    def fixed(name: str, position: str):
        return arc(F.lit(name), F.when(explicit, "explicit").otherwise(position))

    out = graph.canonical_arcs(rows.select("seq", explicit.alias("explicit"), F.array(arc(F.translate("asset", "/", "\\"), first), fixed("b", "appended"), fixed("c", "prepended")).alias("arcs")))
    return out.select("seq", F.array_join(F.transform("arcs", lambda a: a["asset_path"]), ",").alias("assets"), F.array_join(F.transform("arcs", lambda a: F.coalesce(a["list_position"], F.lit(""))), ",").alias("positions"))


@query("WITH i AS (SELECT p_partkey, 'shader' || (p_size % 4) AS shader, CASE WHEN p_size % 3 = 0 THEN 'color' ELSE 'gain' END AS name FROM part), m(shader, name, native_name) AS (VALUES ('shader0', 'color', 'Base Color'), ('shader1', 'gain', 'Factor')) SELECT i.*, coalesce(native_name, i.name) AS native_name, i.shader IN ('shader0', 'shader1') AS node FROM i LEFT JOIN m USING (shader, name)")
def native_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    inputs = p.select("p_partkey", F.concat(F.lit("shader"), F.col("p_size") % 4).alias("shader"), F.when(F.col("p_size") % 3 == 0, "color").otherwise("gain").alias("name"))
    mapping = spark.createDataFrame([("shader0", "a", "color", "Base Color"), ("shader1", "a", "gain", "Factor"), ("shader2", "b", "gain", "Other")], "shader string, native string, name string, native_name string")
    return graph.mapped_parameters(inputs, mapping, native="a")


@query(EDITS_SQL + COMPOSED + LIVE + """, vals AS (SELECT c.scene_id, CASE WHEN field IN ('t', 's') THEN 'set_xform_trs' WHEN field = 'visibility' THEN 'set_visibility' ELSE 'set_gprim_attrs' END AS k, c.prim, NULL AS type_name, field, time, value FROM composed c JOIN live l ON l.scene_id = c.scene_id AND l.prim = c.prim WHERE value IS NOT NULL),
e AS (SELECT scene_id, 'ensure_prim' AS k, prim, 'T' || (seq % 2) AS type_name, NULL AS field, NULL::DOUBLE AS time, NULL::DOUBLE AS value FROM live UNION ALL SELECT * FROM vals)
SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY k <> 'ensure_prim', CASE k WHEN 'ensure_prim' THEN length(prim) - length(replace(prim, '/', '')) ELSE 0 END, prim, coalesce(field, ''), time IS NOT NULL, coalesce(time, 0)) AS nth FROM e""")
def snapshot_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    prims = inspect.live_prims(log).select("scene_id", "prim", F.concat(F.lit("T"), F.col("seq") % 2).alias("type_name"))
    values = compose.composed(log, layers(spark)).select("scene_id", "prim", "field", "time", "value")
    return diff.snapshot_events(values, prims).withColumn("nth", F.col("nth").cast("long"))


#: Each prim through the moves after it, one after another; of what ends at one path the last that came there.
NAMESPACE_SQL = FULL_SQL + """, moves AS (SELECT scene_id, seq, prim AS source, CASE WHEN k = 'rename_prim' THEN regexp_replace(prim, '[^/]+$', '') || new_name END AS target FROM full_log WHERE k IN ('delete_prim', 'rename_prim')),
made AS (SELECT scene_id, seq, prim AS path, coalesce(type_name, '') AS type_name, 1 AS real FROM full_log WHERE k = 'ensure_prim' UNION ALL SELECT scene_id, seq, target, 'Xform', 0 FROM moves WHERE target IS NOT NULL),
walk AS (SELECT *, seq AS moment FROM made UNION ALL SELECT w.scene_id, w.seq, m.target || substr(w.path, length(m.source) + 1), w.type_name, w.real, m.seq FROM walk w JOIN moves m ON m.scene_id = w.scene_id AND m.seq > w.moment AND (w.path = m.source OR starts_with(w.path, m.source || '/'))
  WHERE w.path IS NOT NULL AND NOT EXISTS (SELECT 1 FROM moves x WHERE x.scene_id = w.scene_id AND x.seq > w.moment AND x.seq < m.seq AND (w.path = x.source OR starts_with(w.path, x.source || '/')))),
ends AS (SELECT scene_id, seq, real, arg_max({'p': path}, moment)['p'] AS path, any_value(type_name) AS type_name, max(moment) AS moment FROM walk GROUP BY 1, 2, 3)
SELECT scene_id, path AS prim, arg_max(type_name, (real, moment, seq)) AS type_name FROM ends WHERE path IS NOT NULL GROUP BY 1, 2"""
NAMESPACE_SQL = NAMESPACE_SQL.replace("WITH o0", "WITH RECURSIVE o0", 1)


@query(NAMESPACE_SQL)
def namespace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The prims that the log of all kinds leaves, renames followed."""
    return renames.namespace(full_edits(spark, sf_dir)).select("scene_id", "prim", "type_name")


@query(NAMESPACE_SQL)
def namespace_in_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, the log given in two parts: the second starts from what the first has left."""
    log = full_edits(spark, sf_dir)
    middle = log.agg(F.expr("max(seq) div 2")).first()[0]
    first = renames.placed(log.filter(F.col("seq") <= middle))
    return renames.standing(renames.placed(log.filter(F.col("seq") > middle), first)).select("scene_id", "prim", "type_name")


@query(FULL_SQL + ", l AS (SELECT DISTINCT layer_key, layer_key = 'department:fx' AS muted FROM full_log) SELECT false AS admissible, CASE WHEN (SELECT count(*) FROM l WHERE layer_key <> 'default') > 0 THEN 'departments need layered replay' ELSE '' END AS reason")
def flat_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = full_edits(spark, sf_dir).select("layer_key").distinct()
    departments = used.filter("layer_key <> 'default'").select(scans.department_of(F.col("layer_key")).alias("department"))
    return inspect.flat_replay(layers(spark).join(used, "layer_key", "left_semi"), departments)


@query(FULL_SQL + ", c AS (SELECT scene_id, list(DISTINCT layer_key ORDER BY layer_key) AS current FROM full_log GROUP BY 1) SELECT scene_id, 'department:fx,new,default,department:lighting' AS sublayers FROM c")
def managed_sublayers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A managed block is put before what each scene has besides."""
    many = lambda *x: F.array(*map(F.lit, x))
    stacks = full_edits(spark, sf_dir).groupBy("scene_id").agg(F.sort_array(F.collect_set("layer_key")).alias("current"))
    rows = inspect.with_unmanaged(stacks.withColumns({"managed": many("department:fx", "new"), "known": many("department:fx", "department:animation")}))
    return rows.select("scene_id", F.array_join("sublayers", ",").alias("sublayers"))


@query(FULL_SQL + """, d AS (SELECT seq, list_filter([f1, f2], lambda x: x IS NOT NULL) AS attrs FROM full_log) SELECT CAST(seq AS VARCHAR) AS prim, channel FROM d, (VALUES ('all'), ('transforms'), ('prefixed'), ('resync')) c(channel)
WHERE len(attrs) = 0 OR channel = 'all' OR (channel = 'transforms' AND list_has_any(attrs, ['t', 's'])) OR (channel = 'prefixed' AND len(list_filter(attrs, lambda a: starts_with(a, 'a') OR starts_with(a, 'meters'))) > 0)""")
def channels_to_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    dirty = full_edits(spark, sf_dir).select(F.col("seq").cast("string").alias("prim"), F.col("fields").alias("attrs"))
    channels = spark.createDataFrame([("all", [], [], False), ("transforms", ["t", "s"], [], False), ("prefixed", [], ["a", "meters"], False), ("resync", ["t"], [], True)], "channel string, attrs array<string>, prefixes array<string>, resync_only boolean")
    return scans.needs_read(dirty, channels)


@query(FULL_SQL + "SELECT seq, CASE WHEN schema_name IN ('S0', 'S2') THEN schema_name ELSE '' END AS schemas FROM full_log WHERE k = 'ensure_prim'")
def replicated_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scans.replicated_schemas(full_edits(spark, sf_dir).filter("k = 'ensure_prim'"), ["S0", "S2"])
    return rows.select("seq", F.array_join("api_schemas", ",").alias("schemas"))


@query("""WITH r AS (SELECT label, vec_id, CASE vec_id % 4 WHEN 0 THEN 'proto_indices' WHEN 1 THEN 'positions' WHEN 2 THEN 'inactive_ids' ELSE 'prototypes' END AS field, CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id % 5 AS DOUBLE) END AS time, vec_id % 50 AS n FROM embeddings),
t AS (SELECT label, min(n) FILTER (time IS NULL AND field = 'proto_indices' AND vec_id = u) AS n0 FROM (SELECT *, min(vec_id) FILTER (field = 'proto_indices' AND time IS NULL) OVER (PARTITION BY label) AS u FROM r) GROUP BY 1)
SELECT '/I/' || r.label AS prim, coalesce(string_agg(DISTINCT '/P' || (vec_id % 3), ',' ORDER BY '/P' || (vec_id % 3)) FILTER (field = 'prototypes'), '') AS prototypes, coalesce(string_agg(DISTINCT field, ',' ORDER BY field) FILTER (time IS NOT NULL), '') AS animated, max(n) FILTER (field = 'inactive_ids') AS inactive FROM r GROUP BY r.label""")
def instancer_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    field = F.expr("CASE vec_id % 4 WHEN 0 THEN 'proto_indices' WHEN 1 THEN 'positions' WHEN 2 THEN 'inactive_ids' ELSE 'prototypes' END")
    rows = e.select(F.concat(F.lit("/I/"), "label").alias("prim"), field.alias("field"), F.expr("CASE WHEN vec_id % 3 = 0 THEN CAST(vec_id % 5 AS DOUBLE) END").alias("time"), (F.col("vec_id") % 50).alias("n"), F.array(F.concat(F.lit("/P"), F.col("vec_id") % 3)).alias("targets"))
    return inspect.instancer_summary(rows).select("prim", F.array_join("prototypes", ",").alias("prototypes"), F.array_join("animated", ",").alias("animated"), "inactive")


@query(FULL_SQL + ", v AS (SELECT scene_id, prim, bool_or(flag) FILTER (k = 'set_instanceable') AS i FROM full_log WHERE prim <> '/' GROUP BY 1, 2) SELECT (SELECT count(*) FROM full_log) AS n_edits, (SELECT count(DISTINCT client_id) FROM full_log) AS n_clients, (SELECT count(*) FROM v) AS n_prims, (SELECT count(DISTINCT layer_key) FROM full_log) AS n_layers, (SELECT count(*) FROM v WHERE i) AS n_instances")
def status_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = full_edits(spark, sf_dir)
    prims = log.filter("prim <> '/'").groupBy("scene_id", "prim").agg(F.max(F.when(F.col("k") == "set_instanceable", F.col("flag"))).alias("instanceable"))
    return inspect.status_with_instances(log, prims)


#: One fault a kind, in edits whose number is a multiple of 11; the rule that must find it.
_FAULTS = """CASE WHEN seq % 11 <> 0 THEN CASE WHEN k IN ('replace_sdf_layer_content', 'set_sublayers') THEN 'wrong_mode' END ELSE CASE k
  WHEN 'erase_time_samples' THEN 'bad_erase' WHEN 'ensure_prim' THEN 'bad_schema' WHEN 'set_xform_trs' THEN 'bad_transform' WHEN 'deactivate_prim' THEN 'missing_flag' WHEN 'set_visibility' THEN 'missing_flag' WHEN 'set_instanceable' THEN 'missing_flag'
  WHEN 'rename_prim' THEN 'bad_name' WHEN 'set_gprim_attrs' THEN 'bad_attributes' WHEN 'set_reference' THEN 'bad_arcs' WHEN 'set_payload' THEN 'bad_arcs' WHEN 'set_variant_selections' THEN 'bad_variants' WHEN 'set_material_binding' THEN 'bad_binding'
  WHEN 'set_connectable_input' THEN 'bad_inputs' WHEN 'set_connectable_connection' THEN 'bad_connections' WHEN 'set_stage_metadata' THEN 'bad_metadata' WHEN 'set_point_instancer' THEN 'bad_instancer' WHEN 'set_sdf_spec_fields' THEN 'bad_spec' WHEN 'replace_sdf_layer_content' THEN 'wrong_mode' WHEN 'set_sublayers' THEN 'wrong_mode' END END"""


def faulty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log of all kinds, sound but for one fault in every eleventh edit."""
    log = full_edits(spark, sf_dir)
    bad = F.col("seq") % 11 == 0
    k = lambda *names: F.col("k").isin(*names)
    texts = F.array().cast("array<string>")
    arc = lambda position: F.struct(F.lit("a.usd").alias("asset_path"), F.lit(None).cast("string").alias("prim_path"), F.lit(position).alias("list_position"), F.lit(0.0).alias("layer_offset"), F.lit(1.0).alias("layer_scale"))
    sound_links = F.when(k("set_connectable_connection"), F.create_map(F.lit("inputs:x"), F.struct(F.lit("/S").alias("prim"), F.lit("out").alias("attr"))))
    return log.withColumns({
        "type_name": F.when(k("ensure_prim"), F.lit("Mesh")),
        "api_schemas": F.when(bad & k("ensure_prim"), F.array(F.lit("no schema"))).otherwise(texts),
        "fields": F.when(bad & k("set_xform_trs"), F.array(F.lit("r"))).when(bad & k("set_sdf_spec_fields"), F.array(F.lit("default"))).when(k("set_sdf_spec_fields") & F.col("removed"), texts).when(k("set_point_instancer") & bad & F.col("time").isNull(), F.array(F.lit("positions"), F.lit("ids"))).when(k("set_point_instancer") & bad, F.array(F.lit("prototypes"))).otherwise(F.col("fields")),
        "vals": F.when(k("set_point_instancer") & bad & F.col("time").isNotNull(), F.create_map(F.lit("prototypes"), F.lit(1.0))).otherwise(F.col("vals")),
        "flag": F.when(~bad, F.coalesce("flag", F.lit(True))),
        "new_name": F.when(k("rename_prim"), F.when(bad, "1x").otherwise("ok")),
        "primvar_meta": F.when(bad & k("set_gprim_attrs"), F.create_map(F.lit("no_such"), F.struct(F.lit("float").alias("type_name"), F.lit("vertex").alias("interpolation")))),
        "arcs": F.when(k("set_reference", "set_payload"), F.when(bad, F.array(arc("explicit"), arc("deleted"))).otherwise(F.array(arc("prepended")))),
        "selections": F.when(k("set_variant_selections"), F.when(bad, F.create_map(F.lit("a b"), F.lit("v"))).otherwise(F.create_map(F.lit("look"), F.lit("v")))),
        "material_path": F.when(k("set_material_binding"), F.when(bad, "no/path").otherwise("/Mat/M")),
        "input_types": F.when(bad & k("set_connectable_input"), F.create_map(F.lit("zz"), F.lit("float"))),
        "connections": F.when(bad & k("set_connectable_connection"), F.create_map(F.lit("x"), F.struct(F.lit("/S").alias("prim"), F.lit("out").alias("attr")))).otherwise(sound_links),
        "disconnections": texts,
        "up_axis": F.when(bad & k("set_stage_metadata"), "X").when(k("set_stage_metadata"), "Y"),
        "times": F.when(k("erase_time_samples") & ~bad, F.array(F.lit(1.0))),
        "removed": F.when(bad & k("set_sdf_spec_fields"), F.lit(True)).otherwise(F.col("removed")),
    })


@query(FULL_SQL + f", v AS (SELECT scene_id, seq, client_id, session_id, seq // 8 AS txn_id, {_FAULTS} AS rule FROM full_log) SELECT * FROM v WHERE rule IS NOT NULL")
def violations_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(faulty(spark, sf_dir))


@query(FULL_SQL + """, t AS (SELECT scene_id, seq, client_id, session_id, seq // 8 AS txn_id, k, seq % 13 AS f FROM full_log WHERE k IN ('replace_sdf_layer_content', 'set_sublayers')) SELECT scene_id, seq, client_id, session_id, txn_id, CASE WHEN k = 'set_sublayers' THEN 'bad_sublayers' ELSE 'bad_replacement' END AS rule FROM t WHERE f IN (0, 1, 2, 3)""")
def topology_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shared stages: replaced content must be the root's, sublayers portable, distinct, finite and of a known revision."""
    log = full_edits(spark, sf_dir).filter("k in ('replace_sdf_layer_content', 'set_sublayers')")
    f, top = F.col("seq") % 13, F.col("k") == "set_sublayers"
    sub = lambda path, scale: F.struct(path.alias("authored_path"), F.lit(0.0).alias("offset"), scale.alias("scale"), F.lit("L").alias("layer_key"))
    first = sub(F.when(f == 0, "C:\\a.usd").when(f == 1, "b.usd").otherwise("a.usd"), F.when(f == 2, F.lit(float("inf"))).otherwise(1.0))
    rows = log.withColumns({"prim": F.when(top | ~f.isin(0, 1, 2, 3), "/").otherwise("/World"), "sublayers": F.when(top, F.array(first, sub(F.lit("b.usd"), F.lit(1.0)))), "generation": F.lit("g"), "revision": F.when(f != 3, F.col("seq"))})
    return validate.violations(rows, "shared_stage")


@query("SELECT vec_id AS id, field FROM embeddings, (VALUES ('positions', 12), ('orientations', 16), ('ids', 4)) f(field, n) WHERE len(embedding[1:n - CASE WHEN vec_id % 5 = 0 AND field <> 'ids' THEN 1 ELSE 0 END]) <> n")
def instancer_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    one = lambda name, n: F.struct(F.lit(name).alias("field"), F.slice("embedding", 1, n).alias("items")) if name == "ids" else F.struct(F.lit(name).alias("field"), F.slice(F.col("embedding"), F.lit(1), n - (F.col("vec_id") % 5 == 0).cast("int")).alias("items"))
    rows = e.select(F.col("vec_id").alias("id"), F.lit(4).alias("n"), F.explode(F.array(one("positions", 12), one("orientations", 16), one("ids", 4))).alias("x")).select("id", "n", "x.*")
    return validate.instancer_faults(rows)


@query("WITH d AS (SELECT o_orderkey AS pos, CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE 'dept' || o_custkey END AS department FROM orders), f AS (SELECT department, min(pos) AS first FROM d GROUP BY 1) SELECT pos, CASE WHEN coalesce(trim(department), '') = '' THEN 'empty' ELSE 'listed_twice' END AS fault FROM d LEFT JOIN f USING (department) WHERE coalesce(trim(department), '') = '' OR pos > first")
def priority_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return validate.priority_faults(o.select(F.col("o_orderkey").alias("pos"), F.expr("CASE o_orderkey % 9 WHEN 0 THEN '' WHEN 1 THEN NULL ELSE concat('dept', o_custkey) END").alias("department")))


@query("SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 7 IN (0, 1) OR o_orderkey % 10 = 3")
def identity_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(n.alias("id"), F.when(n % 7 == 0, "").when(n % 7 != 1, "scene").alias("scene_id"), F.when(n % 10 == 3, -1).otherwise(1).alias("epoch"), F.lit(0).alias("seq"))
    return validate.identity_faults(rows)


@query("SELECT o_orderkey AS id, CASE WHEN o_orderkey % 11 = 0 THEN 'non_default_layers' WHEN o_orderkey % 11 = 1 THEN 'missing_metadata' WHEN o_orderkey % 11 = 2 THEN 'other_scene' WHEN o_orderkey % 11 = 3 THEN 'future_token' WHEN o_orderkey % 11 IN (4, 5) AND o_orderkey % 2 = 0 THEN 'stale_token' WHEN o_orderkey % 11 = 6 THEN 'sublayers' WHEN o_orderkey % 11 = 7 AND o_orderkey % 2 = 0 THEN 'ambiguous' ELSE 'accepted' END AS status FROM orders")
def snapshot_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey")
    f, even = n % 11, n % 2 == 0
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(n.alias("id"), (f == 0).alias("extra_layers"), (f != 1).alias("has_metadata"), F.when(f == 2, "other").otherwise("own").alias("scene_id"), F.lit("own").alias("own_scene_id"), F.when(f == 4, 1).otherwise(2).alias("epoch"), F.lit(2).alias("own_epoch"), F.when(f == 3, 9).when(f == 5, 1).otherwise(5).alias("seq"), F.lit(5).alias("own_seq"), (f == 6).alias("has_sublayers"), (f == 7).alias("destructive"), even.alias("reject_stale"), even.alias("reject_ambiguous"))
    return diff.snapshot_status(rows).select("id", "status")


@query("""WITH p AS (SELECT p_partkey AS id, '/World/P' || p_partkey || '.' || lower(p_brand) AS property, 'f' || p_size || ' (src/' || p_type || '.py:' || p_size || ')' AS frame, 'a' || chr(92) || p_brand AS asset FROM part)
SELECT id, split_part(property, '.', 1) AS prim, 'src/' || regexp_extract(frame, 'src/(.*)\\.py', 1) || '.py' AS file, replace(asset, chr(92), '/') AS path, id % 2 = 0 AS matches, upper(CASE WHEN id % 3 = 0 THEN 'y' ELSE 'Z' END) = 'Y' AS converts, CASE WHEN id % 2 = 0 THEN 't,s' ELSE 'r' END AS fields, id % 4 = 0 AS equal FROM p""")
def small_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Property paths, frames' files, slashes, up axes, transform fields and equality of arrays."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    n = F.col("p_partkey")
    asset = F.concat(F.lit("a\\"), "p_brand")
    many = lambda *x: F.array(*map(F.lit, x))
    return p.select(
        n.alias("id"), paths.prim_of(F.concat(F.lit("/World/P"), n, F.lit("."), F.lower("p_brand"))).alias("prim"),
        scalars.frame_file(F.concat(F.lit("f"), "p_size", F.lit(" (src/"), "p_type", F.lit(".py:"), "p_size", F.lit(")"))).alias("file"), scalars.slashes(asset).alias("path"),
        scalars.asset_matches(F.when(n % 2 == 0, F.concat(F.lit("a/"), "p_brand")).otherwise("b"), asset).alias("matches"), math3d.needs_conversion(F.when(n % 3 == 0, "y").otherwise("Z")).alias("converts"),
        F.array_join(scalars.clamped_fields(F.when(n % 2 == 0, many("t", "x", "s")).otherwise(many("q", "r"))), ",").alias("fields"), scalars.same(F.when(n % 4 == 0, many(1.0, 2.0)), many(1.0, 2.0)).alias("equal"),
    )


@query(EDITS_SQL + ", n AS (SELECT DISTINCT client_id AS name FROM edits UNION SELECT 'fx' UNION SELECT 'default' UNION SELECT 'nobody'), c AS (SELECT client_id AS name, arg_max(layer_key, seq) AS ck FROM edits WHERE scene_id = 'scene-0' GROUP BY 1) SELECT name, coalesce(ck, d.layer_key, k.layer_key) AS layer_key FROM n LEFT JOIN c USING (name) LEFT JOIN layers d ON d.layer_key = 'department:' || name LEFT JOIN layers k ON k.layer_key = name")
def names_to_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name's layer: as a client of the first scene, else as a department, else as a key."""
    log = edits(spark, sf_dir)
    names = log.select(F.col("client_id").alias("name")).distinct().unionByName(spark.createDataFrame([("fx",), ("default",), ("nobody",)], "name string"))
    clients = log.filter("scene_id = 'scene-0'").groupBy("client_id").agg(F.max_by("layer_key", "seq").alias("layer_key"))
    return graph.resolved_keys(names, clients, layers(spark))


@query(EDITS_SQL + LIVE + """, o AS (SELECT scene_id, prim, max(seq) AS seq FROM edits WHERE k = 'ensure_prim' AND seq <= (SELECT max(event_id) // 2 FROM events) GROUP BY ALL),
pairs AS (SELECT DISTINCT scene_id, prim AS old, '/World/G' || ((kk + 1) % 5) || '/P' || ((kk + 1) % 100) AS new FROM edits WHERE k = 'ensure_prim') SELECT p.* FROM pairs p WHERE (scene_id, old) IN (SELECT scene_id, prim FROM o) AND (scene_id, old) NOT IN (SELECT scene_id, prim FROM live) AND (scene_id, new) IN (SELECT scene_id, prim FROM live) AND (scene_id, new) NOT IN (SELECT scene_id, prim FROM o)""")
def valid_renames(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    middle = log.agg(F.expr("max(event_id) div 2")).first()[0]
    before = log.filter((F.col("k") == "ensure_prim") & (F.col("seq") <= middle)).select("scene_id", "prim").distinct()
    nxt = F.concat(F.lit("/World/G"), (F.col("kk") + 1) % 5, F.lit("/P"), (F.col("kk") + 1) % 100)
    pairs = log.filter("k = 'ensure_prim'").select("scene_id", F.col("prim").alias("old"), nxt.alias("new")).distinct()
    return diff.valid_renames(pairs, before, inspect.live_prims(log))


@query("WITH g AS (SELECT o_orderkey AS i, o_custkey + 1 AS n FROM orders) SELECT i, round(2.0 * cos(2 * pi() * i / n), 5) + 0.0 AS x, round(0.5 * sin(2 * pi() * 0.25 / 4 + 2 * pi() * i / n), 5) + 0.0 AS y, round(2.0 * sin(2 * pi() * i / n), 5) + 0.0 AS z FROM g")
def ring_motion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_orderkey").alias("i"), (F.col("o_custkey") + 1).alias("n"))
    return math3d.ring_motion(rows, 0.25, radius=2.0, amplitude=0.5, period=4.0).select("i", *((F.round(c, 5) + 0.0).alias(c) for c in "xyz"))
