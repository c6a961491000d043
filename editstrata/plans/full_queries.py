"""Queries over the log of all kinds: compaction with payloads, predicates, write sets and channels that values alone cannot show."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import diff, inspect, reduce, scans
from ..operators.compose import snapshot_manifest
from ..sources.edit_log import dumped, layers
from .full_log import FULL_SQL, flat, full_edits
from .registry import query

_SAMPLED = "('set_gprim_attrs', 'set_xform_trs', 'set_connectable_input', 'set_visibility', 'set_point_instancer')"
_EXACT = "('set_sdf_spec_fields', 'erase_time_samples', 'replace_sdf_layer_content')"
#: Edits that live, with the epoch and, for exact deletions, their own seq.
LIVING = FULL_SQL + f""", own AS (SELECT * REPLACE (CASE WHEN k IN ('load_payload', 'unload_payload', 'set_stage_metadata') THEN '' ELSE layer_key END AS layer_key),
  k = 'erase_time_samples' OR removed AS exact, k = 'erase_time_samples' OR removed OR coalesce(f1 = 'timeSamples', false) AS barrier FROM full_log WHERE k <> 'set_sublayers'),
counted AS (SELECT *, CASE WHEN k IN {_SAMPLED} THEN coalesce(sum(barrier::INT) OVER w, 0) WHEN k = 'set_sdf_spec_fields' THEN coalesce(sum(exact::INT) OVER w, 0) ELSE 0 END AS epoch FROM own WINDOW w AS (PARTITION BY scene_id, layer_key, prim ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
living AS (SELECT *, CASE WHEN exact THEN seq END AS alone FROM counted e WHERE NOT EXISTS (SELECT 1 FROM own x WHERE x.scene_id = e.scene_id AND x.layer_key = e.layer_key AND x.seq > e.seq AND (
  (x.k IN ('delete_prim', 'rename_prim') AND (x.prim = e.prim OR starts_with(e.prim, x.prim || '/'))) OR (x.k = 'replace_sdf_layer_content' AND e.k IN {_EXACT})
  OR (x.removed AND x.spec_path = e.spec_path) OR (x.k IN ('load_payload', 'unload_payload') AND e.k IN ('load_payload', 'unload_payload') AND x.prim = e.prim))))
"""
_KEY = "scene_id, layer_key, prim, k, time, spec_path, material_purpose, epoch, alone"


COMPACTED_SQL = LIVING + f""", heads AS (SELECT {_KEY}, CASE WHEN k IN ('ensure_prim', 'ensure_xform_ops') THEN min(seq) ELSE max(seq) END AS seq, CASE WHEN k = 'ensure_xform_ops' THEN arg_min(client_id, seq) ELSE arg_max(client_id, seq) END AS client_id,
  arg_max(type_name, seq) FILTER (type_name IS NOT NULL) AS type_name, arg_max(info_id, seq) FILTER (info_id IS NOT NULL) AS info_id, arg_max(up_axis, seq) FILTER (up_axis IS NOT NULL) AS up_axis,
  arg_max(flag, seq) AS flag, max(new_name) FILTER (seq = last) AS new_name, max(material_path) FILTER (seq = last) AS material_path, max(asset) FILTER (seq = last) AS asset, max(sample) FILTER (seq = last) AS sample,
  coalesce(string_agg(DISTINCT schema_name, ',' ORDER BY schema_name), '') AS schemas FROM (SELECT *, max(seq) OVER (PARTITION BY {_KEY}) AS last FROM living) GROUP BY {_KEY}),
named AS (SELECT {_KEY}, seq, f1 AS name, v1 AS value FROM living WHERE f1 IS NOT NULL UNION ALL SELECT {_KEY}, seq, f2, v2 FROM living WHERE f2 IS NOT NULL),
vals AS (SELECT {_KEY}, string_agg(name || '=' || CAST(value AS INT), ',' ORDER BY name) AS vals FROM (SELECT {_KEY}, name, arg_max(value, seq) AS value FROM named GROUP BY {_KEY}, name) GROUP BY {_KEY}),
sels AS (SELECT {_KEY}, string_agg(name || '=' || value, ',' ORDER BY name) AS selections FROM (SELECT {_KEY}, sel_name AS name, arg_max(sel_value, seq) AS value FROM living WHERE sel_name IS NOT NULL GROUP BY {_KEY}, sel_name) GROUP BY {_KEY}),
acts AS (SELECT {_KEY}, 2 * seq AS moment, conn_name AS name, conn_source AS source FROM living WHERE conn_name IS NOT NULL UNION ALL SELECT {_KEY}, 2 * seq + 1, gone_name, NULL FROM living WHERE gone_name IS NOT NULL),
ends AS (SELECT {_KEY}, name, arg_max(source, moment) FILTER (source IS NOT NULL) AS source, max(moment) % 2 = 1 AS gone FROM acts GROUP BY {_KEY}, name),
links AS (SELECT {_KEY}, coalesce(string_agg(name || '=' || source, ',' ORDER BY name) FILTER (source IS NOT NULL), '') AS links, coalesce(string_agg(name, ',' ORDER BY name) FILTER (gone), '') AS gone FROM ends GROUP BY {_KEY})
SELECT h.* EXCLUDE (epoch, alone), coalesce(v.vals, '') AS vals, coalesce(s.selections, '') AS selections, coalesce(l.links, '') AS links, coalesce(l.gone, '') AS gone FROM heads h
""" + "".join(f"LEFT JOIN {t} {a} ON " + " AND ".join(f"h.{c} IS NOT DISTINCT FROM {a}.{c}" for c in _KEY.split(", ")) + "\n" for t, a in (("vals", "v"), ("sels", "s"), ("links", "l")))


def _compacted_texts(rows: DataFrame) -> DataFrame:
    """One row an edit that stays, its maps and lists as text."""
    text = lambda m, value: F.coalesce(F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(e["key"], F.lit("="), value(e["value"]))), ","), F.lit(""))
    joined = lambda a: F.coalesce(F.array_join(F.array_sort(a), ","), F.lit(""))
    return rows.select(
        "scene_id", "layer_key", "prim", "k", "time", "spec_path", "material_purpose", "seq", "client_id", "type_name", "info_id", "up_axis", "flag", "new_name", "material_path",
        F.col("arcs")[0]["asset_path"].alias("asset"), F.get("times", F.lit(0)).alias("sample"), joined("api_schemas").alias("schemas"), text("vals", lambda v: v.cast("int").cast("string")).alias("vals"),
        text("selections", lambda v: v).alias("selections"), text("connections", lambda v: v["prim"]).alias("links"), joined("disconnections").alias("gone"),
    )


@query(COMPACTED_SQL)
def compaction_of_all_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every kind and payload."""
    return _compacted_texts(reduce.compacted(full_edits(spark, sf_dir)))


@query(COMPACTED_SQL)
def compaction_in_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in two halves by seq, the second reduced on top of the reduction of the first: the same rows as one compaction of all."""
    log = full_edits(spark, sf_dir)
    middle = (log.agg(F.max("seq")).first()[0] or 0) // 2
    held = reduce.reduced(log.filter(F.col("seq") > middle), reduce.reduced(log.filter(F.col("seq") <= middle)))
    return _compacted_texts(held.rows)


@query(LIVING + "SELECT scene_id, layer_key, seq, k, CAST(epoch AS BIGINT) AS epoch FROM living")
def merge_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that live, with the epoch that bounds their merging."""
    log = scans.routing_layer(full_edits(spark, sf_dir).filter("k <> 'set_sublayers'"))
    return reduce.with_epochs(reduce.alive(log)).filter("not dead").select("scene_id", "layer_key", "seq", "k", F.col("epoch").cast("long").alias("epoch"))


@query(FULL_SQL + "SELECT seq, k = 'erase_time_samples' OR removed OR coalesce(f1 = 'timeSamples', false) AS barrier, k = 'erase_time_samples' OR removed AS exact FROM full_log")
def sample_barriers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, removed = F.col("k"), F.col("removed")
    return full_edits(spark, sf_dir).select("seq", scans.is_sample_barrier(k, F.col("fields"), removed).alias("barrier"), scans.is_exact_deletion(k, removed).alias("exact"))


@query(FULL_SQL + """, names AS (SELECT seq, k, f1 AS f FROM full_log WHERE time IS NOT NULL AND f1 IS NOT NULL UNION ALL SELECT seq, k, f2 FROM full_log WHERE time IS NOT NULL AND f2 IS NOT NULL UNION ALL SELECT seq, k, NULL FROM full_log WHERE time IS NOT NULL AND k = 'set_visibility')
SELECT seq, CASE k WHEN 'set_xform_trs' THEN CASE f WHEN 't' THEN 'xformOp:translate' ELSE 'xformOp:scale' END WHEN 'set_connectable_input' THEN 'inputs:' || f WHEN 'set_visibility' THEN 'visibility' ELSE f END AS attr FROM names""")
def sampled_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.written_attributes(full_edits(spark, sf_dir)).select("seq", "attr")


@query(FULL_SQL + "SELECT seq, k FROM full_log WHERE k NOT IN ('replace_sdf_layer_content', 'set_sublayers')")
def managed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.valid_in_mode(full_edits(spark, sf_dir), "managed").select("seq", "k")


@query(FULL_SQL + "SELECT seq, prim, asset AS asset_path FROM full_log WHERE asset IS NOT NULL AND position <> 'deleted'")
def introduced_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.asset_paths(full_edits(spark, sf_dir))


@query(FULL_SQL + """, p AS (SELECT client_id, session_id, seq // 8 AS txn_id, k IN ('replace_sdf_layer_content', 'set_sublayers') AS whole, unnest(list_filter([prim, CASE WHEN new_name IS NOT NULL THEN prim[1:length(prim) - length(split_part(prim, '/', -1))] || new_name END, CASE WHEN conn_name IS NOT NULL THEN conn_source END], lambda x: x IS NOT NULL)) AS path FROM full_log)
SELECT client_id, session_id, txn_id, path, bool_or(whole) AS whole FROM p GROUP BY 1, 2, 3, 4""")
def write_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.write_set(full_edits(spark, sf_dir))


@query(FULL_SQL + "SELECT client_id, session_id, seq // 8 AS txn_id, string_agg(DISTINCT prim, ',' ORDER BY prim) AS paths FROM full_log WHERE k = 'load_payload' GROUP BY 1, 2, 3")
def payload_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.payload_loads(full_edits(spark, sf_dir)).select("client_id", "session_id", "txn_id", F.array_join("paths", ",").alias("paths"))


_INSTANCES = FULL_SQL + """, prims AS (SELECT scene_id, prim, arg_max(flag, seq) AS is_instance FROM full_log WHERE k = 'set_instanceable' GROUP BY 1, 2 UNION ALL SELECT DISTINCT scene_id, '/World/G1', true FROM full_log UNION ALL SELECT DISTINCT scene_id, '/World/G2', false FROM full_log)
"""


@query(_INSTANCES + """SELECT seq, prim FROM full_log e WHERE NOT coalesce((SELECT arg_max(p.is_instance, length(p.prim)) FROM prims p WHERE p.scene_id = e.scene_id AND starts_with(e.prim, p.prim || '/')), false)""")
def edits_outside_instances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits whose nearest existing ancestor is no instance."""
    log = full_edits(spark, sf_dir)
    own = log.filter("k = 'set_instanceable'").groupBy("scene_id", "prim").agg(F.max_by("flag", "seq").alias("is_instance"))
    tops = log.select("scene_id").distinct()
    more = [tops.select("scene_id", F.lit(p).alias("prim"), F.lit(x).alias("is_instance")) for p, x in (("/World/G1", True), ("/World/G2", False))]
    return scans.outside_instances(log, own.unionByName(more[0]).unionByName(more[1])).select("seq", "prim")


@query(FULL_SQL + ", r(receiver_id, mode) AS (VALUES ('c1', 'layered'), ('c2', 'flat'), ('c3', 'layered')), b AS (SELECT seq, client_id AS origin, CASE seq % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'layered' ELSE 'flat' END AS audience FROM full_log) SELECT seq, receiver_id FROM b, r WHERE (audience = 'all' OR audience = mode) AND origin <> receiver_id")
def receiver_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    batches = full_edits(spark, sf_dir).select("seq", F.col("client_id").alias("origin"), F.expr("CASE seq % 3 WHEN 0 THEN 'all' WHEN 1 THEN 'layered' ELSE 'flat' END").alias("audience"))
    receivers = spark.createDataFrame([("c1", "layered"), ("c2", "flat"), ("c3", "layered")], "receiver_id string, mode string")
    return scans.receivers_of(batches, receivers).select("seq", "receiver_id")


@query(FULL_SQL + "SELECT scene_id, layer_key, prim, name AS local_attr, arg_max(source, moment) FILTER (source IS NOT NULL) AS source, max(moment) % 2 = 1 AS disconnected FROM (SELECT *, 2 * seq AS moment, conn_name AS name, conn_source AS source FROM full_log WHERE conn_name IS NOT NULL AND gone_name IS DISTINCT FROM conn_name UNION ALL SELECT *, 2 * seq + 1, gone_name, NULL FROM full_log WHERE gone_name IS NOT NULL) GROUP BY 1, 2, 3, 4")
def current_connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = flat(spark, sf_dir)
    base = ["scene_id", "layer_key", "prim"]
    made = d.filter("conn_name is not null and not (gone_name <=> conn_name)").select(*base, F.col("conn_name").alias("local_attr"), F.col("conn_source").alias("source"), (2 * F.col("seq")).alias("seq"))
    cut = d.filter("gone_name is not null").select(*base, F.col("gone_name").alias("local_attr"), F.lit(None).cast("string").alias("source"), (2 * F.col("seq") + 1).alias("seq"))
    return reduce.merged_connections(made.unionByName(cut))


@query(FULL_SQL + ", m AS (SELECT scene_id, seq, v1 AS metersPerUnit, CASE WHEN f2 IS NOT NULL THEN v2 END AS timeCodesPerSecond, up_axis FROM full_log WHERE k = 'set_stage_metadata') SELECT scene_id, arg_max(metersPerUnit, seq) AS metersPerUnit, arg_max(timeCodesPerSecond, seq) FILTER (timeCodesPerSecond IS NOT NULL) AS timeCodesPerSecond, arg_max(up_axis, seq) FILTER (up_axis IS NOT NULL) AS up_axis FROM m GROUP BY 1")
def stage_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = full_edits(spark, sf_dir).filter("k = 'set_stage_metadata'").select("scene_id", "seq", "up_axis", *(F.try_element_at("vals", F.lit(x)).alias(x) for x in ("metersPerUnit", "timeCodesPerSecond")))
    return reduce.latest_metadata(log, ["metersPerUnit", "timeCodesPerSecond", "up_axis"])


@query(FULL_SQL + ", t AS (SELECT DISTINCT scene_id, layer_key, k, prim FROM full_log), a AS (SELECT scene_id, layer_key, prim, max(seq) AS last FROM full_log GROUP BY 1, 2, 3) SELECT scene_id, layer_key, prim, last, row_number() OVER (PARTITION BY scene_id, layer_key ORDER BY length(prim) - length(replace(prim, '/', '')) - CASE WHEN prim = '/' THEN 1 ELSE 0 END, prim) AS nth FROM a")
def authored_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paths that each layer authored, from the top and by name."""
    return diff.authored_paths(full_edits(spark, sf_dir)).withColumn("nth", F.col("nth").cast("long"))


@query(FULL_SQL + ", s AS (SELECT seq, scene_id, k, spec_path, removed, CASE WHEN seq % 2 = 0 THEN 'prim' ELSE 'attribute' END AS spec_kind, length(prim) - length(replace(prim, '/', '')) AS depth FROM full_log WHERE k = 'set_sdf_spec_fields') SELECT scene_id, seq, row_number() OVER (PARTITION BY scene_id ORDER BY NOT removed, CASE WHEN removed THEN -depth ELSE depth END, CASE WHEN (spec_kind = 'prim') = removed THEN 1 ELSE 0 END, spec_path, seq) AS nth FROM s")
def spec_delta_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full_edits(spark, sf_dir).filter("k = 'set_sdf_spec_fields'").withColumn("spec_kind", F.expr("if(seq % 2 = 0, 'prim', 'attribute')"))
    return diff.spec_delta_order(rows).select("scene_id", "seq", F.col("nth").cast("long").alias("nth"))


@query(FULL_SQL + "SELECT seq, k, prim, json_extract_string(x, '$.layer_key') AS layer, json_extract_string(x, '$.new_name') AS new_name FROM (SELECT seq, k, prim, to_json({'layer_key': layer_key, 'new_name': new_name}) AS x FROM full_log)")
def log_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a dump holds besides seq, kind and prim, read back from its JSON."""
    rows = dumped(full_edits(spark, sf_dir))
    return rows.select("seq", "k", "prim", F.get_json_object("extras", "$.layer_key").alias("layer"), F.get_json_object("extras", "$.new_name").alias("new_name"))


@query(FULL_SQL + "SELECT 'flattened' AS role, 'flattened.usda' AS name, NULL AS layer_key UNION ALL SELECT 'root', 'root.usda', NULL UNION ALL SELECT 'layer', CASE WHEN layer_key = 'default' THEN 'main.usda' WHEN layer_key = 'department:animation' THEN 'show.usda' ELSE 'show_2.usda' END, layer_key FROM (SELECT DISTINCT layer_key FROM full_log WHERE layer_key <> 'department:fx')")
def snapshot_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A snapshot's files: layers that the log writes to and that are not muted, names made distinct."""
    used = full_edits(spark, sf_dir).select("layer_key").distinct()
    labels = used.select("layer_key", F.when(F.col("layer_key") == "default", "main").otherwise("show").alias("label"))
    return snapshot_manifest(layers(spark).join(used, "layer_key", "left_semi"), labels)


def _states(spark: SparkSession, sf_dir: str, where: str, keys: list[str], value, name: str) -> tuple[DataFrame, DataFrame]:
    """Two states of one channel: the last value by key up to the middle of the log, and at its end."""
    rows = flat(spark, sf_dir).filter(where)
    middle = flat(spark, sf_dir).agg(F.expr("max(seq) div 2")).first()[0]
    last = lambda r: r.groupBy(*keys).agg(F.max_by(value, "seq").alias(name))
    return last(rows.filter(F.col("seq") <= middle)), last(rows)


def _states_sql(where: str, keys: str, value: str, name: str, kind: str, changes: str = "true") -> str:
    state = lambda t, more: f"{t} AS (SELECT {keys}, arg_max({value}, seq) AS {name} FROM src WHERE {more} GROUP BY ALL)"
    names = [k.split(" AS ")[-1].strip() for k in keys.split(", ")]
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in names)
    key = ", ".join(f"coalesce(a.{k}, b.{k}) AS {k}" for k in names)
    return FULL_SQL + f""", src AS (SELECT * FROM full_log WHERE {where}), {state("a", "seq <= (SELECT max(seq) // 2 FROM full_log)")}, {state("b", "true")},
p AS (SELECT {key}, CASE WHEN a.scene_id IS NULL THEN 'create' WHEN b.scene_id IS NULL THEN 'remove' ELSE 'change' END AS change, a.{name} AS old_{name}, b.{name} AS new_{name}, '{kind}' AS k FROM a FULL JOIN b ON {on})
SELECT * FROM p WHERE (change <> 'change' OR old_{name} IS DISTINCT FROM new_{name}) AND {changes}"""


@query(_states_sql("k = 'set_point_instancer'", "scene_id, prim, time, f1 AS field", "'h' || CAST(v1 AS INT)", "fingerprint", "set_point_instancer"))
def instancer_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("h"), F.col("v1").cast("int").cast("string"))
    return diff.CHANNELS["instancers"].diff(*(s for s in _states(spark, sf_dir, "k = 'set_point_instancer'", ["scene_id", "prim", "time", F.col("f1").alias("field")], value, "fingerprint")))


@query(_states_sql("k = 'set_connectable_input'", "scene_id, prim, time, f1 AS input", "v1", "value", "set_connectable_input", "change <> 'remove'"))
def input_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.CHANNELS["inputs"].diff(*_states(spark, sf_dir, "k = 'set_connectable_input'", ["scene_id", "prim", "time", F.col("f1").alias("input")], F.col("v1"), "value"))


@query(_states_sql("conn_name IS NOT NULL", "scene_id, prim, conn_name AS local_attr", "conn_source", "source", "set_connectable_connection"))
def connection_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.CHANNELS["connections"].diff(*_states(spark, sf_dir, "conn_name is not null", ["scene_id", "prim", F.col("conn_name").alias("local_attr")], F.col("conn_source"), "source"))


@query(_states_sql("asset IS NOT NULL", "scene_id, prim, k AS kind", "position || ':' || asset", "arcs", "set_reference"))
def arc_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.CHANNELS["arcs"].diff(*_states(spark, sf_dir, "asset is not null", ["scene_id", "prim", F.col("k").alias("kind")], F.concat("position", F.lit(":"), "asset"), "arcs"))


@query(_states_sql("k IN ('load_payload', 'unload_payload')", "scene_id, prim", "k = 'load_payload'", "loaded", "load_payload", "change <> 'remove'"))
def payload_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.CHANNELS["payloads"].diff(*_states(spark, sf_dir, "k in ('load_payload', 'unload_payload')", ["scene_id", "prim"], F.col("k") == "load_payload", "loaded"))


@query(_states_sql("k = 'set_stage_metadata'", "scene_id, f1 AS key", "v1", "value", "set_stage_metadata", "change <> 'remove'"))
def metadata_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.CHANNELS["metadata"].diff(*_states(spark, sf_dir, "k = 'set_stage_metadata'", ["scene_id", F.col("f1").alias("key")], F.col("v1"), "value"))


@query(_states_sql("k = 'set_sdf_spec_fields' AND f1 IS NOT NULL", "scene_id, CASE WHEN removed THEN 'prim' ELSE 'attribute' END AS spec_kind, spec_path, f1 AS field", "v1", "value", "set_sdf_spec_fields"))
def spec_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.CHANNELS["specs"].diff(*_states(spark, sf_dir, "k = 'set_sdf_spec_fields' and f1 is not null", ["scene_id", F.expr("if(removed, 'prim', 'attribute')").alias("spec_kind"), "spec_path", F.col("f1").alias("field")], F.col("v1"), "value"))


@query(_states_sql("k = 'set_sublayers'", "scene_id, layer_key AS parent_key", "'L' || CAST(v1 AS INT)", "sublayers", "set_sublayers").replace("SELECT * FROM p", "SELECT * EXCLUDE (scene_id), scene_id FROM p"))
def topology_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("L"), F.col("v1").cast("int").cast("string"))
    keys = ("scene_id", "parent_key")
    channel = diff.Channel("topology", "set_sublayers", keys, ("sublayers",))
    return channel.diff(*_states(spark, sf_dir, "k = 'set_sublayers'", ["scene_id", F.col("layer_key").alias("parent_key")], value, "sublayers"))


@query(FULL_SQL + ", v AS (SELECT scene_id, prim, bool_or(flag) FILTER (k = 'set_instanceable') AS instanceable, bool_or(k = 'set_point_instancer') AS instancer, max(type_name) AS t, max(material_path) AS m, arg_max(flag, seq) FILTER (k = 'deactivate_prim') AS off FROM full_log WHERE prim <> '/' GROUP BY 1, 2) SELECT scene_id, count(*) AS total, count(*) FILTER (NOT coalesce(off, false)) AS active, count(DISTINCT m) AS materials, max(length(prim) - length(replace(prim, '/', ''))) AS max_depth, count(*) FILTER (instanceable) AS instances, count(*) FILTER (instancer) AS instancers FROM v GROUP BY 1")
def scene_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.scene_overview(_prims(spark, sf_dir)).withColumn("max_depth", F.col("max_depth").cast("long"))


def _prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is known of each prim: type, material, flags."""
    rows = full_edits(spark, sf_dir).filter("prim <> '/'")
    return rows.groupBy("scene_id", "prim").agg(F.max(F.when(F.col("k") == "set_instanceable", F.col("flag"))).alias("instanceable"), F.max(F.col("k") == "set_point_instancer").alias("is_point_instancer"), F.max("type_name").alias("type_name"), F.max("material_path").alias("material"), F.max_by("flag", F.when(F.col("k") == "deactivate_prim", F.col("seq"))).alias("inactive"))


@query(FULL_SQL + ", v AS (SELECT scene_id, prim, max(type_name) AS t FROM full_log WHERE prim <> '/' GROUP BY 1, 2) SELECT scene_id, t AS type_name, count(*) AS n FROM v GROUP BY 1, 2")
def type_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.type_histogram(_prims(spark, sf_dir))


_TYPES = ", base(type_name, base) AS (VALUES ('T0', 'T0'), ('T1', 'T1'), ('T1', 'T0'), ('T2', 'T2'), ('T2', 'T0'), ('T3', 'T3')), v AS (SELECT scene_id, prim, max(type_name) AS t FROM full_log WHERE prim <> '/' GROUP BY 1, 2)"


@query(FULL_SQL + _TYPES + ", l AS (SELECT * FROM v WHERE starts_with(prim, '/World/') AND t IN (SELECT type_name FROM base WHERE base = 'T0') AND length(prim) - length(replace(prim, '/', '')) <= 3) SELECT scene_id, prim, t AS type_name, (SELECT count(*) FROM l) AS total FROM l ORDER BY scene_id, string_split(prim, '/') LIMIT 50 OFFSET 5")
def prim_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of the prims below a root that are of a type or of one derived from it, down to a depth."""
    hierarchy = spark.createDataFrame([("T0", "T0"), ("T1", "T1"), ("T1", "T0"), ("T2", "T2"), ("T2", "T0"), ("T3", "T3")], "type_name string, base string")
    rows = inspect.listed(_prims(spark, sf_dir), under="/World", is_a="T0", hierarchy=hierarchy, depth_limit=2)
    return inspect.path_page(rows.select("scene_id", "prim", "type_name"), offset=5, limit=50).drop("next_offset")


@query(FULL_SQL + ", v AS (SELECT DISTINCT scene_id, prim FROM full_log WHERE prim LIKE '/World/G%/P%'), r AS (SELECT scene_id, '/World/' || split_part(prim, '/', 3) AS parent, split_part(prim, '/', -1) AS name, row_number() OVER (PARTITION BY scene_id, split_part(prim, '/', 3) ORDER BY split_part(prim, '/', -1)) AS nth FROM v) SELECT scene_id, parent, count(*) AS n_children, string_agg(name, ',' ORDER BY name) FILTER (nth <= 8) AS children FROM r GROUP BY 1, 2")
def bounded_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full_edits(spark, sf_dir).filter("prim like '/World/G%/P%'").select("scene_id", "prim").distinct()
    return inspect.bounded_children(rows, most=8).select("scene_id", "parent", "n_children", F.array_join("children", ",").alias("children"))


@query(FULL_SQL + ", v AS (SELECT scene_id, prim, max(type_name) AS type_name, max(material_path) AS material, bool_or(flag) FILTER (k = 'set_instanceable') AS instanceable FROM full_log WHERE prim <> '/' GROUP BY 1, 2) SELECT scene_id, prim, type_name, instanceable FROM v")
def prim_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the sections that are asked for."""
    return inspect.details(_prims(spark, sf_dir), ["type_name", "instanceable"])


@query(FULL_SQL + ", s AS (SELECT DISTINCT scene_id FROM full_log), x AS (SELECT scene_id, layer_key, prim, arg_max(v1, seq) FILTER (f1 = 't') AS t, arg_max(v1, seq) FILTER (f1 = 's') AS s FROM full_log WHERE k = 'set_xform_trs' AND time IS NULL GROUP BY 1, 2, 3) SELECT scene_id, layer_key, prim, round(t / 3, 5) AS t, round(s / 3, 5) AS s FROM x WHERE t IS NOT NULL OR s IS NOT NULL")
def authored_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = full_edits(spark, sf_dir).filter("k = 'set_xform_trs' and time is null").groupBy("scene_id", "layer_key", "prim").agg(*(F.max_by(F.try_element_at("vals", F.lit(f)), F.when(F.array_contains("fields", f), F.col("seq"))).alias(f) for f in "ts"))
    vectors = rows.select("scene_id", "layer_key", "prim", *(F.when(F.col(f).isNotNull(), F.array(F.col(f) / 3)).alias(f) for f in "ts"), F.lit(None).cast("array<double>").alias("r"))
    return inspect.authored_transforms(vectors).select("scene_id", "layer_key", "prim", *(F.get(f, F.lit(0)).alias(f) for f in "ts"))


@query("SELECT vec_id, 'embedding' AS name, 'float[]' AS type, len(embedding) AS size, CAST(embedding[1] AS DOUBLE) AS first, true AS cut FROM embeddings UNION ALL SELECT vec_id, 'label', 'int', NULL, CAST(label AS DOUBLE), false FROM embeddings")
def authored_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attribute rows: arrays by type and length, with a sample of their first items."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    arrays = inspect.array_rows(e.select("vec_id", F.lit("embedding").alias("name"), F.col("embedding").cast("array<double>").alias("items")), "float", most=4)
    plain = e.select("vec_id", F.lit("label").alias("name"), F.lit("int").alias("type"), F.lit(None).cast("long").alias("size"), F.array(F.col("label").cast("double")).alias("items"), F.lit(False).alias("cut"))
    return arrays.unionByName(plain).select("vec_id", "name", "type", "size", F.get("items", F.lit(0)).alias("first"), "cut")
