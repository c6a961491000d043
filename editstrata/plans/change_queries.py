"""Queries on what changed between two states of the scenes: before and after the middle of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, diff, inspect
from ..sources.edit_log import EDITS_SQL, edits, layers
from .log_queries import wide
from .registry import query

#: The seq that parts the two states: every scene's first edits up to it are the state before.
MIDDLE = "(SELECT max(event_id) // 2 FROM events)"


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    log = wide(spark, sf_dir)
    middle = log.agg(F.expr("max(event_id) div 2")).first()[0]
    return log.filter(F.col("seq") <= middle), log


def composed_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    a, b = halves(spark, sf_dir)
    return compose.composed(a, layers(spark)), compose.composed(b, layers(spark))


def _composed_sql(name: str, where: str) -> str:
    alive = f"SELECT 1 FROM edits x WHERE x.k = 'delete_prim' AND {where} AND x.scene_id = e.scene_id AND x.layer_key = e.layer_key AND x.seq > e.seq AND (x.prim = e.prim OR starts_with(e.prim, x.prim || '/'))"
    return f""", o{name} AS (SELECT e.*, l.rank FROM (SELECT * FROM edits e WHERE {where} AND NOT EXISTS ({alive.replace("seq <=", "x.seq <=")})) e JOIN layers l USING (layer_key) WHERE field <> '' AND NOT muted),
b{name} AS (SELECT scene_id, prim, field, time IS NULL AS u, min(rank) AS rank FROM o{name} GROUP BY ALL),
{name} AS (SELECT o.scene_id, o.prim, o.field, o.time, arg_max(o.value, o.seq) AS value FROM o{name} o JOIN b{name} b ON o.scene_id = b.scene_id AND o.prim = b.prim AND o.field = b.field AND (o.time IS NULL) = b.u AND o.rank = b.rank GROUP BY 1, 2, 3, 4)
"""


STATES = EDITS_SQL + _composed_sql("before", f"seq <= {MIDDLE}") + _composed_sql("after", "true") + """, pairs AS (SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, coalesce(a.prim, b.prim) AS prim, coalesce(a.field, b.field) AS field, coalesce(a.time, b.time) AS time,
  CASE WHEN a.scene_id IS NULL THEN 'create' WHEN b.scene_id IS NULL THEN 'remove' ELSE 'change' END AS change, a.value AS old_value, b.value AS new_value
  FROM before a FULL JOIN after b ON a.scene_id = b.scene_id AND a.prim = b.prim AND a.field = b.field AND a.time IS NOT DISTINCT FROM b.time),
changes AS (SELECT * FROM pairs WHERE change <> 'change' OR old_value IS DISTINCT FROM new_value)
"""


@query(STATES + "SELECT * FROM changes")
def state_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    middle = log.agg(F.expr("max(event_id) div 2")).first()[0]
    return diff.value_changes(compose.composed_twice(log, layers(spark), middle))


@query(STATES + "SELECT *, 'set_gprim_attrs' AS k FROM changes WHERE change <> 'remove' AND starts_with(field, 'a')")
def attribute_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field like 'a%'") for s in composed_states(spark, sf_dir))
    return diff.CHANNELS["attributes"].diff(a, b).select("scene_id", "prim", "time", "field", "change", "old_value", "new_value", "k")


@query(STATES + "SELECT *, 'set_xform_trs' AS k FROM changes WHERE change <> 'remove' AND field IN ('t', 's')")
def transform_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field in ('t', 's')") for s in composed_states(spark, sf_dir))
    return diff.CHANNELS["transforms"].diff(a, b)


@query(STATES + "SELECT scene_id, prim, time, change, old_value > 10 AS old_visible, new_value > 10 AS new_visible, 'set_visibility' AS k FROM pairs WHERE field = 'visibility' AND change <> 'remove' AND (change = 'create' OR (old_value > 10) IS DISTINCT FROM (new_value > 10))")
def visibility_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field = 'visibility'").select("scene_id", "prim", "time", (F.col("value") > 10).alias("visible")) for s in composed_states(spark, sf_dir))
    return diff.CHANNELS["visibility"].diff(a, b)


@query(STATES + "SELECT scene_id, prim, field, time FROM pairs WHERE change = 'remove' AND time IS NOT NULL")
def erased_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.erased_samples(*composed_states(spark, sf_dir))


@query(STATES + "SELECT scene_id, prim, change, old_value < 15 AS old_active, new_value < 15 AS new_active, 'deactivate_prim' AS k FROM pairs WHERE field = 'a1' AND time IS NULL AND change <> 'remove' AND NOT (change = 'create' AND new_value < 15) AND (change = 'create' OR (old_value < 15) IS DISTINCT FROM (new_value < 15))")
def active_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field = 'a1' and time is null").select("scene_id", "prim", (F.col("value") < 15).alias("active")) for s in composed_states(spark, sf_dir))
    return diff.CHANNELS["active"].diff(a, b)


@query(STATES + "SELECT scene_id, prim, change, old_value > 15 AS old_instanceable, new_value > 15 AS new_instanceable, 'set_instanceable' AS k FROM pairs WHERE field = 'a2' AND time IS NULL AND change <> 'remove' AND NOT (change = 'create' AND NOT new_value > 15) AND (change = 'create' OR (old_value > 15) IS DISTINCT FROM (new_value > 15))")
def instanceable_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field = 'a2' and time is null").select("scene_id", "prim", (F.col("value") > 15).alias("instanceable")) for s in composed_states(spark, sf_dir))
    return diff.CHANNELS["instanceable"].diff(a, b)


@query(STATES + ", s AS (SELECT scene_id, prim, field AS variant_set, change, 'v' || CAST(floor(old_value) % 3 AS INT) AS a, 'v' || CAST(floor(new_value) % 3 AS INT) AS b FROM pairs WHERE field IN ('a3', 'a4') AND time IS NULL) SELECT scene_id, prim, variant_set, coalesce(b, '') AS selection FROM s WHERE a IS DISTINCT FROM b")
def variant_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field in ('a3', 'a4') and time is null").select("scene_id", "prim", F.col("field").alias("variant_set"), F.concat(F.lit("v"), (F.floor("value") % 3).cast("string")).alias("selection")) for s in composed_states(spark, sf_dir))
    return diff.with_cleared_variants(a, b)


@query(STATES + ", s AS (SELECT scene_id, prim, field AS purpose, change, '/Mat/M' || CAST(floor(old_value) % 5 AS INT) AS old_material, '/Mat/M' || CAST(floor(new_value) % 5 AS INT) AS new_material FROM pairs WHERE field IN ('a0', 'a1') AND time IS NULL) SELECT *, 'set_material_binding' AS k FROM s WHERE change <> 'change' OR old_material <> new_material")
def material_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field in ('a0', 'a1') and time is null").select("scene_id", "prim", F.col("field").alias("purpose"), F.concat(F.lit("/Mat/M"), (F.floor("value") % 5).cast("string")).alias("material")) for s in composed_states(spark, sf_dir))
    return diff.CHANNELS["materials"].diff(a, b)


def _live_sql(name: str, where: str) -> str:
    return f""", m{name} AS (SELECT scene_id, prim, max(seq) AS seq, 'T' || arg_max(kk % 7, seq) AS t FROM edits WHERE k = 'ensure_prim' AND {where} GROUP BY 1, 2),
{name} AS (SELECT scene_id, prim, 'T' || (seq % 2) AS type_name FROM m{name} m WHERE NOT EXISTS (SELECT 1 FROM edits x WHERE x.k = 'delete_prim' AND {where} AND x.scene_id = m.scene_id AND x.seq > m.seq AND (x.prim = m.prim OR starts_with(m.prim, x.prim || '/'))))
"""


PRIMS = EDITS_SQL + _live_sql("before", f"seq <= {MIDDLE}").replace(f"AND seq <= {MIDDLE} AND x.", f"AND x.seq <= {MIDDLE} AND x.") + _live_sql("after", "true") + """, pairs AS (SELECT coalesce(a.scene_id, b.scene_id) AS scene_id, coalesce(a.prim, b.prim) AS prim, a.type_name AS old, b.type_name AS new FROM before a FULL JOIN after b ON a.scene_id = b.scene_id AND a.prim = b.prim)
"""


def prim_states(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    states = (inspect.live_prims(x).withColumn("type_name", F.concat(F.lit("T"), (F.col("seq") % 2).cast("string"))).drop("seq") for x in halves(spark, sf_dir))
    return tuple(states)


@query(PRIMS + """, r AS (SELECT scene_id, prim, 'delete_prim' AS k, NULL AS type_name FROM pairs WHERE old IS NOT NULL AND old IS DISTINCT FROM new
  UNION ALL SELECT scene_id, prim, 'ensure_prim', new FROM pairs WHERE new IS NOT NULL AND old IS DISTINCT FROM new)
SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY k = 'ensure_prim', CASE k WHEN 'delete_prim' THEN -1 ELSE 1 END * (length(prim) - length(replace(prim, '/', ''))), prim) AS nth FROM r""")
def prim_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.lifecycle(*prim_states(spark, sf_dir)).withColumn("nth", F.col("nth").cast("long"))


@query(PRIMS + """, c AS (SELECT scene_id, count(old) AS n_before, count(new) AS n_after, count(*) FILTER (old IS NULL) AS created, count(*) FILTER (new IS NULL) AS removed, count(*) FILTER (old <> new) AS type_changed,
  coalesce(bool_or(length(prim) - length(replace(prim, '/', '')) <= 1) FILTER (new IS NULL), false) AS top FROM pairs GROUP BY 1)
SELECT scene_id, n_before, n_after, created, removed, type_changed, removed > 0 AND (n_after = 0 OR top OR (n_before >= 10 AND removed >= 0.8 * n_before)) AS destructive FROM c""")
def snapshot_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.snapshot_analysis(*prim_states(spark, sf_dir))


@query(PRIMS + ", g AS (SELECT scene_id, prim, old AS type_name FROM pairs WHERE old IS NOT NULL AND new IS NULL) SELECT *, 'deactivate_prim' AS k, false AS flag FROM g a WHERE NOT EXISTS (SELECT 1 FROM g b WHERE a.scene_id = b.scene_id AND starts_with(a.prim, b.prim || '/'))")
def removed_prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prims that an uploaded snapshot left out, which are deactivated."""
    return diff.deactivations(*prim_states(spark, sf_dir))


@query(PRIMS + ", p AS (SELECT scene_id, prim FROM after UNION SELECT scene_id, prim FROM edits WHERE k = 'delete_prim' AND prim NOT LIKE '/World/G%/P%') SELECT * FROM p a WHERE NOT EXISTS (SELECT 1 FROM p b WHERE a.scene_id = b.scene_id AND starts_with(a.prim, b.prim || '/'))")
def minimal_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    tops = log.filter("k = 'delete_prim' and prim not like '/World/G%/P%'").select("scene_id", "prim")
    return diff.minimal_roots(prim_states(spark, sf_dir)[1].select("scene_id", "prim").unionByName(tops).distinct())


@query(EDITS_SQL + "SELECT DISTINCT scene_id, prim, CASE WHEN prim LIKE '/World/G1/%' OR prim = '/World/G1' THEN '/World/G1' ELSE '/World' END AS root FROM edits")
def owning_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir).select("scene_id", "prim").distinct()
    scenes = log.select("scene_id").distinct()
    roots = scenes.withColumn("prim", F.explode(F.array(F.lit("/World"), F.lit("/World/G1"))))
    return diff.owning_roots(log, roots)


@query(PRIMS + ", need AS (SELECT DISTINCT scene_id, unnest(CASE WHEN prim LIKE '/World/G%/P%' THEN ['/World', split_part(prim, '/', 1) || '/World/' || split_part(prim, '/', 3)] ELSE ['/World'] END) AS prim FROM edits) SELECT scene_id, prim, length(prim) - length(replace(prim, '/', '')) AS depth FROM need n WHERE NOT EXISTS (SELECT 1 FROM after a WHERE a.scene_id = n.scene_id AND a.prim = n.prim)")
def missing_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.missing_ancestors(edits(spark, sf_dir), prim_states(spark, sf_dir)[1]).withColumn("depth", F.col("depth").cast("long"))


@query(PRIMS + """, t AS (SELECT scene_id, prim, CASE WHEN prim LIKE '/World/G%/P%' THEN '/World/' || split_part(prim, '/', 3) ELSE '/World' END AS parent FROM after)
SELECT t.scene_id, t.prim, t.parent, length(t.prim) - length(replace(t.prim, '/', '')) AS depth, (SELECT count(*) FROM t c WHERE c.scene_id = t.scene_id AND c.parent = t.prim) AS n_children FROM t""")
def prim_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diff.tree(prim_states(spark, sf_dir)[1].select("scene_id", "prim")).withColumn("depth", F.col("depth").cast("long")).drop("has_children")


@query(EDITS_SQL + """, c AS (SELECT scene_id, CASE WHEN prim LIKE '/World/G%/P%' THEN '/World/' || split_part(prim, '/', 3) ELSE prim END AS root, max(seq) AS at FROM edits WHERE kk = 12 GROUP BY 1, 2),
o AS (SELECT e.scene_id, e.seq, e.k, e.prim, c.root, coalesce(CASE WHEN e.k IN ('ensure_prim', 'delete_prim') AND c.at > e.seq AND e.prim <> c.root THEN c.at END, e.seq) AS pos FROM edits e LEFT JOIN c ON e.scene_id = c.scene_id AND (e.prim = c.root OR starts_with(e.prim, c.root || '/')))
SELECT scene_id, seq, row_number() OVER (PARTITION BY scene_id ORDER BY pos, pos <> seq, seq) AS nth FROM o""")
def deferred_lifecycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    root = F.when(F.col("prim").rlike("^/World/G[0-9]+/P"), F.concat(F.lit("/World/"), F.split("prim", "/")[2])).otherwise(F.col("prim"))
    controls = log.filter("kk = 12").select("scene_id", root.alias("prim"), "seq")
    return diff.deferred_lifecycle(log.select("scene_id", "seq", "k", "prim"), controls).select("scene_id", "seq", F.col("nth").cast("long").alias("nth"))
