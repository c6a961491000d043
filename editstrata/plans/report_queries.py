"""Queries for reports, present states and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, diff, graph, inspect, sequence
from ..sources.edit_log import EDITS_SQL, edits, layers
from ..streaming import feeds
from .change_queries import STATES, composed_states
from .full_log import FULL_SQL, flat, full_edits
from .log_queries import LIVE
from .order_queries import ARRIVALS, RECURSIVE_EDITS, arrivals
from .registry import query


@query("WITH s AS (SELECT p_size AS samples, unnest(list_distinct(['src/' || p_type || '.py', 'src/' || p_brand || '.py', 'src/' || p_type || '.py'])) AS file FROM part) SELECT file, CAST(sum(samples) AS BIGINT) AS inclusive FROM s GROUP BY 1")
def file_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stacks of four frames, one without a file."""
    frame = lambda name, line: F.concat(F.lit("f (src/"), name, F.lit(f".py:{line})"))
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    stacks = p.select(F.array(F.lit("idle"), frame("p_type", 1), frame("p_brand", 2), frame("p_type", 3)).alias("frames"), F.col("p_size").cast("long").alias("samples"))
    return inspect.file_totals(stacks)


@query(EDITS_SQL + """, t AS (SELECT layer_key AS department, CAST(event_id AS DOUBLE) AS at_s, value AS latency FROM edits),
c AS (SELECT *, row_number() OVER (PARTITION BY department ORDER BY latency) - 1 AS r, count(*) OVER (PARTITION BY department) AS n FROM t)
SELECT department, any_value(n) AS transactions, round(any_value(n) / (max(at_s) - min(at_s)), 6) AS throughput, max(latency) FILTER (r = n // 2) AS median, max(latency) FILTER (r = CAST(floor((n - 1) * 0.95) AS BIGINT)) AS p95, max(latency) AS max FROM c GROUP BY 1""")
def workload_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(spark, sf_dir).select(F.col("layer_key").alias("department"), F.col("event_id").cast("double").alias("at"), F.col("value").alias("latency"))
    return inspect.workload(rows).withColumn("throughput", F.round("throughput", 6))


@query(EDITS_SQL + "SELECT client_id, count(*) AS n, CASE WHEN bool_or(k = 'delete_prim') THEN 'editor' ELSE 'viewer' END AS role FROM edits GROUP BY 1")
def client_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    roles = log.filter("k = 'delete_prim'").select("client_id").distinct().withColumn("role", F.lit("editor"))
    return inspect.clients(log, F.timestamp_micros(F.lit(1893456000000000)), roles).drop("idle_s")


@query("""WITH p AS (SELECT '/W/L' || (label % 3) || '/V' || vec_id AS prim, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
u AS (SELECT unnest(['/W', '/W/' || split_part(prim, '/', 3), prim]) AS prim, x, y, z FROM p), b AS (SELECT prim, min(x) AS a, max(x) AS b, min(z) AS c, max(z) AS d FROM u GROUP BY 1), n AS (SELECT prim FROM b UNION SELECT '/W/none')
SELECT prim, round((a + b) / 2, 6) AS x_center, round(b - a, 6) AS x_size, round((c + d) / 2, 6) AS z_center, a IS NULL AS empty FROM n LEFT JOIN b USING (prim)""")
def subtree_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prim = F.concat(F.lit("/W/L"), F.col("label") % 3, F.lit("/V"), "vec_id")
    bounds = inspect.bounds(e.select(F.lit("s").alias("scene_id"), prim.alias("prim"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz"))))
    prims = bounds.select("scene_id", "prim").unionByName(spark.createDataFrame([("s", "/W/none")], "scene_id string, prim string"))
    return inspect.boxes(prims, bounds).select("prim", *(F.round(c, 6).alias(c) for c in ("x_center", "x_size", "z_center")), "empty")


@query(FULL_SQL + "SELECT scene_id, layer_key, prim, material_purpose AS purpose, arg_max(material_path, seq) AS material FROM full_log WHERE k = 'set_material_binding' GROUP BY 1, 2, 3, 4")
def material_bindings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.bindings(full_edits(spark, sf_dir))


@query(EDITS_SQL + """, s AS (SELECT client_id, event_id AS arrival, event_id // 4000 AS generation, kk AS revision FROM edits),
b AS (SELECT *, max(revision) OVER (PARTITION BY client_id, generation ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT client_id, arrival, generation, revision, CASE WHEN before IS NULL OR revision > before THEN 'accepted' WHEN revision = before THEN 'repeated' ELSE 'stale' END AS outcome FROM b""")
def state_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = edits(spark, sf_dir).select("client_id", F.col("event_id").alias("arrival"), F.expr("event_id div 4000").alias("generation"), F.col("kk").alias("revision"))
    return sequence.state_outcomes(states, key="client_id")


@query(RECURSIVE_EDITS + """, r AS (SELECT prim AS parent_key, event_id AS arrival, CAST(kk % 3 + (event_id % 2) AS BIGINT) AS base, event_id % 9 <> 0 AS known, row_number() OVER (PARTITION BY prim ORDER BY event_id) AS nth FROM edits WHERE k <> 'delete_prim'),
f AS (SELECT parent_key, arrival, base, known, nth, CAST(0 AS BIGINT) AS current FROM r WHERE nth = 1
  UNION ALL SELECT r.parent_key, r.arrival, r.base, r.known, r.nth, f.current + CASE WHEN f.known AND f.base = f.current THEN 1 ELSE 0 END FROM f JOIN r ON r.parent_key = f.parent_key AND r.nth = f.nth + 1)
SELECT parent_key, arrival, base, known AND base = current AS accepted, current FROM f""")
def generation_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(spark, sf_dir).filter("k <> 'delete_prim'").select(F.col("prim").alias("parent_key"), F.col("event_id").alias("arrival"), (F.col("kk") % 3 + F.col("event_id") % 2).cast("long").alias("base"), F.when(F.col("event_id") % 9 != 0, "g").alias("generation"))
    return sequence.swaps(rows, generation="g")


@query(EDITS_SQL + ARRIVALS + """, a AS (SELECT client_id, session_id, txn_id + CASE WHEN arrival % 13 = 0 THEN 1000 ELSE 0 END AS txn_id, arrival FROM arrivals), l AS (SELECT client_id, session_id, max(txn_id) AS last FROM arrivals GROUP BY 1, 2),
b AS (SELECT a.*, last, max(txn_id) OVER (PARTITION BY client_id, session_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM a JOIN l USING (client_id, session_id))
SELECT client_id, session_id, txn_id, arrival, CASE WHEN txn_id > last THEN 'ahead' ELSE 'behind' END AS fault FROM b WHERE txn_id > last OR txn_id < before""")
def ack_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every thirteenth acknowledgement is far ahead; those that come late are behind."""
    rows = arrivals(spark, sf_dir).drop("n_events")
    acks = rows.withColumn("txn_id", F.col("txn_id") + F.when(F.col("arrival") % 13 == 0, 1000).otherwise(0))
    return sequence.ack_faults(rows, acks)


@query(EDITS_SQL + ", m AS (SELECT scene_id, seq, k, prim FROM edits WHERE starts_with(prim, '/World/G1/') OR k = 'delete_prim') SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY seq) AS nth FROM m")
def merged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edits below a prim and all deletions, those that are both once."""
    log = edits(spark, sf_dir).select("scene_id", "seq", "k", "prim")
    return sequence.merged(log.filter(F.col("prim").startswith("/World/G1/")), log.filter("k = 'delete_prim'")).withColumn("nth", F.col("nth").cast("long"))


@query(FULL_SQL + """, e AS (SELECT k, seq, concat('id-', v1) AS identifier, CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN concat('key-', v1) ELSE 'other' END AS key, v1 FROM full_log WHERE k = 'set_sublayers') SELECT seq, CASE WHEN CAST(v1 AS BIGINT) % 4 = 0 THEN 'new' WHEN key IS NULL OR key = concat('key-', v1) THEN 'adopted' ELSE 'stale' END AS outcome FROM e""")
def child_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat(spark, sf_dir).filter("k = 'set_sublayers'")
    edges = rows.select("seq", F.concat(F.lit("id-"), "v1").alias("identifier"), F.expr("CASE WHEN seq % 3 = 0 THEN NULL WHEN seq % 3 = 1 THEN concat('key-', v1) ELSE 'other' END").alias("key"))
    known = rows.filter("cast(v1 as bigint) % 4 <> 0").select(F.concat(F.lit("id-"), "v1").alias("identifier"), F.concat(F.lit("key-"), "v1").alias("layer_key")).distinct()
    return graph.child_outcomes(edges, known).select("seq", "outcome")


_SHADERS = FULL_SQL + """, src AS (SELECT * FROM full_log WHERE k = 'set_connectable_input'), mid AS (SELECT max(seq) // 2 AS m FROM full_log),
a AS (SELECT scene_id, prim, time, f1 AS input, arg_max(v1, seq) AS value FROM src, mid WHERE seq <= m GROUP BY 1, 2, 3, 4), b AS (SELECT scene_id, prim, time, f1 AS input, arg_max(v1, seq) AS value FROM src GROUP BY 1, 2, 3, 4),
sa AS (SELECT scene_id, prim, arg_max(info_id, seq) AS info FROM src, mid WHERE seq <= m AND info_id IS NOT NULL GROUP BY 1, 2), sb AS (SELECT scene_id, prim, arg_max(info_id, seq) AS info FROM src WHERE info_id IS NOT NULL GROUP BY 1, 2),
remade AS (SELECT scene_id, prim FROM sa JOIN sb USING (scene_id, prim) WHERE sa.info <> sb.info)
"""


@query(_SHADERS + "SELECT b.* FROM b LEFT JOIN a ON a.scene_id = b.scene_id AND a.prim = b.prim AND a.time IS NOT DISTINCT FROM b.time AND a.input = b.input WHERE a.value IS DISTINCT FROM b.value OR (b.scene_id, b.prim) IN (SELECT scene_id, prim FROM remade)")
def shader_input_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = flat(spark, sf_dir).filter("k = 'set_connectable_input'")
    middle = flat(spark, sf_dir).agg(F.expr("max(seq) div 2")).first()[0]
    early = rows.filter(F.col("seq") <= middle)
    state = lambda r: r.groupBy("scene_id", "prim", "time", F.col("f1").alias("input")).agg(F.max_by("v1", "seq").alias("value"))
    info = lambda r: r.filter("info_id is not null").groupBy("scene_id", "prim").agg(F.max_by("info_id", "seq").alias("info_id"))
    return diff.connectable_changes(state(early), state(rows), info(early), info(rows))


@query(STATES + """, t AS (SELECT scene_id, prim, time, field, new_value AS value FROM changes WHERE change <> 'remove' AND field IN ('t', 's')), ops AS (SELECT DISTINCT scene_id, prim FROM before WHERE field IN ('t', 's')),
e AS (SELECT DISTINCT scene_id, prim, 'ensure_xform_ops' AS k, NULL::DOUBLE AS time, NULL AS field, NULL::DOUBLE AS value FROM t WHERE (scene_id, prim) NOT IN (SELECT scene_id, prim FROM ops) UNION ALL SELECT scene_id, prim, 'set_xform_trs', time, field, value FROM t)
SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY length(prim) - length(replace(prim, '/', '')), prim, k <> 'ensure_xform_ops', time IS NOT NULL, coalesce(time, 0), coalesce(field, '')) AS nth FROM e""")
def transform_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (s.filter("field in ('t', 's')") for s in composed_states(spark, sf_dir))
    changes = diff.CHANNELS["transforms"].diff(a, b).select("scene_id", "prim", "time", "field", F.col("new_value").alias("value"))
    return diff.transform_events(changes, a).withColumn("nth", F.col("nth").cast("long"))


@query(STATES + "SELECT scene_id, prim, field, change, old_value, new_value FROM pairs WHERE time IS NULL AND change <> 'remove' AND field NOT IN ('t', 's', 'visibility', 'a4') AND (change = 'create' OR NOT coalesce(abs(old_value - new_value) <= 0.5, false))")
def unowned_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Default attributes that no other channel owns, changed by more than a half."""
    a, b = (s.filter("time is null").select("scene_id", "prim", "field", "value") for s in composed_states(spark, sf_dir))
    return diff.unowned_attributes(a, b, ["t", "s", "visibility", "a4"], lambda x, y: F.abs(x - y) <= 0.5)


@query(EDITS_SQL + ", t AS (SELECT *, epoch_us(ts) // 3600000000 AS w FROM edits WHERE k = 'set_xform_trs') SELECT scene_id, prim, field, arg_max(value, seq) AS value, min(seq) AS seq FROM t GROUP BY scene_id, prim, field, w")
def coalesced_by_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms merged by the hour; the same plan runs as a stream."""
    return feeds.coalesced_by_time(edits(spark, sf_dir), every="1 hour").drop("due")


@query(EDITS_SQL + LIVE + """, f AS (SELECT scene_id, prim, bool_or(k = 'set_xform_trs') AS instanceable FROM edits GROUP BY 1, 2), t AS (SELECT l.scene_id, l.prim, CASE WHEN l.prim LIKE '/World/G%/P%' THEN '/World/' || split_part(l.prim, '/', 3) ELSE '/World' END AS parent, instanceable FROM live l JOIN f ON f.scene_id = l.scene_id AND f.prim = l.prim)
SELECT t.scene_id, t.prim, t.parent, t.instanceable, EXISTS (SELECT 1 FROM t c WHERE c.scene_id = t.scene_id AND c.parent = t.prim) AS has_children FROM t""")
def prim_tree_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    flags = log.groupBy("scene_id", "prim").agg(F.max(F.col("k") == "set_xform_trs").alias("instanceable"))
    return diff.tree(inspect.live_prims(log).select("scene_id", "prim").join(flags, ["scene_id", "prim"])).drop("depth", "n_children")


@query(EDITS_SQL + "SELECT 'upload' AS part, count(*) AS n FROM edits WHERE seq <= 100 UNION ALL SELECT 'rest', count(*) FROM edits WHERE seq > 100")
def handover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History up to a frozen head and what follows: each row once."""
    past, rest = feeds.handover(edits(spark, sf_dir), 100)
    return past.agg(F.count("*").alias("n")).select(F.lit("upload").alias("part"), "n").unionByName(rest.agg(F.count("*").alias("n")).select(F.lit("rest").alias("part"), "n"))


@query(EDITS_SQL + ", w AS (SELECT DISTINCT layer_key FROM edits WHERE layer_key <> 'default' UNION SELECT 'no_such') SELECT layer_key, 'missing' AS fault FROM layers WHERE layer_key NOT IN (SELECT layer_key FROM w) UNION ALL SELECT layer_key, 'unknown' FROM w WHERE layer_key NOT IN (SELECT layer_key FROM layers)")
def order_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = edits(spark, sf_dir).filter("layer_key <> 'default'").select("layer_key").distinct().unionByName(spark.createDataFrame([("no_such",)], "layer_key string"))
    return inspect.order_faults(layers(spark), wanted)


@query(STATES + "SELECT count(*) = 0 AS same FROM (SELECT scene_id, prim, field, time, value FROM before EXCEPT ALL SELECT scene_id, prim, field, time, value FROM after)")
def content_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether two composed states hold the same content."""
    a, b = (s.select("scene_id", "prim", "field", "time", "value") for s in composed_states(spark, sf_dir))
    return spark.createDataFrame([(diff.same_content(a, b),)], "same boolean")


@query(EDITS_SQL + ", c AS (SELECT client_id, max(seq) AS applied_seq, CAST(max(kk) % 2 AS BIGINT) AS epoch FROM edits GROUP BY 1) SELECT client_id, epoch = 1 AND applied_seq >= 500 AS ready FROM c")
def receivers_ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    applied = edits(spark, sf_dir).groupBy("client_id").agg(F.max("seq").alias("applied_seq"), (F.max("kk") % 2).cast("long").alias("epoch"))
    return feeds.ready(applied, head=500, epoch=1).select("client_id", "ready")


@query(EDITS_SQL + "SELECT scene_id, prim, max(seq) AS last_seq FROM edits GROUP BY 1, 2")
def dirty_prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.dirty_prims(edits(spark, sf_dir))


@query(EDITS_SQL + """, g AS (SELECT client_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY client_id ORDER BY ts, seq) + INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM edits), r AS (SELECT *, sum(new) OVER (PARTITION BY client_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS span FROM g)
SELECT client_id, count(*) AS n, epoch_us(min(ts)) AS since, epoch_us(max(ts)) + 3600000000 AS until FROM r GROUP BY client_id, span""")
def presence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feeds.presence(edits(spark, sf_dir), gap="1 hour").select("client_id", "n", F.unix_micros("since").alias("since"), F.unix_micros("until").alias("until"))


@query(EDITS_SQL + ", v AS (SELECT scene_id, seq, k, prim, row_number() OVER (PARTITION BY scene_id ORDER BY event_id) AS nth, max(seq) FILTER (seq <= 50) OVER (PARTITION BY scene_id) AS head FROM edits) SELECT scene_id, k, prim, coalesce(head, 0) + row_number() OVER (PARTITION BY scene_id ORDER BY seq) AS seq FROM v WHERE seq > 50")
def numbered_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch numbered after each scene's head."""
    log = edits(spark, sf_dir)
    heads = inspect.heads(log.filter("seq <= 50"))
    return feeds.numbered(log.filter("seq > 50").select("scene_id", "seq", "event_id", "k", "prim"), heads, ["event_id"]).select("scene_id", "k", "prim", F.col("seq").cast("long").alias("seq"))
