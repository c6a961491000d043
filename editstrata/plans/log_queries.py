"""Scans, composition, reductions and metrics over the derived log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, scalars
from ..operators import compose, inspect, reduce, scans
from ..sources.edit_log import EDITS_SQL, edits, layers, parsed_stacks
from .registry import query



def wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log in the columns that compaction reads: each value a field of vals."""
    vals = F.when(F.col("field") != "", F.create_map("field", "value")).otherwise(F.create_map().cast("map<string,double>"))
    log = edits(spark, sf_dir).withColumn("vals", vals).withColumn("fields", F.map_keys("vals"))
    none = F.lit(None).cast("string")
    return log.withColumns({"spec_path": F.lit(""), "spec_kind": none, "material_purpose": F.lit(""), "type_name": F.when(F.col("k") == "ensure_prim", F.concat(F.lit("T"), (F.col("kk") % 7).cast("string"))), "api_schemas": F.when(F.col("k") == "ensure_prim", F.array(F.concat(F.lit("S"), (F.col("kk") % 3).cast("string")))).otherwise(F.array().cast("array<string>")), "removed": F.lit(False)})


ALIVE = """, kept AS (SELECT * FROM edits e WHERE NOT EXISTS (SELECT 1 FROM edits x WHERE x.k = 'delete_prim' AND x.scene_id = e.scene_id AND x.layer_key = e.layer_key
  AND x.seq > e.seq AND (x.prim = e.prim OR starts_with(e.prim, x.prim || '/'))))
"""
COMPOSED = ALIVE + """, opinions AS (SELECT e.*, l.rank FROM kept e JOIN layers l USING (layer_key) WHERE field <> '' AND NOT muted),
best AS (SELECT scene_id, prim, field, time IS NULL AS untimed, min(rank) AS rank FROM opinions GROUP BY ALL),
composed AS (SELECT o.scene_id, o.prim, o.field, o.time, arg_max(o.value, o.seq) AS value, any_value(o.layer_key) AS layer_key, max(o.seq) AS seq
  FROM opinions o JOIN best b ON o.scene_id = b.scene_id AND o.prim = b.prim AND o.field = b.field AND (o.time IS NULL) = b.untimed AND o.rank = b.rank GROUP BY 1, 2, 3, 4)
"""
LIVE = """, made AS (SELECT scene_id, prim, max(seq) AS seq FROM edits WHERE k = 'ensure_prim' GROUP BY ALL),
live AS (SELECT * FROM made m WHERE NOT EXISTS (SELECT 1 FROM edits x WHERE x.k = 'delete_prim' AND x.scene_id = m.scene_id AND x.seq > m.seq AND (x.prim = m.prim OR starts_with(m.prim, x.prim || '/'))))
"""


@query(EDITS_SQL + COMPOSED + "SELECT scene_id, prim, field, time, value, layer_key FROM composed")
def composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.composed(edits(spark, sf_dir), layers(spark)).drop("seq")


@query(EDITS_SQL + ALIVE + "SELECT scene_id, layer_key, seq, k, prim FROM kept")
def subtree_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.survivors(edits(spark, sf_dir)).select("scene_id", "layer_key", "seq", "k", "prim")


@query(EDITS_SQL + ALIVE + """, heads AS (SELECT scene_id, layer_key, k, prim, time, CASE WHEN k = 'ensure_prim' THEN min(seq) ELSE max(seq) END AS seq, arg_max(client_id, seq) AS client_id,
  arg_max('T' || (kk % 7), seq) FILTER (k = 'ensure_prim') AS type_name, string_agg(DISTINCT 'S' || (kk % 3), ',' ORDER BY 'S' || (kk % 3)) FILTER (k = 'ensure_prim') AS api_schemas FROM kept GROUP BY 1, 2, 3, 4, 5),
vals AS (SELECT scene_id, layer_key, k, prim, time, field, arg_max(value, seq) AS value FROM kept WHERE field <> '' GROUP BY ALL)
SELECT h.scene_id, h.layer_key, h.k, h.prim, h.time, h.seq, h.client_id, h.type_name, coalesce(h.api_schemas, '') AS api_schemas, v.field, v.value FROM heads h LEFT JOIN vals v
  ON h.scene_id = v.scene_id AND h.layer_key = v.layer_key AND h.k = v.k AND h.prim = v.prim AND h.time IS NOT DISTINCT FROM v.time""")
def compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reduce.compacted(wide(spark, sf_dir))
    return rows.select("scene_id", "layer_key", "k", "prim", "time", "seq", "client_id", "type_name", F.array_join("api_schemas", ",").alias("api_schemas"), F.explode_outer("vals").alias("field", "value"))


@query(EDITS_SQL + """, cut AS (SELECT *, sum(CASE WHEN k <> 'set_xform_trs' THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY seq) AS segment FROM edits),
rows AS (SELECT * FROM cut WHERE k = 'set_xform_trs'),
firsts AS (SELECT scene_id, segment, prim, time, min(seq) AS seq FROM rows GROUP BY ALL)
SELECT r.scene_id, CAST(r.segment AS BIGINT) AS segment, r.prim, r.time, r.field, arg_max(r.value, r.seq) AS value, any_value(f.seq) AS seq FROM rows r JOIN firsts f
  ON r.scene_id = f.scene_id AND r.segment = f.segment AND r.prim = f.prim AND r.time IS NOT DISTINCT FROM f.time GROUP BY 1, 2, 3, 4, 5""")
def coalesced_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.coalesced_transforms(edits(spark, sf_dir))


@query(EDITS_SQL + """, rows AS (SELECT * FROM edits WHERE starts_with(prim, '/World/G1/') OR (k = 'delete_prim' AND prim IN ('/World/G1', '/World'))),
kept AS (SELECT * FROM rows e WHERE NOT EXISTS (SELECT 1 FROM rows x WHERE x.k = 'delete_prim' AND x.scene_id = e.scene_id AND x.layer_key = e.layer_key AND x.seq > e.seq AND (x.prim = e.prim OR starts_with(e.prim, x.prim || '/')))
  AND k <> 'set_gprim_attrs'),
heads AS (SELECT scene_id, layer_key, k, prim, time, CASE WHEN k = 'ensure_prim' THEN min(seq) ELSE max(seq) END AS seq FROM kept GROUP BY 1, 2, 3, 4, 5),
marked AS (SELECT *, 2 * sum(CASE WHEN k = 'delete_prim' THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY seq) - CASE WHEN k = 'delete_prim' THEN 1 ELSE 0 END AS segment FROM heads)
SELECT scene_id, layer_key, k, prim, time, seq, row_number() OVER (PARTITION BY scene_id ORDER BY segment, CASE WHEN k = 'ensure_prim' THEN 0 ELSE 2 END, prim, seq) AS nth FROM marked WHERE starts_with(prim, '/World/G1/')""")
def child_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.child_replay(wide(spark, sf_dir), "/World/G1").select("scene_id", "layer_key", "k", "prim", "time", "seq", F.col("nth").cast("long").alias("nth"))


@query(EDITS_SQL + "SELECT scene_id, layer_key, prim, arg_max('T' || (kk % 7), seq) AS type_name, string_agg(DISTINCT 'S' || (kk % 3), ',' ORDER BY 'S' || (kk % 3)) AS api_schemas, min(seq) AS seq FROM edits WHERE k = 'ensure_prim' GROUP BY 1, 2, 3")
def united_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.united_schemas(wide(spark, sf_dir)).withColumn("api_schemas", F.array_join("api_schemas", ","))


@query(EDITS_SQL + "SELECT scene_id, seq AS old_seq, row_number() OVER (PARTITION BY scene_id ORDER BY seq) AS seq, k FROM edits")
def renumbered_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reduce.renumbered(edits(spark, sf_dir).select("scene_id", "seq", "k")).select("scene_id", "old_seq", F.col("seq").cast("long").alias("seq"), "k")


@query(EDITS_SQL + "SELECT seq, scene_id, k, prim FROM edits WHERE seq BETWEEN 101 AND 900")
def sequence_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.sequence_range(edits(spark, sf_dir), 101, 900).select("seq", "scene_id", "k", "prim")


@query(EDITS_SQL + "SELECT seq, scene_id, k, prim FROM edits WHERE seq >= 5000")
def sequence_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.sequence_range(edits(spark, sf_dir), 5000).select("seq", "scene_id", "k", "prim")


@query(EDITS_SQL + ", hits AS (SELECT * FROM edits WHERE k = 'set_xform_trs' AND prim ILIKE '%g1/p%') SELECT seq, prim, (SELECT count(*) FROM hits) AS total FROM hits ORDER BY seq DESC LIMIT 50 OFFSET 20")
def log_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.page(scans.searched(edits(spark, sf_dir).select("seq", "k", "prim"), k="set_xform_trs", prim_contains="g1/p"), offset=20, limit=50).select("seq", "prim", "total")


@query(EDITS_SQL + "SELECT seq, k, prim FROM edits WHERE starts_with(prim, '/World/G2/') AND k IN ('ensure_prim', 'delete_prim')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.under_prefix(edits(spark, sf_dir), "/World/G2/", ["ensure_prim", "delete_prim"]).select("seq", "k", "prim")


@query(EDITS_SQL + "SELECT seq, k, CASE k WHEN 'ensure_prim' THEN 0 ELSE 2 END AS tier FROM edits")
def apply_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.with_tier(edits(spark, sf_dir)).select("seq", "k", "tier")


@query(EDITS_SQL + "SELECT e.seq, e.layer_key, l.rank, l.muted FROM edits e JOIN layers l USING (layer_key)")
def layer_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.routed(scans.routing_layer(edits(spark, sf_dir)), layers(spark)).select("seq", "layer_key", "rank", "muted")


@query(EDITS_SQL + "SELECT seq, layer_key FROM edits WHERE layer_key NOT IN ('default', 'department:fx')")
def unrouted_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.unrouted(edits(spark, sf_dir), layers(spark).filter("layer_key in ('default', 'department:fx')")).select("seq", "layer_key")


@query(EDITS_SQL + ALIVE + "SELECT scene_id, prim, field, time, arg_max(value, seq) AS value FROM kept WHERE layer_key = 'department:lighting' AND field <> '' GROUP BY 1, 2, 3, 4")
def layer_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.layer_opinions(edits(spark, sf_dir), "department:lighting")


@query(EDITS_SQL + ALIVE + "SELECT scene_id, prim, field, time, arg_max(value, seq + CASE WHEN layer_key = 'department:fx' THEN 1000000000000 ELSE 0 END) AS value, 'default' AS layer_key FROM kept WHERE layer_key IN ('department:fx', 'default') AND field <> '' GROUP BY 1, 2, 3, 4")
def merged_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.merged_into(edits(spark, sf_dir), "department:fx", "default")


@query(EDITS_SQL + "SELECT layer_key, k, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM edits GROUP BY ROLLUP (layer_key, k)")
def wire_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.wire_metrics(edits(spark, sf_dir))


@query(EDITS_SQL + ", b AS (SELECT k, count(*) AS n, CAST(sum(n_bytes) AS BIGINT) AS bytes FROM edits GROUP BY k) SELECT k, n, bytes, bytes // greatest(n, 1) AS mean_bytes, round(100.0 * bytes / sum(bytes) OVER (), 4) AS share, row_number() OVER (ORDER BY bytes DESC, k) AS rank FROM b")
def wire_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.wire_shares(edits(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query(EDITS_SQL + "SELECT scene_id, max(seq) AS max_seq, count(*) AS n FROM edits GROUP BY 1")
def log_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.heads(edits(spark, sf_dir))


@query(EDITS_SQL + LIVE + "SELECT scene_id, prim, seq FROM live")
def live_prims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.live_prims(edits(spark, sf_dir))


@query(EDITS_SQL + LIVE + "SELECT scene_id, count(*) AS n_prims, max(length(prim) - length(replace(prim, '/', ''))) AS max_depth FROM live GROUP BY 1")
def scene_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.scene_summary(inspect.live_prims(edits(spark, sf_dir))).withColumn("max_depth", F.col("max_depth").cast("long"))


@query(EDITS_SQL + "SELECT scene_id, k, count(*) AS n FROM edits GROUP BY 1, 2")
def kind_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.kind_histogram(edits(spark, sf_dir))


@query(EDITS_SQL + ", l AS (SELECT scene_id, prim, max(seq) AS last_seq FROM edits GROUP BY 1, 2 HAVING max(seq) > 2000) SELECT *, (SELECT count(*) FROM l) AS total FROM l ORDER BY last_seq, scene_id, prim LIMIT 200")
def changes_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.changes_since(edits(spark, sf_dir), 2000, 200)


@query(EDITS_SQL + LIVE + "SELECT scene_id, prim, (SELECT count(*) FROM live) AS total, CAST(CASE WHEN (SELECT count(*) FROM live) > 110 THEN 110 END AS INT) AS next_offset FROM live ORDER BY scene_id, string_split(prim, '/') LIMIT 100 OFFSET 10")
def prim_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.path_page(inspect.live_prims(edits(spark, sf_dir)).select("scene_id", "prim"), offset=10, limit=100)


@query(EDITS_SQL + "SELECT client_id, count(*) AS n, round(epoch(TIMESTAMP '2030-01-01') - epoch_us(max(ts)) / 1e6, 3) AS idle_s FROM edits GROUP BY 1")
def client_roster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.clients(edits(spark, sf_dir), F.timestamp_micros(F.lit(1893456000000000)))


@query(EDITS_SQL + "SELECT scene_id, client_id, arg_max(layer_key, seq) AS layer_key FROM edits GROUP BY 1, 2")
def last_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.last_assignment(edits(spark, sf_dir))


@query(EDITS_SQL + """, c AS (SELECT session_id, value, row_number() OVER (PARTITION BY session_id ORDER BY value) - 1 AS r, count(*) OVER (PARTITION BY session_id) AS n FROM edits)
SELECT session_id, any_value(n) AS n, max(value) FILTER (r = n // 2) AS median, max(value) FILTER (r = CAST(floor((n - 1) * 0.95) AS BIGINT)) AS p95, max(value) AS max FROM c GROUP BY 1""")
def session_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.nearest_ranks(edits(spark, sf_dir), "session_id", "value")


STACKS = """WITH t AS (SELECT trim(replace(replace(text, chr(10), ' '), ';', ' '), ' ') AS words, n_chars AS samples FROM documents WHERE text IS NOT NULL),
s AS (SELECT string_split(regexp_replace(words, ' +', ';', 'g'), ';') AS frames, samples FROM t WHERE words <> ''),
inc AS (SELECT frame, sum(samples) AS inclusive FROM (SELECT unnest(list_distinct(frames)) AS frame, samples FROM s) GROUP BY 1),
own AS (SELECT frames[-1] AS frame, sum(samples) AS own FROM s GROUP BY 1)
SELECT frame, CAST(inclusive AS BIGINT) AS inclusive, CAST(coalesce(own, 0) AS BIGINT) AS self FROM inc LEFT JOIN own USING (frame)"""


@query(STACKS)
def profile_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' words as stack frames, their characters as samples."""
    lines = spark.read.parquet(f"{sf_dir}/documents.parquet").filter("text is not null").select(F.concat(F.regexp_replace(F.trim(F.translate("text", "\n;", "  ")), " +", ";"), F.lit(" "), F.col("n_chars")).alias("value"))
    return inspect.stack_totals(parsed_stacks(lines))


@query(STACKS + " ORDER BY inclusive DESC, frame LIMIT 30")
def top_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.top_frames(profile_totals(spark, sf_dir), 30)


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN text[1:117] || '…' ELSE coalesce(text, '') END AS short, CASE WHEN n_chars < 1024 THEN n_chars || ' B' WHEN n_chars < 1048576 THEN format('{:.1f} KB', n_chars / 1024.0) ELSE format('{:.1f} MB', n_chars / 1048576.0) END AS bytes, source || '-' || sha1(text)[1:12] AS identity FROM documents")
def value_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return d.select("doc_id", scalars.abbreviated(F.col("text")).alias("short"), scalars.human_bytes(F.col("n_chars")).alias("bytes"), scalars.scene_identity(F.col("source"), F.col("text")).alias("identity"))


@query(EDITS_SQL + """SELECT DISTINCT prim, CASE WHEN prim LIKE '/%/%/%' THEN prim[1:length(prim) - strpos(reverse(prim), '/')] ELSE '/World' END AS parent, length(prim) - length(replace(prim, '/', '')) AS depth, split_part(prim, '/', -1) AS leaf,
  CASE WHEN prim = '/World/G1' OR starts_with(prim, '/World/G1/') THEN '/World/Moved' || prim[10:] ELSE prim END AS moved FROM edits""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("prim")
    return edits(spark, sf_dir).select("prim").distinct().select("prim", paths.parent(p).alias("parent"), paths.depth(p).cast("long").alias("depth"), paths.leaf_name(p).alias("leaf"), paths.renamed(p, F.lit("/World/G1"), F.lit("Moved")).alias("moved"))


@query(EDITS_SQL + LIVE + "SELECT (SELECT count(*) FROM edits) AS n_edits, (SELECT count(DISTINCT client_id) FROM edits) AS n_clients, (SELECT count(*) FROM live) AS n_prims, (SELECT count(DISTINCT layer_key) FROM edits) AS n_layers")
def status_card(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    return inspect.status(log, inspect.live_prims(log))


@query(EDITS_SQL + ", v AS (SELECT *, lag(value) OVER (PARTITION BY scene_id, layer_key, prim, field, time ORDER BY seq) AS before FROM (SELECT scene_id, seq, layer_key, prim, field, time, floor(value / 10) AS value FROM edits WHERE field <> '')) SELECT scene_id, seq FROM v WHERE value = before")
def redundant_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that state what their layer holds already, values in steps of ten."""
    log = edits(spark, sf_dir).withColumn("value", F.floor(F.col("value") / 10))
    return reduce.redundant(log).select("scene_id", "seq")


@query(EDITS_SQL + ", f AS (SELECT session_id, layer_key, min(seq) AS first, count(*) AS n FROM edits GROUP BY 1, 2) SELECT session_id, CAST(sum(n) AS BIGINT) AS events, string_agg(layer_key, ',' ORDER BY first) AS layer_keys FROM f GROUP BY 1")
def session_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.layers_in_order(edits(spark, sf_dir), "session_id")


@query(EDITS_SQL + ", c AS (SELECT layer_key, count(DISTINCT client_id) AS n_clients, count(*) FILTER (field <> '') AS n_values FROM edits GROUP BY 1) SELECT l.layer_key, l.rank, l.muted, coalesce(n_clients, 0) AS n_clients, coalesce(n_values, 0) AS n_values FROM layers l LEFT JOIN c USING (layer_key) WHERE n_clients > 0 OR n_values > 0")
def layer_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inspect.stack_rows(layers(spark), edits(spark, sf_dir))


@query(EDITS_SQL + COMPOSED + ", own AS (SELECT DISTINCT scene_id, prim, field FROM kept WHERE layer_key = 'department:animation' AND field <> '') SELECT c.scene_id, c.prim, c.field, c.time, c.value FROM composed c JOIN own USING (scene_id, prim, field)")
def owned_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Composed values of the fields that one layer has opinions on."""
    log = edits(spark, sf_dir)
    return compose.owned(compose.composed(log, layers(spark)), log, "department:animation").select("scene_id", "prim", "field", "time", "value")
