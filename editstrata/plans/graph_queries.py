"""Queries on graphs, assets and time samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import compose, graph, inspect
from ..sources.edit_log import EDITS_SQL, edits, layers
from .log_queries import ALIVE
from .registry import query

RECURSIVE_EDITS = EDITS_SQL.replace("WITH e0", "WITH RECURSIVE e0", 1)
#: Layers as a graph over orders: a customer's layer holds the layer whose key the order names, some beyond the last customer.
EDGES = "edges AS (SELECT DISTINCT o_custkey AS parent, (o_custkey * 7 + o_orderkey) % (SELECT max(c_custkey) * 11 // 10 FROM customer) AS child FROM orders)"


def layer_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = spark.read.parquet(f"{sf_dir}/customer.parquet").agg(F.max("c_custkey")).first()[0]
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return o.select(F.col("o_custkey").alias("parent"), ((F.col("o_custkey") * 7 + F.col("o_orderkey")) % (last * 11 // 10)).alias("child")).distinct()


@query(f"WITH RECURSIVE {EDGES}, r AS (SELECT CAST(1 AS BIGINT) AS node UNION SELECT e.child FROM r JOIN edges e ON e.parent = r.node) SELECT node FROM r")
def reachable_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.reachable(layer_edges(spark, sf_dir), spark.range(1, 2).withColumnRenamed("id", "node")).select("node")


@query(f"WITH {EDGES}, d AS (SELECT c_custkey AS layer_key FROM customer UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal < 0), r AS (SELECT DISTINCT o_custkey * 2 AS layer_key FROM orders) SELECT DISTINCT child AS layer_key, 'undeclared' AS fault FROM edges WHERE child NOT IN (SELECT layer_key FROM d) UNION ALL SELECT layer_key, 'declared_twice' FROM d GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT layer_key, 'undeclared_root' FROM r WHERE layer_key NOT IN (SELECT layer_key FROM d)")
def layer_graph_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    roots = spark.read.parquet(f"{sf_dir}/orders.parquet").select((F.col("o_custkey") * 2).alias("layer_key"))
    declared = c.select(F.col("c_custkey").alias("layer_key")).unionByName(c.filter("c_acctbal < 0").select(F.col("c_custkey").alias("layer_key")))
    return graph.graph_faults(layer_edges(spark, sf_dir), declared, roots)


#: Shader inputs over parts: a part's input is fed by the part with half its key.
CONNECTIONS = "c AS (SELECT '/M/P' || p_partkey AS prim, 'inputs:x' AS attr, '/M/P' || (p_partkey // 2) AS source_prim, 'inputs:x' AS source_attr FROM part WHERE p_partkey > 7 AND p_size > 5)"


def connections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_partkey > 7 and p_size > 5")
    name = lambda c: F.concat(F.lit("/M/P"), c.cast("string"))
    return p.select(name(F.col("p_partkey")).alias("prim"), F.lit("inputs:x").alias("attr"), name(F.expr("p_partkey div 2")).alias("source_prim"), F.lit("inputs:x").alias("source_attr"))


@query(f"""WITH RECURSIVE {CONNECTIONS}, w AS (SELECT prim, attr, source_prim, source_attr, 1 AS hops FROM c UNION ALL SELECT w.prim, w.attr, c.source_prim, c.source_attr, w.hops + 1 FROM w JOIN c ON c.prim = w.source_prim AND c.attr = w.source_attr)
SELECT prim, attr, arg_max(source_prim, hops) AS source_prim, arg_max(source_attr, hops) AS source_attr, CAST(max(hops) AS BIGINT) AS hops FROM w GROUP BY 1, 2""")
def flattened_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.flattened_inputs(connections(spark, sf_dir))


@query(f"WITH {CONNECTIONS}, r AS (SELECT '/M/P' || p_partkey AS prim, 'inputs:x' AS attr FROM part) SELECT r.prim, r.attr, coalesce(c.source_prim, r.prim) AS source_prim, coalesce(c.source_attr, r.attr) AS source_attr FROM r LEFT JOIN c USING (prim, attr)")
def node_graph_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("/M/P"), F.col("p_partkey").cast("string")).alias("prim"), F.lit("inputs:x").alias("attr"))
    return graph.one_hop(r, connections(spark, sf_dir))


@query(f"WITH {CONNECTIONS} SELECT prim, source_prim FROM c WHERE source_prim NOT IN (SELECT '/M/P' || p_partkey FROM part WHERE p_size > 5)")
def dangling_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    prims = spark.read.parquet(f"{sf_dir}/part.parquet").filter("p_size > 5").select(F.concat(F.lit("/M/P"), F.col("p_partkey").cast("string")).alias("prim"))
    return graph.dangling_sources(connections(spark, sf_dir), prims).select("prim", "source_prim")


ARCS = EDITS_SQL + """, arcs AS (SELECT scene_id, 'set_reference' AS k, layer_key, prim, seq, 'part-' || (event_id % 3000) || '.usd' AS asset_path FROM edits WHERE k = 'set_gprim_attrs'),
lastarc AS (SELECT scene_id, k, layer_key, prim, arg_max(asset_path, seq) AS asset_path FROM arcs GROUP BY 1, 2, 3, 4),
cat AS (SELECT 'part-' || p_partkey || '.usd' AS asset_path, p_brand AS old, CASE WHEN p_size % 4 = 0 THEN p_type ELSE p_brand END AS new FROM part)
"""


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edits(spark, sf_dir).filter("k = 'set_gprim_attrs'").select("scene_id", F.lit("set_reference").alias("k"), "layer_key", "prim", "seq", F.concat(F.lit("part-"), (F.col("event_id") % 3000).cast("string"), F.lit(".usd")).alias("asset_path"))


def catalogue(spark: SparkSession, sf_dir: str, column: str = "p_brand") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string"), F.lit(".usd")).alias("asset_path"), F.expr(column).alias("resolved"))


@query(ARCS + "SELECT scene_id, k, layer_key, prim, l.asset_path, old AS resolved, old IS NULL AS pending FROM lastarc l LEFT JOIN cat USING (asset_path)")
def arc_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.arc_assets(arcs(spark, sf_dir), catalogue(spark, sf_dir))


@query(ARCS + "SELECT scene_id, prim, seq, asset_path, new AS resolved FROM arcs LEFT JOIN cat USING (asset_path) WHERE old IS DISTINCT FROM new")
def refreshed_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = catalogue(spark, sf_dir, "if(p_size % 4 = 0, p_type, p_brand)")
    return graph.refreshed_arcs(arcs(spark, sf_dir), catalogue(spark, sf_dir), new).select("scene_id", "prim", "seq", "asset_path", "resolved")


COMPOSED = ALIVE + """, opinions AS (SELECT e.*, l.rank FROM kept e JOIN layers l USING (layer_key) WHERE field <> '' AND NOT muted AND time IS NOT NULL),
best AS (SELECT scene_id, prim, field, min(rank) AS rank FROM opinions GROUP BY ALL),
samples AS (SELECT scene_id, prim, field, time, arg_max(value, seq) AS value FROM opinions JOIN best USING (scene_id, prim, field, rank) GROUP BY 1, 2, 3, 4),
probes AS (SELECT DISTINCT scene_id, prim, field, probe_at FROM samples, (VALUES (-1.0::DOUBLE), (0.5), (2.0), (9.0)) p(probe_at)),
around AS (SELECT p.*, (SELECT max(time) FROM samples s WHERE s.scene_id = p.scene_id AND s.prim = p.prim AND s.field = p.field AND s.time <= p.probe_at) AS t0,
  (SELECT min(time) FROM samples s WHERE s.scene_id = p.scene_id AND s.prim = p.prim AND s.field = p.field AND s.time >= p.probe_at) AS t1 FROM probes p)
SELECT a.scene_id, a.prim, a.field, a.probe_at AS at, coalesce(x.value, y.value) AS held, CASE WHEN t0 IS NULL THEN y.value WHEN t1 IS NULL OR t0 = a.probe_at THEN x.value ELSE x.value + (a.probe_at - t0) / (t1 - t0) * (y.value - x.value) END AS linear
FROM around a LEFT JOIN samples x ON x.scene_id = a.scene_id AND x.prim = a.prim AND x.field = a.field AND x.time = t0 LEFT JOIN samples y ON y.scene_id = a.scene_id AND y.prim = a.prim AND y.field = a.field AND y.time = t1"""


@query(EDITS_SQL + COMPOSED)
def samples_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = compose.composed(edits(spark, sf_dir), layers(spark)).filter("time is not null")
    probes = samples.select("scene_id", "prim", "field").distinct().withColumn("at", F.explode(F.array(*(F.lit(x) for x in (-1.0, 0.5, 2.0, 9.0)))))
    return graph.samples_at(samples, probes)


@query(EDITS_SQL + ", a AS (SELECT DISTINCT scene_id, '/World/G' || (event_id % 9) AS prototype, prim FROM edits WHERE k = 'set_xform_trs') SELECT scene_id, prototype, count(*) AS instances FROM a WHERE (scene_id, prototype) IN (SELECT scene_id, prim FROM edits) GROUP BY 1, 2")
def instance_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    refs = log.filter("k = 'set_xform_trs'").select("scene_id", "prim", F.lit("").alias("asset_path"), F.concat(F.lit("/World/G"), (F.col("event_id") % 9).cast("string")).alias("prim_path"))
    return graph.instances_of(refs, log.select("scene_id", "prim").distinct())


@query("""WITH i AS (SELECT '/I/' || vec_id AS prim, label, embedding::DOUBLE[] AS e, k FROM embeddings, range(0, 5) t(k))
SELECT prim, k * 10 AS id, CASE k % 2 WHEN 0 THEN '/Proto/A' ELSE '/Proto/B' END AS prototype, e[3 * k + 1] AS x, e[3 * k + 2] AS y, e[3 * k + 3] AS z, CASE WHEN 4 * k + 4 <= 16 THEN e[4 * k + 1] END AS w, CASE WHEN 4 * k + 4 <= 16 THEN e[4 * k + 4] END AS qz, CASE WHEN label % 3 > 0 THEN e[3 * k + 3] END AS sz FROM i WHERE NOT (k = 2 AND label % 2 = 0)""")
def expanded_instancers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instances with position, orientation (given for the first four) and scale (not given for every third)."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").withColumn("prim", F.concat(F.lit("/I/"), F.col("vec_id").cast("string"))).withColumn("e", F.col("embedding").cast("array<double>"))
    many = lambda *x: F.array(*map(F.lit, x))
    rows = e.select("prim", many("/Proto/A", "/Proto/B").alias("prototypes"), many(0, 1, 0, 1, 0).alias("proto_indices"), many(0, 10, 20, 30, 40).cast("array<bigint>").alias("ids"), F.slice("e", 1, 15).alias("positions"), F.slice("e", 1, 16).alias("orientations"), F.when(F.col("label") % 3 > 0, F.slice("e", 1, 15)).alias("scales"))
    out = graph.expanded_instancers(rows, e.filter("label % 2 = 0").select("prim", F.lit(20).cast("long").alias("id")))
    one = lambda c, k: F.get(c, F.lit(k))
    return out.select("prim", "id", "prototype", *(one("position", k).alias(c) for k, c in enumerate("xyz")), one("orientation", 0).alias("w"), one("orientation", 3).alias("qz"), one("scale", 2).alias("sz"))


@query("""WITH p AS (SELECT '/W/L' || (label % 3) || '/V' || vec_id AS prim, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings),
u AS (SELECT unnest(['/W', '/W/' || split_part(prim, '/', 3), prim]) AS prim, x, y, z FROM p)
SELECT prim, min(x) AS x_min, max(x) AS x_max, min(y) AS y_min, max(y) AS y_max, min(z) AS z_min, max(z) AS z_max FROM u GROUP BY 1""")
def subtree_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    prim = F.concat(F.lit("/W/L"), (F.col("label") % 3).cast("string"), F.lit("/V"), F.col("vec_id").cast("string"))
    points = e.select(F.lit("s").alias("scene_id"), prim.alias("prim"), *(F.col("embedding")[k].cast("double").alias(c) for k, c in enumerate("xyz")))
    return inspect.bounds(points).drop("scene_id")


@query(EDITS_SQL + """, r AS (SELECT DISTINCT client_id, 't' || (kk % 3) AS token, event_id AS arrival FROM edits), k AS (SELECT 'c' || user_id AS client_id, 't1' AS known FROM events WHERE user_id % 10 = 0 GROUP BY ALL),
j AS (SELECT r.*, known, row_number() OVER w AS nth, coalesce(known, first_value(token) OVER w) AS own FROM r LEFT JOIN k USING (client_id) WINDOW w AS (PARTITION BY client_id ORDER BY arrival))
SELECT client_id, arrival, CASE WHEN known IS NULL AND nth = 1 THEN 'registered' WHEN token = own THEN 'accepted' ELSE 'rejected' END AS outcome FROM j""")
def token_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = edits(spark, sf_dir)
    attempts = log.select("client_id", F.concat(F.lit("t"), (F.col("kk") % 3).cast("string")).alias("token"), F.col("event_id").alias("arrival"))
    known = spark.read.parquet(f"{sf_dir}/events.parquet").filter("user_id % 10 = 0").select(F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("client_id"), F.lit("t1").alias("token")).distinct()
    return graph.token_outcomes(attempts, known)


@query("SELECT 'L' || (o_orderkey % 50) AS parent_key, o_orderkey AS pos, 'cust-' || o_custkey AS identifier, CASE WHEN c.c_custkey IS NOT NULL THEN 'layer-' || o_custkey ELSE 'shared:' || sha1('cust-' || o_custkey)[1:16] END AS child_key, c.c_custkey IS NOT NULL AS adopted FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) c ON c.c_custkey = o_custkey")
def adopted_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    text = lambda a, c: F.concat(F.lit(a), c.cast("string"))
    rows = o.select(text("L", F.col("o_orderkey") % 50).alias("parent_key"), F.col("o_orderkey").alias("pos"), text("cust-", F.col("o_custkey")).alias("identifier"))
    known = spark.read.parquet(f"{sf_dir}/customer.parquet").filter("c_custkey % 3 = 0").select(text("cust-", F.col("c_custkey")).alias("identifier"), text("layer-", F.col("c_custkey")).alias("layer_key"))
    return graph.adopted_children(rows, known)


@query(RECURSIVE_EDITS + """, p AS (SELECT DISTINCT scene_id, prim FROM edits WHERE prim LIKE '/World/G%/P%')
SELECT scene_id, prim, CASE WHEN starts_with(prim, '/World/G1/') THEN '/Stage/G9/' || split_part(prim, '/', 4) WHEN starts_with(prim, '/World/G2/P2') AND prim = '/World/G2/P2' THEN '/Stage/G2/Q2' ELSE '/Stage/' || split_part(prim, '/', 3) || '/' || split_part(prim, '/', 4) END AS path FROM p""")
def renamed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three renames in turn: a prim, its group's sibling, and the root above both."""
    log = edits(spark, sf_dir)
    moves = spark.createDataFrame([(1, "/World/G2/P2", "/World/G2/Q2"), (2, "/World/G1", "/World/G9"), (3, "/World", "/Stage")], "seq long, old string, new string")
    renames = log.select("scene_id").distinct().crossJoin(F.broadcast(moves))
    return graph.renamed_paths(log.filter("prim like '/World/G%/P%'").select("scene_id", "prim").distinct(), renames)
