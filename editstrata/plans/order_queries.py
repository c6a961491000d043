"""Queries on the order of edits and transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import sequence, validate
from ..sources.edit_log import EDITS_SQL, edits
from .log_queries import wide
from .registry import query


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions of sessions as they arrive: some ids twice, some out of order, some missing."""
    along = Window.partitionBy("client_id", "session_id").orderBy("event_id")
    rows = edits(spark, sf_dir).select("client_id", "session_id", "event_id", "kk", F.row_number().over(along).cast("long").alias("txn_id"))
    rows = rows.filter("event_id % 53 <> 0")
    late = F.when(F.col("event_id") % 17 == 0, 3000).otherwise(0)
    again = F.explode(F.when(F.col("event_id") % 11 == 0, F.array(F.lit(0), F.lit(5000))).otherwise(F.array(F.lit(0))))
    rows = rows.withColumn("_d", again)
    return rows.select("client_id", "session_id", "txn_id", (2 * (F.col("event_id") + F.col("_d") + late) + (F.col("_d") > 0).cast("int")).cast("long").alias("arrival"), (1 + F.col("kk") % 4).cast("long").alias("n_events"))


ARRIVALS = """, numbered AS (SELECT client_id, session_id, event_id, kk, row_number() OVER (PARTITION BY client_id, session_id ORDER BY event_id) AS txn_id FROM edits),
arrivals AS (SELECT client_id, session_id, txn_id, 2 * (event_id + d + CASE WHEN event_id % 17 = 0 THEN 3000 ELSE 0 END) + CASE WHEN d > 0 THEN 1 ELSE 0 END AS arrival, CAST(1 + kk % 4 AS BIGINT) AS n_events
  FROM numbered, (VALUES (0), (5000)) t(d) WHERE event_id % 53 <> 0 AND (d = 0 OR event_id % 11 = 0))
"""
#: Admission as a recursion over arrivals: the state is the committed id.
ADMITTED = ARRIVALS.replace(", numbered", ", RECURSIVE_NUMBERED", 1).replace("RECURSIVE_NUMBERED", "numbered") + """, lined AS (SELECT *, row_number() OVER (PARTITION BY client_id, session_id ORDER BY arrival) AS nth FROM arrivals),
fold AS (SELECT client_id, session_id, nth, txn_id, arrival, n_events, CAST(0 AS BIGINT) AS before, CASE WHEN txn_id = 1 THEN CAST(1 AS BIGINT) ELSE CAST(0 AS BIGINT) END AS through FROM lined WHERE nth = 1
  UNION ALL SELECT l.client_id, l.session_id, l.nth, l.txn_id, l.arrival, l.n_events, f.through, CASE WHEN l.txn_id = f.through + 1 THEN l.txn_id ELSE f.through END
  FROM fold f JOIN lined l ON l.client_id = f.client_id AND l.session_id = f.session_id AND l.nth = f.nth + 1),
admitted AS (SELECT client_id, session_id, txn_id, arrival, n_events, CASE WHEN txn_id <= before THEN 'duplicate' WHEN txn_id = before + 1 THEN 'committed' ELSE 'rejected' END AS outcome, before + 1 AS expected FROM fold)
"""
RECURSIVE_EDITS = EDITS_SQL.replace("WITH e0", "WITH RECURSIVE e0", 1)


@query(RECURSIVE_EDITS + ADMITTED + "SELECT client_id, session_id, txn_id, arrival, outcome, expected FROM admitted")
def admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.admitted(arrivals(spark, sf_dir))


@query(RECURSIVE_EDITS + ADMITTED + "SELECT client_id, session_id, max(txn_id) AS committed_through FROM admitted WHERE outcome = 'committed' GROUP BY 1, 2")
def producer_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.progress(sequence.admitted(arrivals(spark, sf_dir)))


@query(RECURSIVE_EDITS + ADMITTED + """, bad AS (SELECT client_id, session_id, min(arrival) AS b FROM admitted WHERE outcome = 'rejected' GROUP BY 1, 2)
SELECT client_id, session_id, count(*) AS transactions, CAST(sum(n_events) AS BIGINT) AS events, min(txn_id) AS first_txn, max(txn_id) AS last_txn FROM admitted JOIN bad USING (client_id, session_id) WHERE arrival >= b GROUP BY 1, 2""")
def recovery_incidents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir)
    bad = sequence.quarantined(sequence.admitted(rows))
    return sequence.incidents(bad.join(rows.select("client_id", "session_id", "txn_id", "arrival", "n_events"), ["client_id", "session_id", "txn_id", "arrival"]))


@query(EDITS_SQL + ARRIVALS + ", p AS (SELECT client_id, session_id, CAST(3 AS BIGINT) AS c FROM arrivals WHERE client_id < 'c3' GROUP BY 1, 2) SELECT client_id, session_id, txn_id, arrival, CASE WHEN txn_id <= coalesce(c, 0) THEN 'duplicate' WHEN txn_id = coalesce(c, 0) + 1 THEN 'next' ELSE 'gap' END AS outcome, coalesce(c, 0) + 1 AS expected FROM arrivals LEFT JOIN p USING (client_id, session_id)")
def retry_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir)
    done = rows.filter("client_id < 'c3'").select("client_id", "session_id").distinct().withColumn("committed_through", F.lit(3).cast("long"))
    return sequence.retry_outcomes(rows, done).drop("n_events")


@query(EDITS_SQL + ARRIVALS + ", f AS (SELECT client_id || '/' || session_id AS stream, txn_id AS seq, min(arrival) AS arrival FROM arrivals GROUP BY 1, 2) SELECT stream, seq, arrival FROM (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY seq) AS nth FROM f) WHERE seq = nth")
def sequence_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir).select(F.concat_ws("/", "client_id", "session_id").alias("stream"), F.col("txn_id").alias("seq"), "arrival")
    return sequence.contract(rows, key="stream")


@query(EDITS_SQL + ", cut AS (SELECT client_id, max(event_id) AS c FROM edits WHERE kk = 7 GROUP BY 1) SELECT e.client_id, e.event_id AS arrival FROM edits e LEFT JOIN cut USING (client_id) WHERE kk <> 7 AND (c IS NULL OR e.event_id > c)")
def resync_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(spark, sf_dir).select("client_id", F.col("event_id").alias("arrival"), (F.col("kk") == 7).alias("resync"))
    return sequence.latest_epoch(rows, key="client_id").select("client_id", "arrival")


@query(EDITS_SQL + ", m AS (SELECT *, CASE WHEN layer_key = lag(layer_key) OVER (PARTITION BY scene_id ORDER BY seq) THEN 0 ELSE 1 END AS new FROM edits) SELECT scene_id, seq, layer_key, CAST(sum(new) OVER (PARTITION BY scene_id ORDER BY seq) AS BIGINT) AS run FROM m")
def layer_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.runs(edits(spark, sf_dir)).select("scene_id", "seq", "layer_key", F.col("run").cast("long").alias("run"))


SEGMENTS = ", seg AS (SELECT *, 2 * sum(CASE WHEN k = 'delete_prim' THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY seq) - CASE WHEN k = 'delete_prim' THEN 1 ELSE 0 END AS segment FROM edits)\n"


@query(EDITS_SQL + SEGMENTS + "SELECT scene_id, seq, CAST(segment AS BIGINT) AS segment FROM seg")
def barrier_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.segments(edits(spark, sf_dir)).select("scene_id", "seq", F.col("segment").cast("long").alias("segment"))


@query(EDITS_SQL + SEGMENTS + "SELECT scene_id, seq, row_number() OVER (PARTITION BY scene_id ORDER BY segment, CASE k WHEN 'ensure_prim' THEN 0 ELSE 2 END, CASE k WHEN 'ensure_prim' THEN length(prim) - length(replace(prim, '/', '')) ELSE 0 END, seq) AS nth FROM seg")
def dependency_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.dependency_order(edits(spark, sf_dir)).select("scene_id", "seq", F.col("nth").cast("long").alias("nth"))


@query(EDITS_SQL + """, q AS (SELECT scene_id, event_id AS arrival, kk < 5 AS loads FROM edits),
p AS (SELECT *, coalesce(sum(CASE WHEN loads THEN 1 ELSE 0 END) OVER (PARTITION BY scene_id ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS part FROM q),
i AS (SELECT *, (row_number() OVER (PARTITION BY scene_id, part ORDER BY arrival) - 1) // 16 AS inside FROM p)
SELECT scene_id, arrival, dense_rank() OVER (PARTITION BY scene_id ORDER BY part, inside) AS batch FROM i""")
def transaction_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = edits(spark, sf_dir).select("scene_id", F.col("event_id").alias("arrival"), (F.col("kk") < 5).alias("loads"))
    return sequence.batches(queue, 16).select("scene_id", "arrival", F.col("batch").cast("long").alias("batch"))


@query(EDITS_SQL + """, s AS (SELECT client_id, event_id AS arrival, event_id // 4000 AS generation, kk AS revision FROM edits),
b AS (SELECT *, max(revision) OVER (PARTITION BY client_id, generation ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s)
SELECT client_id, arrival, generation, revision FROM b WHERE before IS NULL OR revision > before""")
def fresh_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = edits(spark, sf_dir).select("client_id", F.col("event_id").alias("arrival"), F.expr("event_id div 4000").alias("generation"), F.col("kk").alias("revision"))
    return sequence.fresh_states(states, key="client_id")


@query(RECURSIVE_EDITS + """, r AS (SELECT prim AS parent_key, event_id AS arrival, CAST(kk % 3 + (event_id % 2) AS BIGINT) AS base, row_number() OVER (PARTITION BY prim ORDER BY event_id) AS nth FROM edits WHERE k <> 'delete_prim'),
f AS (SELECT parent_key, arrival, base, nth, CAST(0 AS BIGINT) AS current FROM r WHERE nth = 1
  UNION ALL SELECT r.parent_key, r.arrival, r.base, r.nth, f.current + CASE WHEN f.base = f.current THEN 1 ELSE 0 END FROM f JOIN r ON r.parent_key = f.parent_key AND r.nth = f.nth + 1)
SELECT parent_key, arrival, base, base = current AS accepted, current FROM f""")
def revision_swaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(spark, sf_dir).filter("k <> 'delete_prim'").select(F.col("prim").alias("parent_key"), F.col("event_id").alias("arrival"), (F.col("kk") % 3 + F.col("event_id") % 2).cast("long").alias("base"))
    return sequence.swaps(rows)


@query(EDITS_SQL + ", g AS (SELECT client_id, event_id, event_id // 3000 AS generation FROM edits) SELECT client_id, event_id, generation FROM g QUALIFY generation = max(generation) OVER (PARTITION BY client_id)")
def live_generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = edits(spark, sf_dir).select("client_id", "event_id", F.expr("event_id div 3000").alias("generation"))
    return sequence.live_generation(rows, key="client_id")


@query(EDITS_SQL + """, c AS (SELECT client_id, max(seq) + min(kk) * 50 AS sync_from, CASE WHEN min(kk) % 5 = 0 THEN 'old' ELSE 'now' END AS instance, CAST(min(kk) % 4 AS BIGINT) AS epoch FROM edits GROUP BY 1),
r AS (SELECT *, CASE WHEN instance <> 'now' THEN 'other_instance' WHEN epoch <> 1 THEN 'other_epoch' WHEN sync_from > (SELECT max(seq) FROM edits) + 1 THEN 'ahead_of_head' ELSE 'resumed' END AS reason FROM c)
SELECT client_id, reason, CASE reason WHEN 'resumed' THEN sync_from ELSE 1 END AS first FROM r""")
def replay_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = edits(spark, sf_dir).groupBy("client_id").agg((F.max("seq") + F.min("kk") * 50).alias("sync_from"), F.min("kk").alias("m"))
    c = c.select("client_id", "sync_from", F.when(F.col("m") % 5 == 0, "old").otherwise("now").alias("instance"), (F.col("m") % 4).cast("long").alias("epoch"))
    c = c.crossJoin(F.broadcast(edits(spark, sf_dir).agg(F.max("seq").alias("head"))))  # one row
    return sequence.replay_plans(c, instance="now", epoch=1, head=F.col("head")).select("client_id", "reason", "first")


@query(EDITS_SQL + ARRIVALS + ", a AS (SELECT client_id, session_id, max(txn_id) AS ack FROM arrivals WHERE arrival % 5 = 0 AND txn_id < 6 GROUP BY 1, 2) SELECT client_id, session_id, txn_id, arrival, n_events, coalesce(txn_id <= ack, false) AS closed FROM arrivals LEFT JOIN a USING (client_id, session_id)")
def acknowledged(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = arrivals(spark, sf_dir)
    return sequence.acknowledged(rows, rows.filter("arrival % 5 = 0 and txn_id < 6").select("client_id", "session_id", "txn_id"))


@query(EDITS_SQL + "SELECT session_id, prim, min(seq) AS seq FROM edits GROUP BY 1, 2")
def first_encounters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.scans import first_encounters as first

    return first(edits(spark, sf_dir), "session_id", "prim")


def suspicious(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived log in the whole schema of edits, with some faulty rows."""
    log = wide(spark, sf_dir)
    text, texts = F.lit(None).cast("string"), F.lit(None).cast("array<string>")
    return log.withColumns({
        "k": F.when(F.col("kk") == 3, "no_such_kind").otherwise(F.col("k")),
        "prim": F.when(F.col("kk") == 11, F.concat("prim", F.lit("{v=a}"))).otherwise(F.col("prim")),
        "time": F.when((F.col("kk") == 13) & F.col("time").isNotNull(), F.lit(float("nan"))).otherwise(F.col("time")),
        "vals": F.when(F.col("kk") == 17, F.create_map(F.lit("1x"), "value")).otherwise(F.col("vals")),
        "flag": F.when(F.col("kk") != 19, F.col("value") > 10),
        "type_name": F.when(F.col("kk") != 23, F.col("type_name")),
        "txn_id": F.expr("event_id div 8"),
        "new_name": text, "disconnections": texts,
        "arcs": F.lit(None).cast("array<struct<asset_path: string, prim_path: string, list_position: string, layer_offset: double, layer_scale: double>>"),
        "connections": F.lit(None).cast("map<string, struct<prim: string, attr: string>>"), "times": F.lit(None).cast("array<double>"),
    })


VIOLATIONS = """, v AS (SELECT scene_id, seq, client_id, session_id, event_id // 8 AS txn_id, CASE WHEN kk = 3 THEN 'unknown_kind' WHEN kk = 11 THEN 'bad_prim' WHEN kk = 13 AND time IS NOT NULL THEN 'bad_time'
  WHEN kk = 23 AND k = 'ensure_prim' THEN 'bad_schema' WHEN kk = 17 AND k = 'set_xform_trs' THEN 'bad_transform' WHEN kk = 19 AND k = 'set_visibility' THEN 'missing_flag'
  WHEN kk = 17 AND k = 'set_gprim_attrs' THEN 'bad_attributes' END AS rule FROM edits)
"""


@query(EDITS_SQL + VIOLATIONS + "SELECT * FROM v WHERE rule IS NOT NULL")
def violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.violations(suspicious(spark, sf_dir))


@query(EDITS_SQL + VIOLATIONS + "SELECT client_id, session_id, txn_id, min(seq) AS seq, arg_min(rule, seq) AS rule FROM v WHERE rule IS NOT NULL GROUP BY 1, 2, 3")
def failed_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validate.failed_transactions(suspicious(spark, sf_dir))
