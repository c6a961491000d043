"""Queries over edits whose values are numbers, texts, truth values, vectors, arrays and objects; the log is read from JSON lines that events become."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import typed
from ..operators import compose, diff, reduce, validate
from ..sources.edit_log import dumped, layers, parsed_edits
from ..sources.shared import written
from .registry import query

_VALUE = """CASE event_id % 9 WHEN 0 THEN CAST(kk % 4 AS STRING) WHEN 1 THEN concat(kk, '.5') WHEN 2 THEN concat(kk % 4, '.0') WHEN 3 THEN concat('"s', kk % 4, '"') WHEN 4 THEN concat('[', kk, ',', kk + 1, ',2.5]')
  WHEN 5 THEN concat('[[', kk, ',0.5],[1,2]]') WHEN 6 THEN CASE WHEN kk % 2 = 0 THEN 'true' ELSE 'false' END WHEN 7 THEN concat('{"b":', kk % 3, ',"a":[1]}') ELSE '[]' END"""
_PAYLOAD = f"""CASE event_type WHEN 'signup' THEN concat('"k":"ensure_prim","typeName":"T', kk % 7, '"')
  WHEN 'click' THEN CASE WHEN kk % 8 = 0 THEN concat('"k":"set_point_instancer","fields":["positions","ids"],"positions":[[', kk, ',1,2', CASE WHEN event_id % 4 = 0 THEN '' ELSE '.5' END, '],[0,0,', CASE WHEN event_id % 6 = 0 THEN '"x"' ELSE '1' END, ']],"ids":[1,', CASE WHEN event_id % 5 = 0 THEN '1.5' ELSE '2' END, ']')
    ELSE concat('"k":"set_xform_trs","fields":["t","r"],"t":[', kk, ',0.5', CASE WHEN event_id % 10 = 0 THEN '' ELSE ',1' END, '],"r":[', kk % 3, ',0,0,0]') END
  WHEN 'purchase' THEN concat('"k":"set_gprim_attrs","attrs":{{"a', event_id % 3, '":', {_VALUE}, '}}')
  WHEN 'view' THEN CASE WHEN kk % 8 = 0 THEN concat('"k":"set_stage_metadata","metersPerUnit":', CASE WHEN event_id % 3 = 0 THEN '"1"' ELSE '0.01' END, ',"upAxis":"Y"') ELSE concat('"k":"set_connectable_input","info_id":"I","inputs":{{"i":', {_VALUE}, '}},"input_types":{{"i":"token"}}') END
  ELSE '"k":"delete_prim"' END"""
_LINE = f"""concat('{{"scene_id":"scene-', user_id % 5, '","seq":', event_id + 1, ',"client_id":"c', user_id, '","session_id":"s","txn_id":', event_id, ',"layer_key":"', CASE user_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'department:animation' WHEN 2 THEN 'department:lighting' ELSE 'department:fx' END,
  '","prim":"', CASE WHEN event_type = 'error' AND kk < 10 THEN concat('/World/G', kk % 5) ELSE concat('/World/G', kk % 5, '/P', kk) END, '",', {_PAYLOAD}, CASE WHEN event_id % 11 = 0 THEN concat(',"zoom":', kk) WHEN event_id % 13 = 0 THEN ',"fields":7' ELSE '' END, '}}')"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One JSON object an event, in the field names of edits on the wire."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kk", F.get_json_object("props", "$.k").cast("int"))
    return e.select(F.expr(_LINE).alias("value"))


def typed_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsed_edits(lines(spark, sf_dir))


def values_of(log: DataFrame) -> DataFrame:
    """One row a value: scene_id, layer_key, seq, k, prim, time, field and value."""
    return log.select("scene_id", "layer_key", "seq", "k", "prim", "time", F.explode_outer("vals").alias("field", "value")).fillna("", ["field"])


_TEXT = "CASE WHEN json_type(v) IN ('DOUBLE', 'BIGINT', 'UBIGINT') THEN CAST(CAST(v AS DOUBLE) AS VARCHAR) WHEN json_type(v) = 'ARRAY' AND json_type(v, '$[0]') = 'ARRAY' AND NOT contains(CAST(v AS VARCHAR), '\"') THEN CAST(to_json(CAST(v AS DOUBLE[][])) AS VARCHAR) WHEN json_type(v) = 'ARRAY' AND NOT contains(CAST(v AS VARCHAR), '\"') THEN CAST(to_json(CAST(v AS DOUBLE[])) AS VARCHAR) WHEN json_type(v) = 'OBJECT' THEN '{\"a\":[1],\"b\":' || CAST(v->'b' AS VARCHAR) || '}' ELSE CAST(v AS VARCHAR) END"
#: The lines and their values for DuckDB; queries' SQL twins begin with it.
TYPED_SQL = f"""WITH e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS kk FROM events), l AS (SELECT event_id, {_LINE.replace("AS STRING", "AS VARCHAR")} AS line FROM e0),
log AS (SELECT event_id + 1 AS seq, line->>'scene_id' AS scene_id, line->>'layer_key' AS layer_key, line->>'k' AS k, line->>'prim' AS prim, line FROM l),
found AS (SELECT seq, scene_id, layer_key, k, prim, CASE WHEN json_type(line, '$.attrs') = 'OBJECT' THEN line->'attrs' WHEN json_type(line, '$.inputs') = 'OBJECT' THEN line->'inputs' ELSE line END AS o FROM log),
entries AS (SELECT seq, scene_id, layer_key, k, prim, o, unnest(json_keys(o)) AS field FROM found),
vals AS (SELECT seq, scene_id, layer_key, k, prim, field, {_TEXT.replace("(v", "(json_extract(o, '$.' || field)").replace(" v ", " json_extract(o, '$.' || field) ").replace("v->", "json_extract(o, '$.' || field)->")} AS text,
  json_type(json_extract(o, '$.' || field)) AS kind FROM entries WHERE k IN ('set_gprim_attrs', 'set_connectable_input') OR field IN ('t', 'r', 'positions', 'ids', 'metersPerUnit')),
layers(layer_key, rank, muted) AS (VALUES ('department:animation', 1, false), ('department:lighting', 2, false), ('department:fx', 3, true), ('default', 4, false))
"""


@query(TYPED_SQL + "SELECT l.seq, l.k, l.line->>'typeName' AS type_name, l.line->>'upAxis' AS up_axis, v.field, v.text, CASE WHEN event_id % 11 = 0 THEN '{\"zoom\":' || (l.line->>'zoom') || '}' WHEN event_id % 13 = 0 THEN l.line END AS rescued FROM (SELECT *, seq - 1 AS event_id FROM log) l LEFT JOIN vals v USING (seq) WHERE NOT (l.k IN ('set_xform_trs', 'set_point_instancer') AND event_id % 13 = 0)")
def typed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is read from the lines, one row a value, with what no column takes. Lines that repeat a key are left to the test of the reader."""
    log = typed_log(spark, sf_dir).filter("not (coalesce(k in ('set_xform_trs', 'set_point_instancer'), true) and (seq - 1) % 13 = 0)")
    return log.select("seq", "k", "type_name", "up_axis", F.explode_outer("vals").alias("field", "value"), "rescued").withColumn("text", typed.canonical(F.col("value"))).drop("value")


_KEPT = ", kept AS (SELECT * FROM log e WHERE NOT EXISTS (SELECT 1 FROM log x WHERE x.k = 'delete_prim' AND x.scene_id = e.scene_id AND x.layer_key = e.layer_key AND x.seq > e.seq AND (x.prim = e.prim OR starts_with(e.prim, x.prim || '/'))))"


@query(TYPED_SQL + _KEPT + ", heads AS (SELECT scene_id, layer_key, k, prim, CASE WHEN k = 'ensure_prim' THEN min(seq) ELSE max(seq) END AS seq FROM kept WHERE (seq - 1) % 13 <> 0 AND k <> 'set_stage_metadata' GROUP BY 1, 2, 3, 4), v AS (SELECT scene_id, layer_key, k, prim, field, arg_max(text, seq) AS text FROM vals JOIN (SELECT seq FROM kept) USING (seq) WHERE (seq - 1) % 13 <> 0 GROUP BY ALL) SELECT h.*, v.field, v.text FROM heads h LEFT JOIN v USING (scene_id, layer_key, k, prim)")
def typed_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compaction of typed values: of a name the last value stays, whatever its type."""
    log = typed_log(spark, sf_dir)
    dead = log.filter("k = 'delete_prim'").unionByName(log.filter("coalesce(k, '') <> 'delete_prim' and (seq - 1) % 13 <> 0"))
    rows = reduce.compacted(written(dead, "typed")).filter("k <> 'set_stage_metadata' and (k <> 'delete_prim' or (seq - 1) % 13 <> 0)")
    return rows.select("scene_id", "layer_key", "k", "prim", "seq", F.explode_outer("vals").alias("field", "value")).withColumn("text", typed.canonical(F.col("value"))).drop("value")


def _state(name: str, where: str) -> str:
    kill = f"SELECT 1 FROM log x WHERE x.k = 'delete_prim' AND x.{where} AND x.scene_id = e.scene_id AND x.layer_key = e.layer_key AND x.seq > e.seq AND (x.prim = e.prim OR starts_with(e.prim, x.prim || '/'))"
    return f""", o{name} AS (SELECT e.*, rank FROM vals e JOIN layers USING (layer_key) WHERE NOT muted AND (seq - 1) % 13 <> 0 AND {where} AND NOT EXISTS ({kill})), b{name} AS (SELECT scene_id, prim, field, min(rank) AS rank FROM o{name} GROUP BY ALL),
{name} AS (SELECT scene_id, prim, field, arg_max(text, seq) AS text FROM o{name} JOIN b{name} USING (scene_id, prim, field, rank) GROUP BY ALL)"""


@query(TYPED_SQL + _state("before", "seq <= (SELECT max(seq) // 2 FROM log)") + _state("after", "seq > 0") + " SELECT scene_id, prim, field, CASE WHEN b.text IS NULL THEN 'create' WHEN a.text IS NULL THEN 'remove' ELSE 'change' END AS change, b.text AS old_text, a.text AS new_text FROM before b FULL JOIN after a USING (scene_id, prim, field) WHERE a.text IS DISTINCT FROM b.text")
def typed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes between two composed states; 1 and 1.0 are no change, a text and a number are."""
    log = typed_log(spark, sf_dir)
    rows = values_of(log.filter("k = 'delete_prim' or (seq - 1) % 13 <> 0"))
    middle = rows.agg(F.expr("max(seq) div 2")).first()[0]
    changes = diff.value_changes(compose.composed_twice(rows, layers(spark), middle))
    return changes.select("scene_id", "prim", "field", "change", *(typed.canonical(F.col(f"{x}_value")).alias(f"{x}_text") for x in ("old", "new")))


@query(TYPED_SQL + ", f AS (SELECT seq, CASE WHEN k = 'set_xform_trs' AND ((seq - 1) % 10 = 0 OR json_extract_string(line, '$.r[0]') = '0') THEN 'bad_transform' WHEN k = 'set_stage_metadata' AND json_type(line, '$.metersPerUnit') = 'VARCHAR' THEN 'bad_metadata' WHEN k = 'set_point_instancer' AND ((seq - 1) % 6 = 0 OR (seq - 1) % 5 = 0) THEN 'bad_instancer' END AS rule FROM log WHERE (seq - 1) % 13 <> 0) SELECT * FROM f WHERE rule IS NOT NULL")
def typed_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of another length or without a direction, texts in place of numbers, arrays of another width or type."""
    return validate.violations(typed_log(spark, sf_dir).filter("(seq - 1) % 13 <> 0")).select("seq", "rule")


@query(TYPED_SQL + "SELECT seq, field, text FROM vals WHERE (seq - 1) % 13 <> 0")
def typed_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values read back from a dump's JSON."""
    rows = dumped(typed_log(spark, sf_dir).filter("(seq - 1) % 13 <> 0"))
    back = rows.select("seq", F.explode(F.try_variant_get(F.parse_json("extras"), "$.vals", "map<string,variant>")).alias("field", "value"))
    return back.select("seq", "field", typed.canonical(F.col("value")).alias("text"))


@query(TYPED_SQL + "SELECT field, text, count(*) AS n, count(DISTINCT scene_id) AS scenes FROM vals WHERE (seq - 1) % 13 <> 0 GROUP BY ALL")
def typed_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values counted by fingerprint: equal ones meet, whatever their spelling."""
    rows = values_of(typed_log(spark, sf_dir)).filter("value is not null and (seq - 1) % 13 <> 0").withColumn("mark", typed.fingerprint(F.col("value")))
    return rows.groupBy("field", "mark").agg(F.min(typed.canonical(F.col("value"))).alias("text"), F.count("*").alias("n"), F.count_distinct("scene_id").alias("scenes")).drop("mark")
