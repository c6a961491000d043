"""A log with edits of all kinds and their payloads, derived from orders: one edit an order, narrow and without a shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.scans import KINDS

_NAMES = tuple(row[0] for row in KINDS)
_LIST = ", ".join(f"'{k}'" for k in _NAMES)
_DEEP = "k IN ('replace_sdf_layer_content', 'set_sublayers', 'set_stage_metadata')"
_TIMED = "k IN ('set_gprim_attrs', 'set_xform_trs', 'set_connectable_input', 'set_visibility', 'set_point_instancer')"
_SPEC = "k IN ('set_sdf_spec_fields', 'erase_time_samples')"

#: Column and expression, in SQL that Spark and DuckDB read alike; n is the order's key, c the customer's, v a whole number below 1000.
COLUMNS = {
    "scene_id": "concat('scene-', c % 5)",
    "seq": "n",
    "client_id": "concat('c', c % 50)",
    "session_id": "concat('s', c % 7)",
    "layer_key": "CASE c % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'department:animation' WHEN 2 THEN 'department:lighting' ELSE 'department:fx' END",
    "k": "k",
    "prim": f"CASE WHEN {_DEEP} THEN '/' WHEN k IN ('delete_prim', 'rename_prim') AND v % 40 = 0 THEN concat('/World/G', c % 6) ELSE concat('/World/G', c % 6, '/P', v % 20) END",
    "time": f"CASE WHEN {_TIMED} AND n % 3 <> 0 THEN CAST(n % 4 AS DOUBLE) END",
    "spec_name": f"CASE WHEN {_SPEC} THEN concat('spec', n % 3) END",
    "material_purpose": "CASE WHEN k = 'set_material_binding' AND n % 3 = 0 THEN 'full' ELSE '' END",
    "material_path": "CASE WHEN k = 'set_material_binding' THEN concat('/Mat/M', v % 9) END",
    "removed": "k = 'set_sdf_spec_fields' AND n % 5 = 0",
    "type_name": "CASE WHEN k = 'ensure_prim' AND n % 4 <> 0 THEN concat('T', v % 7) END",
    "schema_name": "CASE WHEN k = 'ensure_prim' THEN concat('S', v % 3) END",
    "new_name": "CASE WHEN k = 'rename_prim' THEN concat('N', v % 30) END",
    "flag": "CASE WHEN k IN ('set_visibility', 'deactivate_prim', 'set_instanceable') THEN v % 2 = 0 END",
    "f1": "CASE k WHEN 'set_xform_trs' THEN CASE WHEN n % 2 = 0 THEN 't' ELSE 's' END WHEN 'set_gprim_attrs' THEN concat('a', v % 3) WHEN 'set_connectable_input' THEN concat('i', v % 3) WHEN 'set_stage_metadata' THEN 'metersPerUnit' WHEN 'set_point_instancer' THEN 'positions' WHEN 'set_sdf_spec_fields' THEN CASE WHEN n % 5 <> 0 THEN CASE WHEN n % 7 = 0 THEN 'timeSamples' ELSE 'default' END END END",
    "f2": "CASE WHEN k = 'set_gprim_attrs' AND n % 2 = 0 THEN 'b' WHEN k = 'set_stage_metadata' AND n % 2 = 0 THEN 'timeCodesPerSecond' END",
    "v1": "CAST(1 + v AS DOUBLE)",
    "v2": "CAST(1 + v % 10 AS DOUBLE)",
    "up_axis": "CASE WHEN k = 'set_stage_metadata' AND n % 3 = 0 THEN CASE WHEN v % 2 = 0 THEN 'Y' ELSE 'Z' END END",
    "sel_name": "CASE WHEN k = 'set_variant_selections' THEN concat('set', v % 3) END",
    "sel_value": "concat('v', v % 5)",
    "conn_name": "CASE WHEN k = 'set_connectable_connection' AND v % 4 <> 0 THEN concat('inputs:x', n % 3) END",
    "conn_source": "concat('/World/G', (c + 1) % 6, '/P', (v + 1) % 20)",
    "gone_name": "CASE WHEN k = 'set_connectable_connection' AND v % 4 IN (0, 1) THEN concat('inputs:x', v % 3) END",
    "info_id": "CASE WHEN k = 'set_connectable_input' AND n % 3 = 0 THEN concat('Info', v % 3) END",
    "asset": "CASE WHEN k IN ('set_reference', 'set_payload') THEN concat('assets/a', v % 50, '.usd') END",
    "position": "CASE v % 4 WHEN 0 THEN 'explicit' WHEN 1 THEN 'prepended' WHEN 2 THEN 'appended' ELSE 'deleted' END",
    "sample": "CASE WHEN k = 'erase_time_samples' THEN CAST(n % 4 AS DOUBLE) END",
}
_SELECT = ", ".join(f"{e} AS {c}" for c, e in COLUMNS.items())

#: The same log for DuckDB, flat; queries' SQL twins begin with it.
FULL_SQL = f"""WITH o0 AS (SELECT o_orderkey AS n, o_custkey AS c, CAST(floor(o_totalprice) AS BIGINT) % 1000 AS v FROM orders),
o1 AS (SELECT *, [{_LIST}][CAST((n + c) % {len(_NAMES)} AS INT) + 1] AS k FROM o0), o2 AS (SELECT {_SELECT} FROM o1),
full_log AS (SELECT *, CASE WHEN spec_name IS NULL THEN '' ELSE prim || '.' || spec_name END AS spec_path FROM o2)
"""


def flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log with one column a payload part."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").selectExpr("o_orderkey AS n", "o_custkey AS c", "CAST(floor(o_totalprice) AS BIGINT) % 1000 AS v")
    rows = rows.withColumn("k", F.element_at(F.array(*map(F.lit, _NAMES)), ((F.col("n") + F.col("c")) % len(_NAMES) + 1).cast("int")))
    rows = rows.selectExpr(*(f"{e} AS {c}" for c, e in COLUMNS.items()))
    return rows.withColumn("spec_path", F.when(F.col("spec_name").isNull(), "").otherwise(F.concat("prim", F.lit("."), "spec_name")))


def full_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log in the columns of EDIT_SCHEMA that it fills."""
    d = flat(spark, sf_dir)

    def mapped(*pairs: tuple[str, str]) -> Column:
        entries = F.array_compact(F.array(*(F.when(F.col(name).isNotNull(), F.struct(F.col(name).alias("key"), F.col(v).alias("value"))) for name, v in pairs)))
        return F.map_from_entries(entries)

    def listed(name: str) -> Column:
        return F.array_compact(F.array(name))

    arc = F.struct(F.col("asset").alias("asset_path"), F.lit(None).cast("string").alias("prim_path"), F.col("position").alias("list_position"), F.lit(0.0).alias("layer_offset"), F.lit(1.0).alias("layer_scale"))
    link = F.when(F.col("conn_name").isNotNull(), F.create_map("conn_name", F.struct(F.col("conn_source").alias("prim"), F.lit("outputs:out").alias("attr"))))
    vals = mapped(("f1", "v1"), ("f2", "v2"))
    return d.select(
        "scene_id", "seq", "client_id", "session_id", F.expr("seq div 8").alias("txn_id"), "layer_key", "k", "prim", "time", "spec_path",
        F.when(F.col("k") == "set_sdf_spec_fields", "attribute").alias("spec_kind"), "material_purpose", "material_path", F.map_keys(vals).alias("fields"), vals.alias("vals"),
        listed("schema_name").alias("api_schemas"), "type_name", "new_name", "flag", mapped(("sel_name", "sel_value")).alias("selections"),
        F.when(F.col("asset").isNotNull(), F.array(arc)).alias("arcs"), link.alias("connections"), listed("gone_name").alias("disconnections"), "info_id", listed("sample").alias("times"), "removed", "up_axis",
    )
