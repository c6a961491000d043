"""The edit log as a table, and the relations beside it.

`edits` derives a log from the events table: five scenes, four layers, five kinds of
edits. Own logs bring the same columns. seq orders all edits of a scene.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, VariantType

#: An edit as it is read from JSON lines; kinds fill what they need.
EDIT_SCHEMA = """scene_id string, seq long, client_id string, session_id string, txn_id long, origin string, layer_key string, k string,
prim string, time double, spec_path string, spec_kind string, fragment string, material_purpose string, material_path string, fields array<string>, vals map<string, variant>,
api_schemas array<string>, type_name string, new_name string, flag boolean, selections map<string, string>,
arcs array<struct<asset_path: string, prim_path: string, list_position: string, layer_offset: double, layer_scale: double>>,
connections map<string, struct<prim: string, attr: string>>, disconnections array<string>, info_id string, input_types map<string, string>,
primvar_meta map<string, struct<type_name: string, interpolation: string>>, attr_interp map<string, string>, times array<double>, removed boolean,
up_axis string, generation string, revision long, sublayers array<struct<authored_path: string, offset: double, scale: double, layer_key: string>>, n_bytes int, ts timestamp, rescued string"""

#: The layers of the derived log, strongest first: key, rank, muted.
LAYERS = (("department:animation", 1, False), ("department:lighting", 2, False), ("department:fx", 3, True), ("default", 4, False))


def edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log derived from events; narrow, in place and without a shuffle."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("kk", F.get_json_object("props", "$.k").cast("int"))
    kind = F.expr("CASE event_type WHEN 'signup' THEN 'ensure_prim' WHEN 'click' THEN 'set_xform_trs' WHEN 'purchase' THEN 'set_gprim_attrs' WHEN 'view' THEN 'set_visibility' ELSE 'delete_prim' END")
    e = e.withColumn("k", kind)
    return e.select(
        F.expr("concat('scene-', user_id % 5)").alias("scene_id"),
        (F.col("event_id") + 1).alias("seq"),
        F.expr("concat('c', user_id)").alias("client_id"),
        F.expr("concat('s', event_id % 7)").alias("session_id"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'department:animation' WHEN 2 THEN 'department:lighting' ELSE 'department:fx' END").alias("layer_key"),
        "k",
        F.expr("CASE WHEN event_type = 'error' AND kk < 10 THEN concat('/World/G', kk % 5) ELSE concat('/World/G', kk % 5, '/P', kk) END").alias("prim"),
        F.expr("CASE WHEN event_id % 3 = 0 OR k IN ('ensure_prim', 'delete_prim') THEN NULL ELSE cast(cast(floor(event_id / 3) AS bigint) % 4 AS double) END").alias("time"),
        F.expr("CASE event_type WHEN 'click' THEN if(event_id % 2 = 0, 't', 's') WHEN 'purchase' THEN concat('a', event_id % 5) WHEN 'view' THEN 'visibility' ELSE '' END").alias("field"),
        "value",
        F.length("props").alias("n_bytes"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "kk",
    )


def layers(spark: SparkSession) -> DataFrame:
    """layer_key, rank (1: strongest) and muted; a table of fixed size."""
    return spark.createDataFrame(LAYERS, "layer_key string, rank int, muted boolean")


# Names of fields in edits as JSON, where a column or a value of vals has another name.
ALIASES = {"type_name": ("typeName",), "up_axis": ("upAxis",), "flag": ("active", "visible", "instanceable"), "arcs": ("refs", "payloads")}
VALUE_MAPS = ("vals", "attrs", "inputs")
VALUE_FIELDS = (
    "t", "r", "s", "prototypes", "proto_indices", "positions", "orientations", "scales", "velocities", "accelerations", "angular_velocities", "ids", "invisible_ids", "inactive_ids",
    "timeCodesPerSecond", "framesPerSecond", "startTimeCode", "endTimeCode", "metersPerUnit",
)


def _raw_schema() -> StructType:
    """What an edit's JSON may hold: the columns, their other names, and the values that are fields of their own."""
    own = StructType.fromDDL(EDIT_SCHEMA)
    link = StructType.fromDDL("c map<string, struct<prim: string, attr: string, source_prim: string, source_attr: string>>")["c"].dataType
    types = {f.name: link if f.name == "connections" else f.dataType for f in own if f.name not in ("vals", "rescued")}
    more = {other: types[c] for c, others in ALIASES.items() for other in others} | dict.fromkeys(VALUE_MAPS, own["vals"].dataType) | dict.fromkeys(VALUE_FIELDS, VariantType())
    return StructType([StructField(n, t) for n, t in (types | more | {"_bad": StringType()}).items()])


def parsed_edits(lines: DataFrame) -> DataFrame:
    """Edits in the columns of EDIT_SCHEMA from `lines` (value: one JSON object), a table or a stream.

    Values keep their types in vals, whether they come there, in attrs or inputs, or as fields of their own (t, positions, metersPerUnit and the like);
    a connection's source_prim and source_attr are its prim and attr. What no column can take is not lost: rescued holds the fields that are not known as JSON, or the
    whole line where a value has another type than its column or the line is no object; it is null where all was taken. Empty lines are skipped.
    """
    every = StructType.fromDDL(EDIT_SCHEMA).names
    names = [n for n in every if n not in ("vals", "rescued")]
    raw = _raw_schema()
    text, none = F.col("value"), F.create_map().cast("map<string,variant>")
    rows = lines.filter(F.trim(text) != "").select(text.alias("_line"), F.from_json(text, raw, {"columnNameOfCorruptRecord": "_bad"}).alias("_e"), F.json_object_keys(text).alias("_keys"))
    field = lambda n: F.col(f"_e.{n}")
    own = F.array_compact(F.array(*(F.when(field(n).isNotNull(), F.struct(F.lit(n).alias("key"), field(n).alias("value"))) for n in VALUE_FIELDS)))
    rows = rows.withColumn("_entries", F.concat(*(F.map_entries(F.coalesce(field(m), none)) for m in VALUE_MAPS), own))
    later = F.filter("_entries", lambda e, i: ~F.exists(F.slice("_entries", i + 2, F.size("_entries")), lambda x: x["key"] == e["key"]))
    given = F.greatest(*(field(m).isNotNull() for m in VALUE_MAPS), F.size("_entries") > 0)
    rows = rows.withColumn("vals", F.when(given, F.map_from_entries(later)))
    unknown = F.array_except("_keys", F.array(*map(F.lit, raw.names)))
    rest = F.map_filter(F.from_json("_line", "map<string,variant>"), lambda k, _: F.array_contains("_unknown", k))
    rows = rows.withColumn("_unknown", unknown)
    rescued = F.when(F.col("_keys").isNull() | field("_bad").isNotNull(), F.col("_line")).when(F.size("_unknown") > 0, F.to_json(rest))
    columns = {n: F.coalesce(field(n), *(field(other) for other in ALIASES.get(n, ()))) for n in names}
    columns["connections"] = F.transform_values(field("connections"), lambda _, c: F.struct(F.coalesce(c["prim"], c["source_prim"]).alias("prim"), F.coalesce(c["attr"], c["source_attr"]).alias("attr")))
    columns["fields"] = F.coalesce(columns["fields"], F.map_keys("vals"))
    columns |= {"vals": F.col("vals"), "rescued": rescued}
    return rows.select(*(columns[n].alias(n) for n in every))


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """Edits from JSON lines, one object a line; fields that an object lacks are null, what no column takes is in rescued."""
    return parsed_edits(spark.read.text(path))


def stack_samples(spark: SparkSession, path: str) -> DataFrame:
    """Collapsed stacks from text, `frame;frame;... count` a line: frames and samples. Other lines are skipped."""
    return parsed_stacks(spark.read.text(path))


def parsed_stacks(lines: DataFrame) -> DataFrame:
    rows = lines.select(F.regexp_extract("value", r"^(.*\S)\s+(\d+)\s*$", 1).alias("stack"), F.regexp_extract("value", r"^(.*\S)\s+(\d+)\s*$", 2).alias("n"))
    return rows.filter("stack != ''").select(F.split("stack", ";").alias("frames"), F.col("n").cast("long").alias("samples"))


def dumped(log: DataFrame) -> DataFrame:
    """seq, k, prim and all other columns as one JSON text, for a dump."""
    rest = [c for c in log.columns if c not in ("seq", "k", "prim")]
    return log.select("seq", "k", "prim", F.to_json(F.struct(*rest)).alias("extras"))


#: `edits` and `layers` for DuckDB; queries' SQL twins begin with it.
EDITS_SQL = """
WITH e0 AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS kk FROM events),
e1 AS (SELECT *, CASE event_type WHEN 'signup' THEN 'ensure_prim' WHEN 'click' THEN 'set_xform_trs' WHEN 'purchase' THEN 'set_gprim_attrs'
  WHEN 'view' THEN 'set_visibility' ELSE 'delete_prim' END AS k FROM e0),
edits AS (SELECT 'scene-' || (user_id % 5) AS scene_id, event_id + 1 AS seq, 'c' || user_id AS client_id, 's' || (event_id % 7) AS session_id,
  CASE user_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'department:animation' WHEN 2 THEN 'department:lighting' ELSE 'department:fx' END AS layer_key, k,
  CASE WHEN event_type = 'error' AND kk < 10 THEN '/World/G' || (kk % 5) ELSE '/World/G' || (kk % 5) || '/P' || kk END AS prim,
  CASE WHEN event_id % 3 = 0 OR k IN ('ensure_prim', 'delete_prim') THEN NULL ELSE CAST((event_id // 3) % 4 AS DOUBLE) END AS time,
  CASE event_type WHEN 'click' THEN CASE WHEN event_id % 2 = 0 THEN 't' ELSE 's' END WHEN 'purchase' THEN 'a' || (event_id % 5) WHEN 'view' THEN 'visibility' ELSE '' END AS field,
  value, CAST(length(props) AS INT) AS n_bytes, ts, event_id, kk FROM e1),
layers(layer_key, rank, muted) AS (VALUES ('department:animation', 1, false), ('department:lighting', 2, false), ('department:fx', 3, true), ('default', 4, false))
"""
