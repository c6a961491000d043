"""Queries on vectors, rotations, matrices and other values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import math3d, scalars
from ..operators import inspect, materials, scans, validate
from ..sources.edit_log import EDITS_SQL, edits, layers
from .registry import query


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("e"))


def spread(name: str, v: Column, n: int) -> list[Column]:
    return [F.round(v[k], 6).alias(f"{name}{k}") for k in range(n)]


V = "WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)\n"


@query(V + """SELECT vec_id, round(e[1]*e[5]-e[2]*e[6]-e[3]*e[7]-e[4]*e[8], 6) AS p0, round(e[1]*e[6]+e[2]*e[5]+e[3]*e[8]-e[4]*e[7], 6) AS p1, round(e[1]*e[7]-e[2]*e[8]+e[3]*e[5]+e[4]*e[6], 6) AS p2, round(e[1]*e[8]+e[2]*e[7]-e[3]*e[6]+e[4]*e[5], 6) AS p3,
round(e[1], 6) AS c0, round(-e[2], 6) AS c1, round(-e[3], 6) AS c2, round(-e[4], 6) AS c3 FROM v""")
def quaternion_algebra(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.slice("e", 1, 4), F.slice("e", 5, 4)
    return vectors(spark, sf_dir).select("vec_id", *spread("p", math3d.quaternion_product(a, b), 4), *spread("c", math3d.conjugate(a), 4))


@query(V + """, h AS (SELECT *, sqrt(0.5) AS h FROM v) SELECT vec_id, round(e[1], 6) AS v0, round(-e[3], 6) AS v1, round(e[2], 6) AS v2, round(e[1], 6) AS s0, round(e[3], 6) AS s1, round(e[2], 6) AS s2, round(e[1], 6) AS q0, round(e[2], 6) AS q1, round(-e[4], 6) AS q2, round(e[3], 6) AS q3,
round(h*e[1]-h*e[2], 6) AS a0, round(h*e[2]+h*e[1], 6) AS a1, round(h*e[3]-h*e[4], 6) AS a2, round(h*e[4]+h*e[3], 6) AS a3, round(e[4], 6) AS w0, round(e[1], 6) AS w1 FROM h""")
def axis_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("e")
    return vectors(spark, sf_dir).select("vec_id", *spread("v", math3d.y_up_to_z_up(e), 3), *spread("s", math3d.y_up_to_z_up_scale(e), 3), *spread("q", math3d.y_up_to_z_up_rotation(e), 4), *spread("a", math3d.with_axis_rotation(e), 4), *spread("w", math3d.scalar_last_to_first(e), 2))


@query(V + """, s AS (SELECT vec_id, abs(e[1]) + 0.1 AS a, abs(e[2]) + 0.1 AS b, (abs(e[3]) + 0.1) * CASE label % 2 WHEN 0 THEN 1 ELSE -1 END AS c, e, label, e[4] * 3 AS g FROM v)
SELECT vec_id, round(e[5], 6) AS t0, round(e[6], 6) AS t1, round(e[7], 6) AS t2, round(CASE label % 2 WHEN 0 THEN a ELSE -a END, 6) AS s0, round(b, 6) AS s1, round(abs(c), 6) AS s2,
  -- the rotation's matrix: a turn about z, and under a reflection of z one that also turns x about
  round(cos(g) * CASE label % 2 WHEN 0 THEN 1 ELSE -1 END, 6) + 0.0 AS r00, round(sin(g) * CASE label % 2 WHEN 0 THEN 1 ELSE -1 END, 6) + 0.0 AS r01, 0.0::DOUBLE AS r02, round(-sin(g), 6) + 0.0 AS r10, round(cos(g), 6) + 0.0 AS r11, round(CASE label % 2 WHEN 0 THEN 1.0 ELSE -1.0 END, 6)::DOUBLE AS r22 FROM s""")
def decomposed_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matrices of a scale, a turn about z and a shift; every second one has a reflection."""
    v = vectors(spark, sf_dir)
    e = F.col("e")
    a, b = F.abs(e[0]) + 0.1, F.abs(e[1]) + 0.1
    c = (F.abs(e[2]) + 0.1) * F.when(F.col("label") % 2 == 0, 1).otherwise(-1)
    co, si, o = F.cos(e[3] * 3), F.sin(e[3] * 3), F.lit(0.0)
    m = F.array(a * co, a * si, o, o, -b * si, b * co, o, o, o, o, c, o, e[4], e[5], e[6], F.lit(1.0))
    d = math3d.decomposed(m)
    out = v.select("vec_id", d.alias("d"))
    w, x, y, z = (F.col("d.r")[k] for k in range(4))
    turn = {"r00": 1 - 2 * (y * y + z * z), "r01": 2 * (x * y + w * z), "r02": 2 * (x * z - w * y), "r10": 2 * (x * y - w * z), "r11": 1 - 2 * (x * x + z * z), "r22": 1 - 2 * (x * x + y * y)}
    return out.select("vec_id", *spread("t", F.col("d.t"), 3), *spread("s", F.col("d.s"), 3), *((F.round(c, 6) + 0.0).alias(n) for n, c in turn.items()))


_ORDERS = ("XYZ", "XZY", "YXZ", "YZX", "ZXY", "ZYX")


def _turned(order: str) -> str:
    """DuckDB SQL for the unit vectors of x and z after turns by the angles a1, a2, a3 about the axes of an order, one after another."""
    def about(axis: str, angle: str, v: list[str]) -> list[str]:
        x, y, z = v
        c, s = f"cos({angle})", f"sin({angle})"
        return {"X": [x, f"({c} * ({y}) - {s} * ({z}))", f"({s} * ({y}) + {c} * ({z}))"], "Y": [f"({c} * ({x}) + {s} * ({z}))", y, f"({c} * ({z}) - {s} * ({x}))"], "Z": [f"({c} * ({x}) - {s} * ({y}))", f"({s} * ({x}) + {c} * ({y}))", z]}[axis]

    out = []
    for v in (["1.0", "0.0", "0.0"], ["0.0", "0.0", "1.0"]):
        for axis in order:
            v = about(axis, f"a{'XYZ'.index(axis) + 1}", v)
        out += v
    return ", ".join(f"round({x}, 5) + 0.0 AS {n}" for n, x in zip(("x0", "x1", "x2", "z0", "z1", "z2"), out, strict=True))


@query(V + ", a AS (SELECT vec_id, radians(e[1] * 90) AS a1, radians(e[2] * 90) AS a2, radians(e[3] * 90) AS a3 FROM v) " + " UNION ALL ".join(f"SELECT vec_id, '{o}' AS ord, {_turned(o)} FROM a" for o in _ORDERS))
def euler_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All six orders of three turns: where the rotation takes the x and the z axis."""
    e = F.col("e")
    turns = [F.struct(F.lit(o).alias("ord"), math3d.from_euler(F.array(e[0] * 90, e[1] * 90, e[2] * 90), o).alias("q")) for o in _ORDERS]
    rows = vectors(spark, sf_dir).select("vec_id", F.explode(F.array(*turns)).alias("t")).select("vec_id", "t.ord", "t.q")
    w, x, y, z = (F.col("q")[k] for k in range(4))
    axes = {"x0": 1 - 2 * (y * y + z * z), "x1": 2 * (x * y + w * z), "x2": 2 * (x * z - w * y), "z0": 2 * (x * z + w * y), "z1": 2 * (y * z - w * x), "z2": 1 - 2 * (x * x + y * y)}
    return rows.select("vec_id", "ord", *((F.round(c, 5) + 0.0).alias(n) for n, c in axes.items()))


@query(V + "SELECT vec_id, i AS row, round(e[3 * i + 1], 6) AS x, round(e[3 * i + 2], 6) AS y, round(e[3 * i + 3], 6) AS z FROM v, range(0, 5) t(i)")
def strided_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors(spark, sf_dir).select("vec_id", F.posexplode(math3d.unflattened(F.slice("e", 1, 15), F.lit(3))).alias("row", "p"))
    return rows.select("vec_id", F.col("row").cast("long").alias("row"), *(F.round(F.col("p")[k], 6).alias(c) for k, c in enumerate("xyz")))


@query(V + ", l AS (SELECT *, lag(e) OVER (ORDER BY vec_id) AS b FROM v) SELECT vec_id, b IS NOT NULL AND list_max([abs(z[1] - z[2]) FOR z IN list_zip(e, b)]) <= 0.5 AS near, e[1] > -1e300 AND e[1] < 1e300 AS finite FROM l")
def near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    other = v.select((F.col("vec_id") + 1).alias("vec_id"), F.col("e").alias("b"))
    rows = v.join(other, "vec_id", "left")
    return rows.select("vec_id", (F.col("b").isNotNull() & scalars.near(F.col("e"), F.col("b"), 0.5)).alias("near"), scalars.finite(F.col("e")[0]).alias("finite"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'inputs' WHEN p_partkey % 3 = 1 THEN 'outputs' END AS part, CASE WHEN p_partkey % 3 < 2 THEN p_name END AS base, CASE WHEN p_partkey % 4 < 3 THEN 'mix' || (p_partkey % 5) END AS category, CASE p_partkey % 4 WHEN 0 THEN 'color3' WHEN 1 THEN 'float' WHEN 2 THEN 'vector3' END AS type FROM part")
def shader_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    name = F.expr("concat(case p_partkey % 3 when 0 then 'inputs:' when 1 then 'outputs:' else 'x:' end, p_name)")
    node = F.expr("concat('ND_mix', p_partkey % 5, '_', element_at(array('color3', 'float', 'vector3', 'nothing'), cast(p_partkey % 4 + 1 as int)))")
    return p.select("p_partkey", scalars.connectable_part(name).alias("part"), scalars.connectable_base(name).alias("base"), scalars.node_category(node).alias("category"), scalars.node_type(node).alias("type"))


@query("SELECT o_orderkey, CASE o_orderkey % 6 WHEN 1 THEN 'invalid_identity' WHEN 2 THEN 'unexpected_id' WHEN 3 THEN 'stale_layer_graph' WHEN 4 THEN 'invalid_transaction' ELSE 'unknown_' || (o_orderkey % 6) END AS name, CASE o_orderkey % 6 WHEN 3 THEN 'recoverable_conflict' WHEN 4 THEN 'invalid_operation' ELSE 'session_fatal' END AS disposition, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' || (s % 3600 // 60) || 'm' WHEN s >= 60 THEN (s // 60) || 'm ' || (s % 60) || 's' ELSE s || 's' END AS uptime FROM (SELECT o_orderkey, CAST(o_orderkey * 7 % 9000 AS BIGINT) AS s FROM orders)")
def rejection_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    code = (F.col("o_orderkey") % 6).cast("int")
    return o.select("o_orderkey", scalars.rejection_name(code).alias("name"), scalars.rejection_disposition(code).alias("disposition"), scalars.uptime(F.col("o_orderkey") * 7 % 9000).alias("uptime"))


@query("""WITH m AS (SELECT p_partkey, p_retailprice / 1000 AS base, coalesce(CASE WHEN p_size % 3 > 0 THEN p_size / 50.0 END, 0.3) AS rough, CASE WHEN p_size % 5 = 0 THEN 0.0 ELSE p_size / 100.0 END AS coat, p_size / 60.0 AS grey, (p_partkey % 7) / 7.0 AS metal, (p_partkey % 5) / 5.0 AS sub, 1.2 + (p_partkey % 4) / 4.0 AS ior, (p_partkey % 3) / 3.0 AS darkening, (p_partkey % 11) / 11.0 AS fuzz, (p_partkey % 2) * 0.5 AS film FROM part),
n AS (SELECT *, power((ior - 1) / (ior + 1), 2) AS f0 FROM m), o AS (SELECT *, 1 - (1 - f0) / (ior * ior) AS inside, grey * 1.0 AS metal_r, grey + (0.8 - grey) * sub AS other_r FROM n),
p AS (SELECT *, other_r + (metal_r - other_r) * metal AS below FROM o), q AS (SELECT *, 1 + ((1 - inside) / (1 - below * inside) - 1) * coat * darkening AS dark FROM p)
SELECT p_partkey, round(base, 6) AS base, round(rough * (1 - coat), 6) AS specular_roughness, round(coat, 6) AS coat, round(grey * dark, 6) AS base_color, round(0.8 * dark, 6) AS subsurface_color, round(ior, 6) AS coat_IOR, round(metal, 6) AS metalness, round(sub, 6) AS subsurface, round(power(fuzz, 2.5), 6) AS sheen_roughness,
  round(CASE WHEN film > 0 THEN 500.0 ELSE 0.0 END, 6) AS thin_film_thickness, round(grey, 6) AS opacity, 1.0::DOUBLE AS coat_affect_roughness, false AS thin_walled, 1.5::DOUBLE AS specular_IOR, 0.25::DOUBLE AS subsurface_radius FROM q""")
def standard_surfaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grey under a coat that darkens it, with metal, subsurface, fuzz and film; opacity given as one number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    share = lambda n: (F.col("p_partkey") % n / n).cast("double")
    grey = (F.col("p_size") / 60.0).cast("double")
    rows = p.select("p_partkey", (F.col("p_retailprice") / 1000).cast("double").alias("base_weight"), F.expr("if(p_size % 3 > 0, cast(p_size / 50.0 as double), null)").alias("specular_roughness"), F.expr("if(p_size % 5 = 0, null, cast(p_size / 100.0 as double))").alias("coat_weight"), F.array(grey, grey, grey).alias("base_color"), share(7).alias("base_metalness"), share(5).alias("subsurface_weight"), (1.2 + share(4)).alias("coat_ior"), share(3).alias("coat_darkening"), share(11).alias("fuzz_roughness"), (F.col("p_partkey") % 2 * 0.5).cast("double").alias("thin_film_weight"), grey.alias("geometry_opacity"))
    out = materials.standard_surface(rows)
    colours, last = ("base_color", "subsurface_color", "opacity"), "subsurface_radius"
    plain = ("base", "specular_roughness", "coat", "coat_IOR", "metalness", "subsurface", "sheen_roughness", "thin_film_thickness", "coat_affect_roughness", "specular_IOR")
    return out.select("p_partkey", "thin_walled", *(F.round(c, 6).alias(c) for c in plain), *(F.round(F.col(c)[0], 6).alias(c) for c in colours), F.round(F.col(last)[2], 6).alias(last))


@query(EDITS_SQL + "SELECT layer_key, CASE layer_key WHEN 'department:fx' THEN 1 WHEN 'department:animation' THEN 2 WHEN 'department:lighting' THEN 3 ELSE 4 END AS rank, muted FROM layers WHERE layer_key IN (SELECT layer_key FROM edits)")
def layer_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = edits(spark, sf_dir).select("layer_key").distinct()
    return inspect.layer_order(layers(spark).join(used, "layer_key", "left_semi"), ["department:fx"])


@query(EDITS_SQL + "SELECT DISTINCT layer_key, CASE WHEN layer_key = 'default' THEN NULL ELSE layer_key[12:] END AS department, CASE WHEN layer_key = 'default' THEN layer_key ELSE layer_key[12:] END AS label FROM edits")
def layer_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("layer_key")
    return edits(spark, sf_dir).select("layer_key").distinct().select("layer_key", scans.department_of(key).alias("department"), scans.layer_label(key).alias("label"))


@query(EDITS_SQL + "SELECT session_id, client_id, bool_and(k = 'set_xform_trs') AS transform_only FROM edits GROUP BY 1, 2")
def transform_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scans.batch_is_transforms(edits(spark, sf_dir), "session_id", "client_id")


@query("WITH r AS (SELECT vec_id AS id, embedding AS e FROM embeddings) SELECT id, 'r' AS field FROM r WHERE id % 7 = 0 UNION ALL SELECT id, 't' FROM r WHERE id % 5 = 0")
def vector_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    nan = F.array(*(F.lit(float("nan")) for _ in range(3)))
    rows = v.select(F.col("vec_id").alias("id"), F.when(F.col("vec_id") % 5 == 0, nan).otherwise(F.slice("e", 1, 3)).alias("t"), F.when(F.col("vec_id") % 7 == 0, F.slice("e", 1, 3)).otherwise(F.slice("e", 1, 4)).alias("r"), F.slice("e", 5, 3).alias("s"))
    return validate.vector_faults(rows)
