"""Queries on transforms down the prim tree; embeddings serve as geometry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import transforms
from .registry import query

_TIMES = "flatten([[a[4 * i + 1] * b[j + 1] + a[4 * i + 2] * b[j + 5] + a[4 * i + 3] * b[j + 9] + a[4 * i + 4] * b[j + 13] for j in [0, 1, 2, 3]] for i in [0, 1, 2, 3]])"
#: Local matrices of three levels and their products for DuckDB: resets stands for the products above.
SPACE_SQL = f"""WITH v AS (SELECT '/W/L' || (label % 3) || '/V' || vec_id AS prim, '/W/L' || (label % 3) AS up, label % 3 AS g, vec_id % 7 = 0 AS resets, embedding::DOUBLE[] AS e FROM embeddings),
q AS (SELECT prim, [e[4], e[5], e[6]] AS t, [x / sqrt(e[7] * e[7] + e[8] * e[8] + e[9] * e[9] + e[10] * e[10]) for x in e[7:10]] AS r, [1 + abs(e[11]), 1.0, 2.0] AS s FROM v
  UNION ALL SELECT DISTINCT up, [g::DOUBLE, 0, -g::DOUBLE], [0.8, 0.6, 0, 0]::DOUBLE[], [1, 2, 3]::DOUBLE[] FROM v UNION ALL SELECT '/W', [1, 2, 3]::DOUBLE[], [0.5, 0.5, -0.5, 0.5]::DOUBLE[], [2, 2, 2]::DOUBLE[]),
m AS (SELECT prim, [s[1] * (1 - 2 * (r[3] * r[3] + r[4] * r[4])), s[1] * 2 * (r[2] * r[3] + r[1] * r[4]), s[1] * 2 * (r[2] * r[4] - r[1] * r[3]), 0,
  s[2] * 2 * (r[2] * r[3] - r[1] * r[4]), s[2] * (1 - 2 * (r[2] * r[2] + r[4] * r[4])), s[2] * 2 * (r[3] * r[4] + r[1] * r[2]), 0, s[3] * 2 * (r[2] * r[4] + r[1] * r[3]), s[3] * 2 * (r[3] * r[4] - r[1] * r[2]), s[3] * (1 - 2 * (r[2] * r[2] + r[3] * r[3])), 0, t[1], t[2], t[3], 1] AS m FROM q),
p AS (SELECT l.prim, {_TIMES} AS m FROM (SELECT x.prim, x.m AS a, w.m AS b FROM m x, m w WHERE w.prim = '/W' AND x.prim LIKE '/W/L_') l),
world AS (SELECT l.prim, CASE WHEN resets THEN a ELSE {_TIMES} END AS m FROM (SELECT v.prim, v.resets, x.m AS a, p.m AS b FROM v JOIN m x USING (prim) JOIN p ON p.prim = v.up) l)
"""


def _geometry(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two points a prim in its own space, and the local transforms of three levels; every seventh prim does not build on its parent's."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", (F.col("label") % 3).alias("g"), F.col("embedding").cast("array<double>").alias("e"))
    e = e.withColumns({"scene_id": F.lit("s"), "up": F.concat(F.lit("/W/L"), "g"), "prim": F.concat(F.lit("/W/L"), "g", F.lit("/V"), "vec_id")})
    points = e.select("scene_id", "prim", F.explode(F.array(*(F.struct(*(F.col("e")[b + k].alias(c) for k, c in enumerate("xyz"))) for b in (0, 13)))).alias("p")).select("scene_id", "prim", "p.*")
    at = lambda first, n: F.array(*(F.col("e")[first + k] for k in range(n)))
    length = F.sqrt(sum((F.col("e")[k] * F.col("e")[k] for k in (7, 8, 9)), F.col("e")[6] * F.col("e")[6]))
    many = lambda *x: F.array(*(F.lit(float(v)) for v in x))
    own = e.select("scene_id", "prim", at(3, 3).alias("t"), F.transform(at(6, 4), lambda x: x / length).alias("r"), F.array(1 + F.abs(F.col("e")[10]), F.lit(1.0), F.lit(2.0)).alias("s"), (F.col("vec_id") % 7 == 0).alias("resets"))
    groups = e.select("scene_id", "up", "g").distinct().select("scene_id", F.col("up").alias("prim"), F.array(F.col("g").cast("double"), F.lit(0.0), -F.col("g").cast("double")).alias("t"), many(0.8, 0.6, 0, 0).alias("r"), many(1, 2, 3).alias("s"), F.lit(False).alias("resets"))
    root = e.select("scene_id").distinct().select("scene_id", F.lit("/W").alias("prim"), many(1, 2, 3).alias("t"), many(0.5, 0.5, -0.5, 0.5).alias("r"), many(2, 2, 2).alias("s"), F.lit(False).alias("resets"))
    every = own.unionByName(groups).unionByName(root)
    return points, every.select("scene_id", "prim", transforms.local_matrix(F.col("t"), F.col("r"), F.col("s")).alias("matrix"), "resets")


@query(SPACE_SQL + "SELECT prim, " + ", ".join(f"round(m[{k + 1}], 6) + 0.0 AS m{k}" for k in range(16) if k % 4 < 3) + " FROM world")
def world_matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    points, local = _geometry(spark, sf_dir)
    return transforms.world_matrices(points, local).select("prim", *((F.round(F.col("world")[k], 6) + 0.0).alias(f"m{k}") for k in range(16) if k % 4 < 3))


@query(SPACE_SQL + """, b AS (SELECT prim, [least(e[1], e[14]), greatest(e[1], e[14])] AS x, [least(e[2], e[15]), greatest(e[2], e[15])] AS y, [least(e[3], e[16]), greatest(e[3], e[16])] AS z FROM v),
corners AS (SELECT b.prim, x[i] AS x, y[j] AS y, z[k] AS z, m FROM b JOIN world USING (prim), (VALUES (1), (2)) s(i), (VALUES (1), (2)) t(j), (VALUES (1), (2)) u(k)),
w AS (SELECT unnest(['/W', '/W/' || split_part(prim, '/', 3), prim]) AS prim, x * m[1] + y * m[5] + z * m[9] + m[13] AS x, x * m[2] + y * m[6] + z * m[10] + m[14] AS y, x * m[3] + y * m[7] + z * m[11] + m[15] AS z FROM corners)
SELECT prim, """ + ", ".join(f"round({f}({c}), 6) + 0.0 AS {c}_{f}" for c in "xyz" for f in ("min", "max")) + " FROM w GROUP BY 1")
def world_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes in world space of every prim and group, under rotated and scaled parents."""
    rows = transforms.world_bounds(*_geometry(spark, sf_dir))
    return rows.select("prim", *((F.round(f"{c}_{n}", 6) + 0.0).alias(f"{c}_{n}") for c in "xyz" for n in ("min", "max")))
