"""Vectors, quaternions (w, x, y, z) and 4x4 row-vector matrices (16 numbers) as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def quaternion_product(a: Column, b: Column) -> Column:
    aw, ax, ay, az = (a[k] for k in range(4))
    bw, bx, by, bz = (b[k] for k in range(4))
    return F.array(aw * bw - ax * bx - ay * by - az * bz, aw * bx + ax * bw + ay * bz - az * by, aw * by - ax * bz + ay * bw + az * bx, aw * bz + ax * by - ay * bx + az * bw)


def conjugate(q: Column) -> Column:
    return F.array(q[0], -q[1], -q[2], -q[3])


def turned_into(frame: Column, q: Column) -> Column:
    """A rotation said in another frame: frame * q * frame conjugated."""
    return quaternion_product(quaternion_product(frame, q), conjugate(frame))


def _quarter_x(sign: int) -> Column:
    half = math.sqrt(0.5)
    return F.array(F.lit(half), F.lit(sign * half), F.lit(0.0), F.lit(0.0))


def y_up_to_z_up(v: Column) -> Column:
    return F.array(v[0], -v[2], v[1])


def z_up_to_y_up(v: Column) -> Column:
    return F.array(v[0], v[2], -v[1])


def y_up_to_z_up_scale(s: Column) -> Column:
    return F.array(s[0], s[2], s[1])


def y_up_to_z_up_rotation(q: Column) -> Column:
    return F.array(q[0], q[1], -q[3], q[2])


def z_up_to_y_up_rotation(q: Column) -> Column:
    return F.array(q[0], q[1], q[3], -q[2])


def with_axis_rotation(q: Column) -> Column:
    """A quarter turn about x, then the rotation."""
    return quaternion_product(_quarter_x(1), q)


def without_axis_rotation(q: Column) -> Column:
    return quaternion_product(_quarter_x(-1), q)


def needs_conversion(up_axis: Column) -> Column:
    return F.coalesce(F.upper(up_axis) == "Y", F.lit(False))


def from_euler(degrees: Column, order: str = "XYZ") -> Column:
    """The rotation of Euler angles; the first axis of the order is applied first."""

    def about(axis: str) -> Column:
        k = "XYZ".index(axis)
        half = F.radians(degrees[k]) / 2
        return F.array(F.cos(half), *(F.sin(half) if j == k else F.lit(0.0) for j in range(3)))

    q = about(order[0])
    for axis in order[1:]:
        q = quaternion_product(about(axis), q)
    return q


def scalar_last_to_first(q: Column) -> Column:
    return F.array(q[3], q[0], q[1], q[2])


def flattened(rows: Column) -> Column:
    return F.flatten(rows)


def unflattened(values: Column, stride: Column) -> Column:
    """Rows of `stride` numbers."""
    n = F.floor(F.size(values) / stride).cast("int")
    return F.when(n < 1, F.array().cast("array<array<double>>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(values, (k - 1) * stride + 1, stride)))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def decomposed(m: Column) -> Column:
    """Translation, rotation and scale of a matrix without shear; a reflection goes into the x scale.

    The rotation comes from the largest of the four quaternion components, which avoids small divisors.
    """

    def scales(e: Column) -> Column:
        norm = [F.sqrt(sum((e[4 * i + j] * e[4 * i + j] for j in range(1, 3)), e[4 * i] * e[4 * i])) for i in range(3)]
        minor = lambda j, k: e[4 + j] * e[8 + k] - e[4 + k] * e[8 + j]
        det = e[0] * minor(1, 2) - e[1] * minor(0, 2) + e[2] * minor(0, 1)
        return F.array(F.when(det < 0, -norm[0]).otherwise(norm[0]), norm[1], norm[2])

    def rotation(r: Column) -> Column:
        at = lambda i, j: r[3 * i + j]
        trace = at(0, 0) + at(1, 1) + at(2, 2)
        squares = F.array(1 + trace, *(1 + 2 * at(k, k) - trace for k in range(3)))

        def chosen(q: Column) -> Column:
            # four times the products of components, from sums and differences across the diagonal
            wx, wy, wz = at(1, 2) - at(2, 1), at(2, 0) - at(0, 2), at(0, 1) - at(1, 0)
            xy, xz, yz = at(0, 1) + at(1, 0), at(0, 2) + at(2, 0), at(1, 2) + at(2, 1)
            products = [[q[0], wx, wy, wz], [wx, q[1], xy, xz], [wy, xy, q[2], yz], [wz, xz, yz, q[3]]]
            best = F.array_max(q)
            row = None
            for k in range(4):
                row = F.when(q[k] == best, F.array(*products[k])) if row is None else row.when(q[k] == best, F.array(*products[k]))
            return F.transform(row, lambda x: x / (2 * F.sqrt(best)))

        return _let(squares, chosen)

    def whole(s: Column) -> Column:
        r = F.array(*(m[4 * i + j] / s[i] for i in range(3) for j in range(3)))
        return F.struct(F.array(m[12], m[13], m[14]).alias("t"), _let(r, rotation).alias("r"), s.alias("s"))

    return _let(scales(m), whole)


def wave_grid(spark: SparkSession, n: int, size: float, waves: list[tuple[float, float, float]]) -> DataFrame:
    """i, j, x, y, z of an n by n grid whose height is a sum of sine waves (frequency, amplitude, phase) over both axes."""
    step = size / (n - 1)
    grid = spark.range(n * n).select((F.col("id") % n).alias("i"), F.floor(F.col("id") / n).alias("j"))
    rows = grid.select("i", "j", (F.col("i") * step - size / 2).alias("x"), (F.col("j") * step - size / 2).alias("z"))
    y = sum((F.lit(a) * F.sin(F.lit(f) * F.col("x") + F.lit(p)) * F.cos(F.lit(f) * F.col("z") + F.lit(p)) for f, a, p in waves), F.lit(0.0))
    return rows.withColumn("y", y)


def grid_faces(spark: SparkSession, n: int) -> DataFrame:
    """face and its four point numbers, for an n by n grid of points."""
    a = F.col("id") % (n - 1) + F.floor(F.col("id") / (n - 1)) * n
    return spark.range((n - 1) * (n - 1)).select(F.col("id").alias("face"), a.alias("a"), (a + 1).alias("b"), (a + n + 1).alias("c"), (a + n).alias("d"))


def ring_motion(rows: DataFrame, t: float, *, radius: float, amplitude: float, period: float) -> DataFrame:
    """Adds x, y, z of instances (i, n) on a ring at a time; heights follow a sine with a phase by place."""
    angle = 2 * math.pi * F.col("i") / F.col("n")
    return rows.withColumns({"x": radius * F.cos(angle), "y": amplitude * F.sin(2 * math.pi * t / period + angle), "z": radius * F.sin(angle)})
