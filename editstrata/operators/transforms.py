"""Transforms down the prim tree and bounds in world space. Matrices have 16 numbers by rows and act on row vectors: a point times the prim's matrix, then the parent's, up to the root."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import depth, lineage

IDENTITY = tuple(float(i == j) for i in range(4) for j in range(4))
AXES = "xyz"


def product(a: Column, b: Column) -> Column:
    """a, then b."""
    return F.array(*(sum((a[4 * i + k] * b[4 * k + j] for k in range(1, 4)), a[4 * i] * b[j]) for i in range(4) for j in range(4)))


def local_matrix(t: Column, r: Column, s: Column) -> Column:
    """Scale, then rotation (a unit quaternion w, x, y, z), then translation; each may be null: none."""
    t, s = F.coalesce(t, F.array(*[F.lit(0.0)] * 3)), F.coalesce(s, F.array(*[F.lit(1.0)] * 3))
    r = F.coalesce(r, F.array(*map(F.lit, (1.0, 0.0, 0.0, 0.0))))
    w, x, y, z = (r[k] for k in range(4))
    turned = (
        (1 - 2 * (y * y + z * z), 2 * (x * y + w * z), 2 * (x * z - w * y)),
        (2 * (x * y - w * z), 1 - 2 * (x * x + z * z), 2 * (y * z + w * x)),
        (2 * (x * z + w * y), 2 * (y * z - w * x), 1 - 2 * (x * x + y * y)),
    )
    rows = [F.lit(v) * 1.0 if isinstance(v, float) else v for i in range(3) for v in (*(s[i] * turned[i][j] for j in range(3)), 0.0)]
    return F.array(*rows, t[0], t[1], t[2], F.lit(1.0))


def world_matrices(prims: DataFrame, transforms: DataFrame) -> DataFrame:
    """scene_id, prim and world: the product of the local matrices at and above each of `prims` (scene_id, prim).

    `transforms`: scene_id, prim, matrix and resets, true where a prim's transform does not build on its parent's; prims without a row stand as their parent does. A lineage is joined, not
    walked: one shuffle whatever the depth, and a prim gathers one matrix for each of its ancestors.
    """
    above = prims.select("scene_id", "prim").distinct().withColumn("_above", F.explode(lineage(F.col("prim"))))
    local = transforms.select("scene_id", F.col("prim").alias("_above"), "matrix", F.coalesce("resets", F.lit(False)).alias("resets"))
    found = above.join(local, ["scene_id", "_above"], "left").withColumn("matrix", F.coalesce("matrix", F.array(*map(F.lit, IDENTITY))))
    chain = found.groupBy("scene_id", "prim").agg(F.sort_array(F.collect_list(F.struct(depth(F.col("_above")).alias("d"), "matrix", F.coalesce("resets", F.lit(False)).alias("resets")))).alias("chain"))
    fold = F.aggregate("chain", F.array(*map(F.lit, IDENTITY)), lambda acc, x: F.when(x["resets"], x["matrix"]).otherwise(product(x["matrix"], acc)))
    return chain.select("scene_id", "prim", fold.alias("world"))


def world_bounds(points: DataFrame, transforms: DataFrame) -> DataFrame:
    """scene_id, prim, x_min to z_max: for each prim at or above geometry the box, along the world's axes, of the boxes at and below it.

    `points` (scene_id, prim, x, y, z) are in their prim's own space. A prim's points become its own box there, and the eight corners of that go through the chain of
    transforms (see world_matrices); the boxes of a subtree are united. Prims that a reference brings along are rows like others; hidden, inactive and proxy geometry is left out by leaving out its
    points. Prims without geometry below have no row.
    """
    own = points.groupBy("scene_id", "prim").agg(*(f(c).alias(f"_{c}_{n}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))
    placed = own.join(world_matrices(own, transforms), ["scene_id", "prim"])

    def end(j: int, pick) -> Column:  # of an affine map the corners' least is the sum of each axis' least
        terms = [pick(F.col(f"_{c}_min") * F.col("world")[4 * k + j], F.col(f"_{c}_max") * F.col("world")[4 * k + j]) for k, c in enumerate(AXES)]
        return terms[0] + terms[1] + terms[2] + F.col("world")[12 + j]

    boxes = placed.select("scene_id", "prim", *(end(j, f).alias(f"{c}_{n}") for j, c in enumerate(AXES) for n, f in (("min", F.least), ("max", F.greatest))))
    up = boxes.withColumn("root", F.explode(lineage(F.col("prim"))))
    return up.groupBy("scene_id", F.col("root").alias("prim")).agg(*(f(f"{c}_{n}").alias(f"{c}_{n}") for c in AXES for n, f in (("min", F.min), ("max", F.max))))
