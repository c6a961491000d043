"""Running sums and ranks inside large groups, split over many tasks.

A group (a scene) may hold a third of all rows, so it is never one window. Its order is cut in parts: totals by group and part
are small and give what comes before each part, and windows run inside a group's part only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def _parts(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def in_parts(df: DataFrame, by: str, part: str = "_part") -> DataFrame:
    """Adds the number of the row's part: ranges of `by` with about equally many rows, as many as there are shuffle partitions. The bounds are quantiles of all rows, to a quarter of a part."""
    n = _parts(df)
    bounds = sorted({x for x in df.select(F.col(by).cast("double").alias(by)).approxQuantile(by, [k / n for k in range(1, n)], 1 / (4 * n))}) if n > 1 else []

    def place(lo: int, hi: int) -> Column:  # how many of bounds[lo:hi] the row is above, by halves
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(by) > bounds[mid], place(mid + 1, hi)).otherwise(place(lo, mid))

    return df.withColumn(part, place(0, len(bounds)).cast("long"))


def _offsets(totals: DataFrame, key: list[str], names: list[str]) -> DataFrame:
    """Sums over the parts before, by key and part."""
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select(*key, "_part", *(F.coalesce(F.sum(n).over(before), F.lit(0)).alias(f"_before_{n}") for n in names))


def with_running(df: DataFrame, key: list[str], by: str, sums: dict[str, Column], *, own: bool = True) -> DataFrame:
    """Adds by name the sum of each expression over the group's rows up to the row in order of `by` (unique in a group), itself included if `own`."""
    rows = in_parts(df, by).withColumns({f"_x_{n}": x.cast("long") for n, x in sums.items()})
    totals = rows.groupBy(*key, "_part").agg(*(F.sum(f"_x_{n}").alias(n) for n in sums))
    inside = Window.partitionBy(*key, "_part").orderBy(by).rowsBetween(Window.unboundedPreceding, 0 if own else -1)
    out = rows.withColumns({f"_in_{n}": F.coalesce(F.sum(f"_x_{n}").over(inside), F.lit(0)) for n in sums})
    same = [out[k].eqNullSafe(F.col(f"_k_{k}")) for k in key]
    offsets = _offsets(totals, key, list(sums))
    offsets = offsets.select(*(F.col(k).alias(f"_k_{k}") for k in key), F.col("_part").alias("_p"), *(f"_before_{n}" for n in sums))
    out = out.join(offsets, [*same, out["_part"] == F.col("_p")])
    return out.select(*df.columns, *((F.col(f"_before_{n}") + F.col(f"_in_{n}")).alias(n) for n in sums))


def with_runs(df: DataFrame, key: list[str], by: str, value: str, name: str) -> DataFrame:
    """Adds the number of the contiguous run of equal values along `by` in each group, from 1; nulls are equal."""
    inside = Window.partitionBy(*key, "_part").orderBy(by)
    rows = in_parts(df, by).withColumn("_new", F.when(F.lag(by).over(inside).isNull(), 0).when(F.lag(value).over(inside).eqNullSafe(F.col(value)), 0).otherwise(1))
    totals = rows.groupBy(*key, "_part").agg(F.sum("_new").alias("_n"), F.min_by(F.struct(F.col(value).alias("v")), by).alias("_first"), F.max_by(F.struct(F.col(value).alias("v")), by).alias("_last"))
    along = Window.partitionBy(*key).orderBy("_part")
    totals = totals.withColumn("_begins", F.when(F.lag("_last").over(along).isNull(), 1).otherwise((~F.lag("_last").over(along).eqNullSafe(F.col("_first"))).cast("int")))
    totals = totals.withColumn("_base", F.coalesce(F.sum(F.col("_n") + F.col("_begins")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.col("_begins"))
    out = rows.join(totals.select(*key, "_part", "_base"), [*key, "_part"])
    return out.withColumn(name, F.col("_base") + F.sum("_new").over(inside)).select(*df.columns, name)


def with_rank(df: DataFrame, key: list[str], order: list, name: str) -> DataFrame:
    """Adds the row's place, from 1, among the rows of its group in an order of columns or expressions that leaves no ties.

    The rows are dealt by ranges of the whole order and written with their part, so that a second reading cannot see other bounds.
    """
    by = {f"_o{i}": (F.col(o) if isinstance(o, str) else o) for i, o in enumerate(order)}
    dealt = df.withColumns(by).repartitionByRange(_parts(df), *key, *by).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "ranked")
    offsets = _offsets(dealt.groupBy(*key, "_part").agg(F.count("*").alias("n")), key, ["n"])
    inside = Window.partitionBy(*key, "_part").orderBy(*by)
    out = dealt.withColumn("_nth", F.row_number().over(inside)).join(offsets, [*key, "_part"])
    return out.select(*df.columns, (F.col("_before_n") + F.col("_nth")).alias(name))
