"""Contiguous shards of nearly equal bytes, from a global prefix sum of sizes.

Documents are put in order of (doc_id, text_crc32, size) by a range partitioning. The
partitions' totals give the bytes before each partition, a running sum inside the
partition gives each document's place on the global scale of bytes, and the scale is cut
at equal targets. A document goes to the shard in which its middle byte lies, so a shard
misses its target by half of its first and last documents at most.

Only ids, sizes and checksums are shuffled, never texts. The partition's number is
written with the rows, so that a second reading cannot see other bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._store import written


def shards(documents: DataFrame, n_shards: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot for every row of `documents` (doc_id, text).

    size is the text's UTF-8 bytes (null: none) plus one; text_crc32 is the unsigned CRC-32
    of those bytes (null: as of the empty text). shard runs from 0 to n_shards - 1 along the
    order of (doc_id, text_crc32, size), null ids first; slot is the gapless place in the shard.
    Repeated rows are placed one after another. With few or very unequal documents some
    shards stay empty. Other columns are ignored; an empty table gives an empty result.
    """
    order = ["doc_id", "text_crc32", "size"]
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = documents.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(F.encode(text, "utf-8")).alias("text_crc32"))
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(written(slim, "sizes").repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id()), "ordered")

    totals = placed.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"), F.sum("bytes").over(Window.partitionBy()).alias("whole"))
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = placed.select("*", F.sum("size").over(inside).alias("upto"), F.count("*").over(inside).alias("nth")).join(F.broadcast(starts), "part")
    middle = f"(2 * (bytes_before + upto) - size) * {n_shards} div (2 * whole)"
    run = written(run.select("doc_id", "size", "text_crc32", F.expr("rows_before + nth - 1").alias("place"), F.expr(middle).cast("int").alias("shard")), "places")
    firsts = run.groupBy("shard").agg(F.min("place").alias("first"))
    return run.join(F.broadcast(firsts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("place") - F.col("first")).alias("slot"))
