"""Streams over the log by built-in operators, and sinks that commit batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import compose, diff, sequence
from ..operators.running import with_rank
from ..operators.validate import violations
from ..sources.edit_log import parsed_edits
from ..sources.log_store import LogStore


def json_feed(spark: SparkSession, path: str, *, files_per_trigger: int = 100) -> DataFrame:
    """Edits from JSON lines as they arrive; the number of files bounds a micro-batch."""
    return parsed_edits(spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path))


def parquet_feed(spark: SparkSession, path: str, schema: str, *, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dirty_prims(log: DataFrame) -> DataFrame:
    """The last seq of every prim, for update or complete output."""
    return log.groupBy("scene_id", "prim").agg(F.max("seq").alias("last_seq"))


def coalesced_by_time(log: DataFrame, *, every: str = "100 milliseconds", late: str = "1 second") -> DataFrame:
    """Transforms (scene_id, prim, field, value, seq, ts) merged by time: of each window the last value of a field and the first seq; a window is sent when the watermark has passed it."""
    rows = log.filter("k = 'set_xform_trs'")
    rows = rows.withWatermark("ts", late) if rows.isStreaming else rows
    return rows.groupBy(F.window("ts", every).alias("w"), "scene_id", "prim", "field").agg(F.max_by("value", "seq").alias("value"), F.min("seq").alias("seq")).select("scene_id", "prim", "field", "value", "seq", F.col("w.end").alias("due"))


def session_progress(outcomes: DataFrame) -> DataFrame:
    """The greatest committed id by session, for update output."""
    return sequence.progress(outcomes)


def presence(log: DataFrame, *, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Spans in which a client was active: a span ends after a gap without edits. `log` has a timestamp ts."""
    rows = log.withWatermark("ts", late) if log.isStreaming else log
    return rows.groupBy("client_id", F.session_window("ts", gap).alias("span")).agg(F.count("*").alias("n")).select("client_id", F.col("span.start").alias("since"), F.col("span.end").alias("until"), "n")


def _query_of(spark: SparkSession, checkpoint: str) -> str:
    """The id of the query that owns a checkpoint."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]


def committed_to(store: LogStore, stream: DataFrame, checkpoint: str, *, name: str, each: Callable[[DataFrame], tuple[DataFrame, DataFrame | None]] | None = None, once: bool = True, every: str = "1 second") -> StreamingQuery:
    """Appends each micro-batch to the store, at most once by the stream's name and its batch id. once: all that is there now, then end; else every so often.

    The name is the stream's in the store. A query with another checkpoint under a name that is taken fails, as its batches would count as committed.
    """
    if not name:
        raise ValueError("a stream needs a name")

    def save(batch: DataFrame, batch_id: int) -> None:
        records, progress = each(batch) if each else (batch, None)
        store.append(batch_id, records, stream=name, query=_query_of(store.spark, checkpoint), progress=progress)

    writer = stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def parted_to(stream: DataFrame, good: str, dead: str, checkpoint: str, *, test: Column) -> StreamingQuery:
    """Each micro-batch in two tables: rows that pass `test` under `good`, the others, and those of which it is null, among the dead letters under `dead`.

    A batch is a folder of its number that replaces what a failed run of it left, so each row is in one table once after any retry. Runs over what is there now, then ends.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("_pass", F.coalesce(test, F.lit(False))).persist()
        try:
            for path, rows in ((good, batch.filter("_pass")), (dead, batch.filter("not _pass"))):
                rows.drop("_pass").write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={number}")
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def observed(log: DataFrame, name: str, kinds: list[str]) -> DataFrame:
    """`log` with metrics that are counted while it runs: rows, prims (about, to 2 %), the least and greatest seq, and the rows of each kind given as n_<kind>. No pass of its own."""
    counts = [F.count(F.when(F.col("k") == k, True)).alias(f"n_{k}") for k in kinds]
    return log.observe(name, F.count(F.lit(1)).alias("rows"), F.approx_count_distinct("prim", 0.02).alias("prims"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), *counts)


class BatchObserver(StreamingQueryListener):
    """Calls back after each micro-batch with what observed() counted under a name: told(batch id, metrics). Batches without rows are not told.

    Spark reports a batch after it was committed, so what is told was applied. A batch that a restarted query runs again is told again under its number.
    An error in the callback is kept in `errors` and stops neither the stream nor later calls.
    """

    def __init__(self, name: str, told: Callable[[int, dict], None]) -> None:
        self.name, self.told, self.errors = name, told, []

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None or not row["rows"]:
            return
        try:
            self.told(event.progress.batchId, row.asDict())
        except Exception as e:
            self.errors.append(e)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def split_valid(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edits of transactions without a fault, and the faults of the others; one bad transaction does not touch its neighbours."""
    faults = violations(batch)
    txn = ["client_id", "session_id", "txn_id"]
    return batch.join(faults.select(*txn).distinct(), txn, "left_anti"), faults


def numbered(batch: DataFrame, heads: DataFrame, order: list[str]) -> DataFrame:
    """Gives the rows of a micro-batch their seq after each scene's head; `order` leaves no ties."""
    rows = with_rank(batch.drop("seq"), ["scene_id"], order, "_nth")
    return rows.join(heads.select("scene_id", F.col("max_seq").alias("_head")), "scene_id", "left").withColumn("seq", F.coalesce("_head", F.lit(0)) + F.col("_nth")).drop("_head", "_nth")


def changes_after(before: DataFrame, log: DataFrame, layers: DataFrame) -> DataFrame:
    """What a suffix of the log changes in a composed state; rows that others sent are part of `before`, so they are not told again."""
    after = compose.composed(log, layers)
    return diff.state_diff(before, after, ["scene_id", "prim", "field", "time"], ["value"])


def ready(applied: DataFrame, *, head: int, epoch: int) -> DataFrame:
    """Whether each receiver has applied the advertised head of the same epoch."""
    return applied.withColumn("ready", (F.col("epoch") == epoch) & (F.col("applied_seq") >= head))


def handover(log: DataFrame, head: int) -> tuple[DataFrame, DataFrame]:
    """History up to a frozen head, and the rows after it; together each row once."""
    return log.filter(F.col("seq") <= head), log.filter(F.col("seq") > head)
