"""Changes of the composed scene, batch by batch, from kept state: a batch emits only what it changes.

The state is each layer's last opinion of a field and time, in files by bucket of (scene, prim). A batch reads and writes the buckets of the prims that it touches, and of those that its deletions and
renames reach; the latter are found by their paths alone. Edits that came from others move the baseline and are not told again: a batch's changes are those between the
state with the others' edits and the state with all of them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import lineage
from ..operators import compose, diff

OPINION = ["scene_id", "layer_key", "prim", "field", "time"]


class ChangeFeed:
    """Kept state and changes under a path. One query feeds it; a batch that is run again gives the same changes."""

    def __init__(self, spark: SparkSession, path: str, layers: DataFrame, *, buckets: int = 64) -> None:
        self.spark, self.path, self.layers, self.buckets = spark, path.rstrip("/"), layers, buckets

    def _exists(self, path: str) -> bool:
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)

    def _files(self) -> dict[int, str]:
        """The newest folder of each bucket that has one."""
        if not self._exists(f"{self.path}/manifest"):
            return {}
        rows = self.spark.read.parquet(f"{self.path}/manifest").groupBy("bucket").agg(F.max_by("base", "batch").alias("base")).filter("bucket >= 0").collect()
        return {r["bucket"]: f"{r['base']}/bucket={r['bucket']}" for r in rows}

    def _opinions(self, files: list[str], like: DataFrame) -> DataFrame:
        schema = like.select(*OPINION, "value", "seq").schema
        files = [f for f in files if self._exists(f)]
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    def state(self, like: DataFrame) -> DataFrame:
        """All opinions, in the types of `like`."""
        return self._opinions(list(self._files().values()), like)

    def changes(self, batch: DataFrame, number: int) -> DataFrame:
        """The changes of a batch of edits (scene_id, seq, layer_key, k, prim, field, time, value, and echo: true for those of others), as diff.value_changes gives them; the state moves on."""
        told = f"{self.path}/changes/{number}"
        if self._exists(f"{self.path}/manifest/batch={number}"):
            return self.spark.read.parquet(told)
        batch = batch.withColumn("echo", F.coalesce("echo", F.lit(False)) if "echo" in batch.columns else F.lit(False))
        batch = batch.persist()
        theirs = F.when(F.col("echo"), F.col("seq"))
        values, kills = batch.filter("field <> ''").select(*OPINION, "value", "seq", "echo"), compose._kills(batch, theirs).persist()
        files = self._files()
        touched = values.select("scene_id", "prim").distinct()
        if files and not kills.isEmpty():
            below = self.state(values).select("scene_id", "layer_key", "prim").distinct().withColumn("_above", F.explode(lineage(F.col("prim"))))
            touched = touched.unionByName(below.join(kills, ["scene_id", "layer_key", "_above"], "left_semi").select("scene_id", "prim")).distinct()
        bucket = F.pmod(F.xxhash64("scene_id", "prim"), F.lit(self.buckets)).cast("int").alias("bucket")
        touched = touched.select("*", bucket).persist()
        some = sorted(r["bucket"] for r in touched.select("bucket").distinct().collect())
        old = self._opinions([files[b] for b in some if b in files], values)
        prims = touched.select("scene_id", "prim")
        mine = old.join(prims, ["scene_id", "prim"], "left_semi").withColumn("echo", F.lit(True)).unionByName(values)
        last = mine.groupBy(*OPINION).agg(F.max_by("value", theirs).alias("_old"), F.max(theirs).alias("_at"), F.max_by("value", "seq").alias("_new"), F.max("seq").alias("seq"))
        last = last.join(compose._killed(last, kills), [*compose.LAYER, "prim"], "left")
        last = last.withColumns({"_was": F.coalesce(F.col("_at") > F.coalesce("killed_early", F.lit(-1)), F.lit(False)), "_is": F.col("seq") > F.coalesce("killed", F.lit(-1))})
        seen = last.join(F.broadcast(self.layers.filter("not muted").select("layer_key", "rank")), "layer_key")
        diff.value_changes(compose.compared(seen)).write.mode("overwrite").parquet(told)
        kept = old.join(prims, ["scene_id", "prim"], "left_anti").unionByName(last.filter("_is").select(*OPINION, F.col("_new").alias("value"), "seq").select(old.columns))
        base = f"{self.path}/state/{number}-{uuid.uuid4().hex}"
        kept.select("*", bucket).repartition("bucket").write.partitionBy("bucket").parquet(base)
        rows = [(b, base) for b in some] or [(-1, base)]
        self.spark.createDataFrame(rows, "bucket int, base string").coalesce(1).write.parquet(f"{self.path}/manifest/batch={number}")
        for df in (batch, kills, touched):
            df.unpersist()
        return self.spark.read.parquet(told)

    def fed_by(self, stream: DataFrame, checkpoint: str) -> StreamingQuery:
        """Runs over what a stream of edits holds now, then ends; the changes of its batches are under `changes`."""
        return stream.writeStream.foreachBatch(lambda batch, number: self.changes(batch, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
