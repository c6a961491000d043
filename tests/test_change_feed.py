"""Changes from kept state, over random micro-batches, against the states before and after."""

import random

import pytest
from pyspark.sql import functions as F

from editstrata.operators import compose, diff
from editstrata.streaming import feeds
from editstrata.streaming.changes import ChangeFeed

from test_composition import LAYERS, SCHEMA, fold, random_log


def expected(before, after):
    return {k: ("create" if k not in before else "remove" if k not in after else "change", before.get(k), after.get(k)) for k in before.keys() | after.keys() if (k in before, before.get(k)) != (k in after, after.get(k))}


@pytest.mark.parametrize("with_echo", [False, True])
def test_batches(spark, tmp_path, with_echo):
    """Each batch tells what turns the one state into the other; others' edits move the baseline and are not told. A batch that is run again changes nothing."""
    rnd = random.Random(6)
    rows = [(*r, with_echo and rnd.random() < 0.4) for r in random_log(21, 240)]
    layers = spark.createDataFrame(LAYERS, "layer_key string, rank int, muted boolean")
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed", layers, buckets=5)
    cuts = [0, 3, 90, 91, 170, 240]
    for n, (low, high) in enumerate(zip(cuts, cuts[1:], strict=False)):
        batch = [r for r in rows if low < r[1] <= high]
        frame = spark.createDataFrame(batch, SCHEMA + ", echo boolean")
        before = fold([r[:8] for r in rows if r[1] <= low or r[1] <= high and r[8]])[0]
        want = expected(before, fold([r[:8] for r in rows if r[1] <= high])[0])
        for again in range(2 if n == 1 else 1):
            got = {(r.scene_id, r.prim, r.field, r.time): (r.change, r.old_value, r.new_value) for r in feed.changes(frame, n).collect()}
            assert got == want, (n, again)
    said = fold([r[:8] for r in rows])[1]
    assert {(r.scene_id, r.layer_key, r.prim, r.field, r.time): r.value for r in feed.state(frame).collect()} == said


def test_stream(spark, tmp_path):
    """As a sink of a stream: the changes of all batches lead from nothing to the composed scene."""
    rows = random_log(5, 120)
    layers = spark.createDataFrame(LAYERS, "layer_key string, rank int, muted boolean")
    for n in range(3):
        spark.createDataFrame([r for r in rows if (r[1] - 1) // 40 == n], SCHEMA).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    feed = ChangeFeed(spark, f"file://{tmp_path}/feed", layers, buckets=3)
    feed.fed_by(feeds.parquet_feed(spark, f"file://{tmp_path}/in", SCHEMA), f"file://{tmp_path}/ck").awaitTermination(200)
    state = {}
    for r in spark.read.parquet(f"file://{tmp_path}/feed/changes/0").collect():
        state[r.scene_id, r.prim, r.field, r.time] = r.new_value
    want = compose.composed(spark.createDataFrame(rows, SCHEMA), layers)
    assert state == {(r.scene_id, r.prim, r.field, r.time): r.value for r in want.collect()}
    assert diff.value_changes(compose.composed_twice(spark.createDataFrame(rows, SCHEMA), layers, 0)).filter(F.col("change") != "create").count() == 0
