"""The log store, and stateful streams against their batch twins."""

import random
import time

import pytest
from pyspark.sql import functions as F

from editstrata.operators import reduce, sequence
from editstrata.plans.order_queries import arrivals
from editstrata.sources.edit_log import EDIT_SCHEMA, dumped, edits, json_lines, stack_samples
from editstrata.sources.log_store import LogStore, StaleToken
from editstrata.streaming import feeds, folds


def drained(stream, path, name, spark, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"{path}/{name}").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def test_store(spark, tmp_path, sf_dir):
    store = LogStore(spark, f"file://{tmp_path}/log")
    log = edits(spark, sf_dir).select("scene_id", "seq", "k", "prim", "value")
    assert store.read() is None and store.token().head == 0
    progress = spark.createDataFrame([("c", "s", 5)], "client_id string, session_id string, committed_through long")
    assert store.append(1, log.filter("seq <= 100"), progress=progress)
    assert not store.append(1, log.filter("seq <= 999"))
    assert store.append(2, log.filter("seq between 101 and 150"))
    assert store.read().count() == 150 and store.token().head == 150
    assert sorted(r.seq for r in store.read(90, 110).collect()) == list(range(90, 111))
    old = store.token()
    new = store.compact(lambda x: x.filter("seq % 2 = 0"))
    assert (new.version, new.epoch, store.read().count()) == (old.version + 1, old.epoch + 1, 75)
    with pytest.raises(StaleToken):
        store.replace(log.limit(1), expected=old)
    # retries of batches that went into a replaced version, and new batches of another stream under old numbers
    assert not store.append(1, log.filter("seq <= 100")) and not store.append(2, log.filter("seq between 101 and 150"))
    assert store.append(0, log.filter("seq between 201 and 210")) and not store.append(0, log.filter("seq between 201 and 210"))
    assert store.append(1, log.filter("seq between 211 and 220"), stream="other")
    assert store.read().count() == 95 == store.read().select("seq").distinct().count()
    # a batch that arrives while the log is reduced is not lost
    late = []

    def slow(x):
        if not late:
            late.append(store.append(3, log.filter("seq between 301 and 305")))
        return x.filter("seq % 4 = 0")

    store.compact(slow)
    assert store.read().filter("seq between 301 and 305").count() == 1 and store.read().filter("seq % 4 <> 0").isEmpty()
    assert not store.append(3, log.filter("seq between 301 and 305"))
    now = store.token()
    assert store.compact(slow) == now
    assert store.replace_if(lambda x: x.count() < 5, log.limit(3)) == (False, now)
    store.purge()
    assert not store.append(2, log) and store.read().count() == 0 and store.progress().first().committed_through == 5


def test_json_and_dump(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"k": "ensure_prim", "prim": "/A", "seq": 1, "type_name": "Mesh"}\n{"k": "set_xform_trs", "prim": "/A", "seq": 2, "vals": {"t": 1.5}}\n')
    rows = json_lines(spark, f"file://{tmp_path}/a.jsonl").orderBy("seq").collect()
    assert rows[0].type_name == "Mesh" and rows[1].vals["t"].toPython() == 1.5 and rows[1].type_name is None and rows[1].rescued is None
    assert '"vals":{"t":1.5}' in dumped(json_lines(spark, f"file://{tmp_path}/a.jsonl")).orderBy("seq").collect()[1].extras
    (tmp_path / "s.txt").write_text("main (a.py:1);f (b.py:2) 7\nbroken\n;x 3\n")
    assert [(r.frames[-1], r.samples) for r in stack_samples(spark, f"file://{tmp_path}/s.txt").collect()] == [("f (b.py:2)", 7), ("x", 3)]


def test_admission_stream(spark, tmp_path, sf_dir):
    """Two micro-batches of a session's attempts give what the batch fold gives."""
    rows = arrivals(spark, sf_dir).filter("client_id < 'c2'").drop("n_events")
    middle = rows.approxQuantile("arrival", [0.5], 0.0)[0]
    for n, part in enumerate((rows.filter(f"arrival <= {middle}"), rows.filter(f"arrival > {middle}"))):
        part.coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in/p{n}")
    want = {(r.client_id, r.session_id, r.txn_id, r.arrival): (r.outcome, r.expected) for r in sequence.admitted(rows).collect()}
    got = {}
    for n in (0, 1):
        (tmp_path / "all").mkdir(exist_ok=True)
        for f in (tmp_path / f"in/p{n}").glob("part-*"):
            (tmp_path / "all" / f"{n}-{f.name}").write_bytes(f.read_bytes())
        stream = feeds.parquet_feed(spark, f"file://{tmp_path}/all", "client_id string, session_id string, txn_id long, arrival long")
        out = f"file://{tmp_path}/out"
        q = folds.admission(stream).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {(r.client_id, r.session_id, r.txn_id, r.arrival): (r.outcome, r.expected) for r in spark.read.parquet(f"file://{tmp_path}/out").collect()}
    assert got == want


def test_limits_and_playback(spark, tmp_path):
    rnd = random.Random(2)
    t, rows = 0.0, []
    for _ in range(40):
        t += rnd.choice([0.0, 0.1, 0.9])
        rows.append((f"c{rnd.randrange(2)}", t + len(rows) * 1e-6))
    spark.createDataFrame(rows, "client_id string, arrival double").coalesce(1).write.parquet(f"file://{tmp_path}/r")
    got = drained(folds.rate_limit(feeds.parquet_feed(spark, f"file://{tmp_path}/r", "client_id string, arrival double"), rate=2.0, burst=3), f"file://{tmp_path}", "limits", spark)
    want, held = {}, {}
    for c, at in sorted(rows, key=lambda r: r[1]):
        tokens, last = held.get(c, (3.0, at))
        tokens = min(3.0, tokens + (at - last) * 2)
        want[c, at] = 0.0 if tokens >= 1 else (1 - tokens) / 2
        held[c] = (tokens - 1 if tokens >= 1 else tokens, at)
    assert {(r.client_id, r.arrival): pytest.approx(r.wait) for r in got.collect()} == want
    moves = [(1, "a", "claim", 5.0, None), (2, "b", "play", None, None), (3, "a", "play", None, None), (4, "b", "claim", None, None), (5, "a", "set_rate", None, 2.0), (6, "a", "stop", None, None), (7, "a", "release", None, None), (8, "b", "claim", None, None), (9, "b", "jump", None, None)]
    schema = "scene_id string, seq long, client_id string, action string, time double, rate double"
    spark.createDataFrame([("s", *m) for m in moves], schema).coalesce(1).write.parquet(f"file://{tmp_path}/p")
    rows = sorted(drained(folds.playback(feeds.parquet_feed(spark, f"file://{tmp_path}/p", schema)), f"file://{tmp_path}", "plays", spark).collect(), key=lambda r: r.seq)
    assert [r.ok for r in rows] == [True, False, True, False, True, True, True, True, False]
    assert [r.leader for r in rows] == ["a"] * 6 + ["", "b", "b"]
    assert (rows[2].time, rows[2].playing, rows[5].time, rows[5].playing, rows[4].rate) == (5.0, True, 0.0, False, 2.0)


def test_receiver_stream(spark, tmp_path):
    """Generations, a gap, a resync, a full inbox, in two micro-batches."""
    schema = "receiver_id string, kind string, generation long, seq long, arrival long"
    parts = [[("event", 1, 1), ("event", 1, 2), ("event", 1, 2), ("event", 1, 5), ("event", 2, 3), ("event", 1, 0)], [("connect", 2, 0), ("event", 1, 3), ("event", 2, 3), ("event", 2, 4), ("taken", 2, 2), ("event", 2, 4), ("resync", 2, 0), ("event", 2, 1)]]
    arrival = 0
    for n, part in enumerate(parts):
        rows = [("r", k, g, s, arrival + i) for i, (k, g, s) in enumerate(part)]
        arrival += len(part)
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/r/p{n}")
        (tmp_path / "in").mkdir(exist_ok=True)
        for f in (tmp_path / f"r/p{n}").glob("part-*"):
            (tmp_path / "in" / f"{n}-{f.name}").write_bytes(f.read_bytes())
        q = folds.receiver_contract(feeds.parquet_feed(spark, f"file://{tmp_path}/in", schema), capacity=3).writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = sorted(spark.read.parquet(f"file://{tmp_path}/out").collect(), key=lambda r: r.arrival)
    assert [r.outcome for r in got] == ["accepted", "accepted", "duplicate", "gap", "stale", "invalid", "accepted", "stale", "accepted", "full", "accepted", "accepted", "accepted", "full"]


def test_coalescing_window(spark, tmp_path):
    """What comes out over random micro-batches is what the batch operator gives by session; a timer sends what nothing follows."""
    rnd = random.Random(4)
    schema = "client_id string, session_id string, seq long, k string, prim string, time double, field string, value double"
    rows = [(rnd.choice("ab"), "s", q, *(("set_xform_trs", rnd.choice(["/A", "/B"]), rnd.choice([None, 1.0]), rnd.choice("ts"), float(q)) if rnd.random() < 0.8 else ("delete_prim", "/A", None, "", None))) for q in range(1, 121)]
    rows += [(c, "s", 200, "delete_prim", "/Z", None, "", None) for c in "ab"]
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else a run over what is there would wait for the timer
    for n, (low, high) in enumerate(((0, 31), (31, 33), (33, 90), (90, 999))):
        spark.createDataFrame([r for r in rows if low < r[2] <= high], schema).coalesce(1).write.parquet(f"file://{tmp_path}/c/p{n}")
        (tmp_path / "cin").mkdir(exist_ok=True)
        for f in (tmp_path / f"c/p{n}").glob("part-*"):
            (tmp_path / "cin" / f"{n}-{f.name}").write_bytes(f.read_bytes())
        q = folds.coalescing_window(feeds.parquet_feed(spark, f"file://{tmp_path}/cin", schema), seconds=3600).writeStream.format("parquet").option("path", f"file://{tmp_path}/cout").option("checkpointLocation", f"file://{tmp_path}/cck").trigger(availableNow=True).start()
        q.awaitTermination(120)
    spark.conf.unset("spark.sql.streaming.noDataMicroBatches.enabled")
    got = spark.read.parquet(f"file://{tmp_path}/cout").collect()
    log = spark.createDataFrame(rows, schema).withColumn("scene_id", F.col("client_id"))
    want = {(r.scene_id, r.seq, r.prim, r.time, r.field, r.value) for r in reduce.coalesced_transforms(log).collect()}
    assert {(r.client_id, r.seq, r.prim, r.time, r.field, r.value) for r in got if r.k == "set_xform_trs"} == want
    assert sorted((r.client_id, r.seq) for r in got if r.k != "set_xform_trs") == sorted((r[0], r[2]) for r in rows if r[3] != "set_xform_trs")
    spark.createDataFrame([("a", "s", 1, "set_xform_trs", "/A", None, "t", 1.0)], schema).coalesce(1).write.parquet(f"file://{tmp_path}/tin")
    q = folds.coalescing_window(feeds.parquet_feed(spark, f"file://{tmp_path}/tin", schema), seconds=1).writeStream.format("memory").queryName("timed").option("checkpointLocation", f"file://{tmp_path}/tck").trigger(processingTime="500 milliseconds").start()
    for _ in range(60):
        if spark.table("timed").count():
            break
        time.sleep(1)
    q.stop()
    assert [(r.seq, r.value) for r in spark.table("timed").collect()] == [(1, 1.0)]


def test_committed_feed(spark, tmp_path, sf_dir):
    """A feed drained into the store, twice: the second run finds nothing new; dirty prims equal the batch result."""
    log = edits(spark, sf_dir).select("scene_id", "seq", "k", "prim", "client_id", "ts")
    log.repartition(3).write.parquet(f"file://{tmp_path}/in")
    store = LogStore(spark, f"file://{tmp_path}/log")
    schema = "scene_id string, seq long, k string, prim string, client_id string, ts timestamp"
    for _ in range(2):
        feeds.committed_to(store, feeds.parquet_feed(spark, f"file://{tmp_path}/in", schema, files_per_trigger=1), f"file://{tmp_path}/ck", name="feed").awaitTermination(120)
    assert store.read().count() == log.count() == store.read().select("seq").distinct().count()
    got = drained(feeds.dirty_prims(feeds.parquet_feed(spark, f"file://{tmp_path}/in", schema)), f"file://{tmp_path}", "dirty", spark, "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, feeds.dirty_prims(log).collect()))
    assert feeds.presence(log).agg({"n": "sum"}).first()[0] == log.count()
    good, bad = feeds.split_valid(json_like(spark))
    assert [r.seq for r in good.collect()] == [3] and [r.rule for r in bad.collect()] == ["bad_prim"]


def json_like(spark):
    rows = [{"scene_id": "s", "seq": 1, "client_id": "c", "session_id": "x", "txn_id": 1, "k": "delete_prim", "prim": "/A"}, {"scene_id": "s", "seq": 2, "client_id": "c", "session_id": "x", "txn_id": 1, "k": "delete_prim", "prim": "bad"}, {"scene_id": "s", "seq": 3, "client_id": "c", "session_id": "x", "txn_id": 2, "k": "delete_prim", "prim": "/A"}]
    return spark.createDataFrame(rows, EDIT_SCHEMA)


def test_two_feeds_and_racing_writers(spark, tmp_path):
    """Two feeds keep all rows; a second checkpoint under a taken name fails; of two writers with one state the later appends after, or may not replace."""
    for n in (0, 1):
        spark.range(10).selectExpr("'s' as scene_id", f"id + {10 * n + 1} as seq").coalesce(1).write.parquet(f"file://{tmp_path}/in{n}")
    store, schema = LogStore(spark, f"file://{tmp_path}/log"), "scene_id string, seq long"
    for n in (0, 1):
        feeds.committed_to(store, feeds.parquet_feed(spark, f"file://{tmp_path}/in{n}", schema), f"file://{tmp_path}/ck{n}", name=f"feed{n}").awaitTermination(120)
    assert sorted(r.seq for r in store.read().collect()) == list(range(1, 21))
    with pytest.raises(ValueError):
        feeds.committed_to(store, feeds.parquet_feed(spark, f"file://{tmp_path}/in0", schema), f"file://{tmp_path}/ck2", name="")
    with pytest.raises(Exception, match="OtherQuery|belongs to another"):
        feeds.committed_to(store, feeds.parquet_feed(spark, f"file://{tmp_path}/in0", schema), f"file://{tmp_path}/ck2", name="feed0").awaitTermination(120)
    rows = spark.createDataFrame([("s", 99)], schema)
    other, seen = LogStore(spark, store.path), store._seen
    first = seen()

    def late():  # the state as it was before the other writer's commit, once
        store._seen = seen
        return first

    start = store.token()
    assert other.append(7, rows, stream="other")
    store._seen = late
    with pytest.raises(StaleToken):
        store.replace(rows, expected=start)
    store._seen = late
    assert store.append(8, rows, stream="third") and store.read().count() == 22 and store.manifest().count() == 4
