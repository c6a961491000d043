"""Quarantine, dead letters and observers of streams against their batch twins."""

import random
import time

from pyspark.sql import functions as F

from editstrata.operators import sequence
from editstrata.streaming import feeds, folds


def arriving(spark, path, rows, schema, cuts):
    """The rows as files of one folder, one micro-batch after the other; yields after each."""
    for n in range(len(cuts) + 1):
        low, high = ([0] + cuts)[n], (cuts + [len(rows)])[n]
        spark.createDataFrame(rows[low:high], schema).coalesce(1).write.parquet(f"file://{path}/parts/{n}")
        (path / "in").mkdir(exist_ok=True)
        for f in (path / "parts" / str(n)).glob("part-*"):
            (path / "in" / f"{n}-{f.name}").write_bytes(f.read_bytes())
        yield feeds.parquet_feed(spark, f"file://{path}/in", schema)


def test_quarantine(spark, tmp_path):
    """Both tables of a stream of attempts are those of the batch operators, over three micro-batches."""
    rnd = random.Random(8)
    rows, upto = [], {}
    for arrival in range(160):
        c = rnd.choice("abcdef")
        step = rnd.choice([1] * 12 + [0, 2])
        upto[c] = upto.get(c, 0) + step
        rows.append((c, "s", upto[c], arrival))
    schema = "client_id string, session_id string, txn_id long, arrival long"
    for stream in arriving(spark, tmp_path, rows, schema, [50, 51]):
        feeds.parted_to(folds.quarantine(stream), f"file://{tmp_path}/good", f"file://{tmp_path}/dead", f"file://{tmp_path}/ck", test=~F.col("quarantined")).awaitTermination(120)
    outcomes = sequence.admitted(spark.createDataFrame(rows, schema))
    keys = ["client_id", "session_id", "txn_id", "arrival", "outcome"]
    want_dead = {tuple(r) for r in sequence.quarantined(outcomes).select(keys).collect()}
    all_rows = {tuple(r) for r in outcomes.select(keys).collect()}
    good, dead = ([tuple(r) for r in spark.read.parquet(f"file://{tmp_path}/{t}").select(keys).collect()] for t in ("good", "dead"))
    assert 0 < len(want_dead) < len(all_rows) == len(good) + len(dead)
    assert set(dead) == want_dead and set(good) == all_rows - want_dead


def test_state_outcomes(spark, tmp_path):
    rnd = random.Random(9)
    rows = [(rnd.choice("ab"), arrival, arrival // 40, rnd.randrange(arrival % 40 + 2)) for arrival in range(120)]
    schema = "client_id string, arrival long, generation long, revision long"
    for stream in arriving(spark, tmp_path, rows, schema, [30, 77]):
        feeds.parted_to(folds.state_outcomes(stream, key="client_id"), f"file://{tmp_path}/good", f"file://{tmp_path}/dead", f"file://{tmp_path}/ck", test=F.col("outcome") == "accepted").awaitTermination(120)
    want = sequence.state_outcomes(spark.createDataFrame(rows, schema), key="client_id")
    read = lambda df: {(r.client_id, r.arrival, r.outcome) for r in df.select("client_id", "arrival", "outcome").collect()}
    good, dead = (read(spark.read.parquet(f"file://{tmp_path}/{t}")) for t in ("good", "dead"))
    assert good == read(want.filter("outcome = 'accepted'")) and dead == read(want.filter("outcome <> 'accepted'"))
    assert {o for *_, o in dead} == {"stale", "repeated"}


def test_observer(spark, tmp_path):
    """Counts by kind of each batch reach the callback; an error in it is kept and the next batch is told."""
    rows = [(q, "set_xform_trs" if q % 3 else "delete_prim", f"/P{q % 5}") for q in range(1, 91)]
    told = []

    def note(number, metrics):
        told.append((number, metrics))
        if number == 0:
            raise ValueError("callback")

    observer = feeds.BatchObserver("edits", note)
    spark.streams.addListener(observer)
    try:
        for stream in arriving(spark, tmp_path, rows, "seq long, k string, prim string", [20]):
            watched = feeds.observed(stream, "edits", ["set_xform_trs", "delete_prim"])
            watched.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
        until = time.time() + 30
        while len(told) < 2 and time.time() < until:
            time.sleep(0.2)
    finally:
        spark.streams.removeListener(observer)
    assert [n for n, _ in told] == [0, 1] and [type(e) for e in observer.errors] == [ValueError]
    assert told[0][1] == {"rows": 20, "prims": 5, "first_seq": 1, "last_seq": 20, "n_set_xform_trs": 14, "n_delete_prim": 6}
    assert (told[1][1]["rows"], told[1][1]["last_seq"], told[1][1]["n_delete_prim"]) == (70, 90, 24)
