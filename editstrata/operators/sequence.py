"""Operators on the order of rows: runs, segments, contracts, admission, batches."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .running import with_rank, with_running, with_runs


def runs(log: DataFrame, by: str = "layer_key", within: tuple[str, ...] = ("scene_id",)) -> DataFrame:
    """Adds run: number of the contiguous run of equal values along seq."""
    return with_runs(log, list(within), "seq", by, "run")


def segments(log: DataFrame) -> DataFrame:
    """Adds segment: deletions, renames and sample barriers stand alone and split the log."""
    alone = F.col("k").isin("delete_prim", "rename_prim", "erase_time_samples")
    return with_running(log, ["scene_id"], "seq", {"_upto": alone}).withColumn("segment", 2 * F.col("_upto") - alone.cast("int")).drop("_upto")


def dependency_order(log: DataFrame) -> DataFrame:
    """Adds nth: the order of application inside segments: creates by depth, other structural edits, values."""
    from ..functions.paths import depth
    from .scans import with_tier

    deep = F.when(F.col("tier") == 0, depth(F.col("prim"))).otherwise(0)
    return with_rank(with_tier(segments(log)), ["scene_id"], ["segment", "tier", deep, "seq"], "nth")


def contract(rows: DataFrame, *, key: str, last_seq: int = 0) -> DataFrame:
    """The rows of each stream that extend last_seq without a gap, each number once (its first arrival)."""
    fresh = rows.filter(F.col("seq") > last_seq)
    first = fresh.groupBy(key, "seq").agg(F.min("arrival").alias("arrival"))
    along = Window.partitionBy(key).orderBy("seq")
    return first.withColumn("_nth", F.row_number().over(along)).filter(F.col("seq") == last_seq + F.col("_nth")).drop("_nth")


def latest_epoch(rows: DataFrame, *, key: str) -> DataFrame:
    """Rows after the last resync of each stream; resync rows themselves go. `rows`: key, arrival, resync."""
    cut = rows.filter("resync").groupBy(key).agg(F.max("arrival").alias("_cut"))
    return rows.filter("not resync").join(cut, key, "left").filter("_cut is null or arrival > _cut").drop("_cut")


_ADMITTED = "client_id string, session_id string, txn_id long, arrival long, outcome string, expected long"


def admitted(attempts: DataFrame, committed: DataFrame | None = None) -> DataFrame:
    """client_id, session_id, txn_id, arrival, outcome (committed, duplicate, rejected) and expected of each attempt.

    In order of arrival an id at or below the session's committed one is a duplicate, the next one commits, any other is
    rejected and changes nothing, so a later arrival may fill the gap. This is a fold by session: sessions are dealt
    over the cluster and read one row at a time; a session's state is one number.
    """
    start = attempts.select("client_id", "session_id", "txn_id", "arrival")
    base = committed.select("client_id", "session_id", "committed_through") if committed is not None else None
    rows = start.join(base, ["client_id", "session_id"], "left") if base is not None else start.withColumn("committed_through", F.lit(0).cast("long"))
    rows = rows.withColumn("committed_through", F.coalesce("committed_through", F.lit(0)).cast("long"))
    dealt = rows.repartition("client_id", "session_id").sortWithinPartitions("client_id", "session_id", "arrival")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, through = None, 0
        for f in frames:
            outcome, expected = [], []
            for c, s, t, base_id in zip(f.client_id, f.session_id, f.txn_id, f.committed_through, strict=True):
                if (c, s) != session:
                    session, through = (c, s), base_id
                expected.append(through + 1)
                if t <= through:
                    outcome.append("duplicate")
                elif t == through + 1:
                    outcome.append("committed")
                    through = t
                else:
                    outcome.append("rejected")
            yield f[["client_id", "session_id", "txn_id", "arrival"]].assign(outcome=outcome, expected=expected)

    return dealt.mapInPandas(fold, _ADMITTED)


def progress(outcomes: DataFrame) -> DataFrame:
    """Committed id by session."""
    return outcomes.filter("outcome = 'committed'").groupBy("client_id", "session_id").agg(F.max("txn_id").alias("committed_through"))


def retry_outcomes(attempts: DataFrame, committed: DataFrame) -> DataFrame:
    """What durable progress alone says of each attempt: duplicate, next or gap."""
    at = F.coalesce("committed_through", F.lit(0))
    rows = attempts.join(committed, ["client_id", "session_id"], "left")
    return rows.withColumn("outcome", F.when(F.col("txn_id") <= at, "duplicate").when(F.col("txn_id") == at + 1, "next").otherwise("gap")).withColumn("expected", at + 1).drop("committed_through")


def batches(queue: DataFrame, size: int = 256) -> DataFrame:
    """Adds batch: at most `size` transactions, and a payload load ends its batch. `queue`: scene_id, arrival, loads.

    Both the loads and the transactions before each one are counted in parts of the arrivals; what is ranked is one row a load.
    """
    rows = with_running(queue, ["scene_id"], "arrival", {"_load": F.col("loads"), "_at": F.lit(1)}, own=False)
    loads = rows.groupBy("scene_id", "_load").agg(F.min("_at").alias("_from"), F.ceil(F.count("*") / size).alias("_n"))
    loads = with_running(loads, ["scene_id"], "_load", {"_before": F.col("_n")}, own=False)
    out = rows.join(loads, ["scene_id", "_load"])
    return out.withColumn("batch", F.col("_before") + F.floor((F.col("_at") - F.col("_from")) / size) + 1).select(*queue.columns, "batch")


def fresh_states(states: DataFrame, *, key: str) -> DataFrame:
    """States that advance: a new generation restarts, inside one only greater revisions count. `states`: key, arrival, generation, revision."""
    along = Window.partitionBy(key).orderBy("arrival")
    new = F.when(F.lag("generation").over(along).eqNullSafe(F.col("generation")), 0).otherwise(1)
    rows = states.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    before = F.max("revision").over(Window.partitionBy(key, "_run").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("_before", before).filter("_before is null or revision > _before").drop("_new", "_run", "_before")


def state_outcomes(states: DataFrame, *, key: str) -> DataFrame:
    """Every state with its outcome: accepted, or why it goes to the dead letters: stale (an older revision) or repeated (the same one). `states` as for fresh_states."""
    along = Window.partitionBy(key).orderBy("arrival")
    new = F.when(F.lag("generation").over(along).eqNullSafe(F.col("generation")), 0).otherwise(1)
    rows = states.withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    before = F.max("revision").over(Window.partitionBy(key, "_run").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    outcome = F.when(before.isNull() | (F.col("revision") > before), "accepted").when(F.col("revision") == before, "repeated").otherwise("stale")
    return rows.withColumn("outcome", outcome).drop("_new", "_run")


def swaps(requests: DataFrame, *, generation: str | None = None, revisions: DataFrame | None = None) -> DataFrame:
    """Compare-and-set by parent, in order of arrival: a request passes if its base is the parent's revision, which then grows by one.

    `requests`: parent_key, arrival, base, and generation where one is given; requests of another generation fail and change nothing.
    `revisions`: parent_key and revision, where the parents stand now; a parent without one stands at 0.
    Adds accepted and current (the revision before). Folded by parent, one number of state.
    """
    known = F.lit(True) if generation is None else F.coalesce(F.col("generation") == generation, F.lit(False))
    start = F.lit(0).cast("long")
    if revisions is not None:
        requests, start = requests.join(revisions.select("parent_key", F.col("revision").alias("_stands")), "parent_key", "left"), F.coalesce("_stands", start)
    dealt = requests.select("parent_key", "arrival", "base", known.alias("known"), start.alias("start")).repartition("parent_key").sortWithinPartitions("parent_key", "arrival")

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent, revision = None, 0
        for f in frames:
            ok, seen = [], []
            for p, b, k, first in zip(f.parent_key, f.base, f.known, f.start, strict=True):
                if p != parent:
                    parent, revision = p, first
                seen.append(revision)
                ok.append(bool(k) and b == revision)
                revision += int(ok[-1])
            yield f[["parent_key", "arrival", "base"]].assign(accepted=ok, current=seen)

    return dealt.mapInPandas(fold, "parent_key string, arrival long, base long, accepted boolean, current long")


def live_generation(rows: DataFrame, *, key: str) -> DataFrame:
    """Rows of each receiver's newest connection."""
    newest = rows.groupBy(key).agg(F.max("generation").alias("_newest"))
    return rows.join(newest, key).filter("generation = _newest").drop("_newest")


def replay_plans(cursors: DataFrame, *, instance: str, epoch: int, head: int | Column) -> DataFrame:
    """Where each receiver's replay begins and why: resumed, or from 1 as the instance, the epoch or the cursor does not fit. `head` is the log's, a number or a column."""
    reason = F.when(~F.col("instance").eqNullSafe(F.lit(instance)), "other_instance").when(~F.col("epoch").eqNullSafe(F.lit(epoch)), "other_epoch").when(F.col("sync_from") > head + 1, "ahead_of_head").otherwise("resumed")
    return cursors.withColumn("reason", reason).withColumn("first", F.when(F.col("reason") == "resumed", F.col("sync_from")).otherwise(F.lit(1)))


def quarantined(attempts: DataFrame) -> DataFrame:
    """The first rejected transaction of each session and all that follow it. `attempts`: client_id, session_id, txn_id, arrival, outcome."""
    bad = attempts.filter("outcome = 'rejected'").groupBy("client_id", "session_id").agg(F.min("arrival").alias("_bad"))
    return attempts.join(bad, ["client_id", "session_id"]).filter("arrival >= _bad").drop("_bad")


def incidents(rows: DataFrame) -> DataFrame:
    """Per session of quarantined transactions: how many, how many events, and the first and last id."""
    return rows.groupBy("client_id", "session_id").agg(F.count("*").alias("transactions"), F.sum("n_events").alias("events"), F.min("txn_id").alias("first_txn"), F.max("txn_id").alias("last_txn"))


def acknowledged(submitted: DataFrame, acks: DataFrame) -> DataFrame:
    """Whether each submitted transaction is closed: an ack closes all ids up to its own."""
    last = acks.groupBy("client_id", "session_id").agg(F.max("txn_id").alias("_ack"))
    return submitted.join(last, ["client_id", "session_id"], "left").withColumn("closed", F.coalesce(F.col("txn_id") <= F.col("_ack"), F.lit(False))).drop("_ack")


def ack_faults(submitted: DataFrame, acks: DataFrame) -> DataFrame:
    """Acknowledgements (client_id, session_id, txn_id, arrival) that end their session: ahead of the last id submitted, or behind an earlier one."""
    last = submitted.groupBy("client_id", "session_id").agg(F.max("txn_id").alias("_last"))
    along = Window.partitionBy("client_id", "session_id").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    rows = acks.withColumn("_before", F.max("txn_id").over(along)).join(last, ["client_id", "session_id"], "left")
    fault = F.when(F.col("txn_id") > F.coalesce("_last", F.lit(0)), "ahead").when(F.col("txn_id") < F.col("_before"), "behind")
    return rows.withColumn("fault", fault).filter("fault is not null").drop("_before", "_last")


def merged(*streams: DataFrame) -> DataFrame:
    """Edits of several streams in order of seq by scene, with nth; an edit that several hold is taken once."""
    from functools import reduce

    rows = reduce(DataFrame.unionByName, streams).dropDuplicates(["scene_id", "seq"])
    return with_rank(rows, ["scene_id"], ["seq"], "nth")
