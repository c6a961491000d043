"""Stateful stream operators; each folds the rows of a key in order of arrival.

The state of a key is a few numbers. Inside a micro-batch rows come in any order, so they are sorted by
arrival first; across batches the source's order holds. The batch twins are in operators.sequence.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

ADMITTED = "client_id string, session_id string, txn_id long, arrival long, outcome string, expected long"
QUARANTINED = ADMITTED + ", quarantined boolean"
COALESCED = "client_id string, session_id string, seq long, k string, prim string, time double, field string, value double"
RECEIVED = "receiver_id string, kind string, generation long, seq long, arrival long, outcome string"
LIMITED = "client_id string, arrival double, wait double"
PLAYED = "scene_id string, seq long, client_id string, action string, ok boolean, leader string, time double, playing boolean, rate double"


def _in_order(frames: Iterator[pd.DataFrame], by: str) -> pd.DataFrame:
    """One key's rows of one micro-batch; a trigger's size bounds them."""
    return pd.concat(list(frames)).sort_values(by, kind="stable")


def admission(attempts: DataFrame) -> DataFrame:
    """Committed, duplicate or rejected for each attempt, by session; the state is the committed id and survives restarts."""

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        through = state.get[0] if state.exists else 0
        rows = _in_order(frames, "arrival")
        outcome, expected = [], []
        for t in rows.txn_id:
            expected.append(through + 1)
            outcome.append("duplicate" if t <= through else "committed" if t == through + 1 else "rejected")
            through = max(through, t) if outcome[-1] == "committed" else through
        state.update((through,))
        yield rows[["client_id", "session_id", "txn_id", "arrival"]].assign(outcome=outcome, expected=expected)

    return attempts.groupBy("client_id", "session_id").applyInPandasWithState(fold, ADMITTED, "through long", "append", GroupStateTimeout.NoTimeout)


def quarantine(attempts: DataFrame) -> DataFrame:
    """admission(), and whether the attempt is quarantined: from its session's first rejected one on, all are. The state is the committed id and whether the session is bad."""

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        through, bad = state.get if state.exists else (0, False)
        rows = _in_order(frames, "arrival")
        outcome, expected, held = [], [], []
        for t in rows.txn_id:
            expected.append(through + 1)
            outcome.append("duplicate" if t <= through else "committed" if t == through + 1 else "rejected")
            through = max(through, t) if outcome[-1] == "committed" else through
            bad = bad or outcome[-1] == "rejected"
            held.append(bad)
        state.update((int(through), bool(bad)))
        yield rows[["client_id", "session_id", "txn_id", "arrival"]].assign(outcome=outcome, expected=expected, quarantined=held)

    return attempts.groupBy("client_id", "session_id").applyInPandasWithState(fold, QUARANTINED, "through long, bad boolean", "append", GroupStateTimeout.NoTimeout)


def state_outcomes(states: DataFrame, *, key: str) -> DataFrame:
    """sequence.state_outcomes() as a stream: each state (key, arrival, generation, revision) with before, the greatest revision of its generation's run, and its outcome.

    Another generation than the last arrival's begins a run anew. `key` is a string column; a key's state is two numbers.
    """

    def fold(name: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        generation, top = state.get if state.exists else (None, None)
        rows = _in_order(frames, "arrival")
        before, outcome = [], []
        for g, r in zip(rows.generation, rows.revision, strict=True):
            if g != generation:
                generation, top = int(g), None
            before.append(top)
            outcome.append("accepted" if top is None or r > top else "repeated" if r == top else "stale")
            top = int(r) if top is None else max(top, int(r))
        state.update((generation, top))
        yield rows[[key, "arrival", "generation", "revision"]].assign(before=pd.array(before, dtype="Int64"), outcome=outcome)

    return states.groupBy(key).applyInPandasWithState(fold, f"{key} string, arrival long, generation long, revision long, before long, outcome string", "generation long, top long", "append", GroupStateTimeout.NoTimeout)


def receiver_contract(rows: DataFrame, *, capacity: int = 10_000) -> DataFrame:
    """Outcome of each row (receiver_id, kind, generation, seq, arrival) that reaches a receiver: accepted, invalid, stale, duplicate, gap or full.

    A connect row makes its generation the receiver's; rows of every other generation, older or newer, are stale. Events extend the numbers by one, over a
    reconnection too; a resync row lets them begin at 1 again. Both wait in an inbox of `capacity`; a taken row removes as many as its seq says. What finds it full is not
    accepted, and its number stays expected. Without a connect row before, the first row's generation counts.
    """

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        got = _in_order(frames, "arrival")
        generation, last, held = state.get if state.exists else (int(got.generation.iloc[0]), 0, 0)
        outcome = []
        for kind, g, s in zip(got.kind, got.generation, got.seq, strict=True):
            told = "accepted"
            if kind == "connect":
                generation = int(g)
            elif kind == "event" and s < 1:
                told = "invalid"
            elif g != generation:
                told = "stale"
            elif kind == "taken":
                held = max(0, held - int(s))
            elif kind == "event" and s <= last:
                told = "duplicate"
            elif kind == "event" and s != last + 1:
                told = "gap"
            elif held >= capacity:
                told = "full"
            else:
                held += 1
                last = 0 if kind == "resync" else int(s)
            outcome.append(told)
        state.update((int(generation), int(last), int(held)))
        yield got[["receiver_id", "kind", "generation", "seq", "arrival"]].assign(outcome=outcome)

    return rows.groupBy("receiver_id").applyInPandasWithState(fold, RECEIVED, "generation long, last long, held long", "append", GroupStateTimeout.NoTimeout)


def coalescing_window(log: DataFrame, *, seconds: float) -> DataFrame:
    """Edits (client_id, session_id, seq, k, prim, time, field, value) with transforms held back and merged, by session.

    Transforms wait until `seconds` of processing time have passed since the first that is held; then, or before any edit of another kind, they go out as one merged batch: of a field
    the last value, with the seq of its prim's first one (see reduce.coalesced_transforms). Other edits pass at once. The held values and the deadline are state, so a restart loses nothing;
    a timer sends them without a further edit, in micro-batches without data; a run that shall end with what is there now turns these off. seconds 0 holds nothing beyond a micro-batch. `log` is a stream that has the edits of a session in order of seq.
    """

    def merged(held: list[list[Any]]) -> list[list[Any]]:
        first: dict[tuple[Any, ...], int] = {}
        last: dict[tuple[Any, ...], Any] = {}
        for seq, prim, time, field, value in held:
            first.setdefault((prim, time), seq)
            last[prim, time, field] = value
        return [[first[p, t], "set_xform_trs", p, t, f, v] for (p, t, f), v in last.items()]

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        held, deadline = (json.loads(state.get[0]), state.get[1]) if state.exists else ([], 0)
        out: list[list[Any]] = []
        if not state.hasTimedOut:
            for r in _in_order(frames, "seq").itertuples(index=False):
                clean = [None if pd.isna(x) else x for x in (r.prim, r.time, r.field, r.value)]
                if r.k == "set_xform_trs":
                    deadline = deadline if held else now + int(seconds * 1000)
                    held.append([int(r.seq), *clean])
                    continue
                out += merged(held)
                held = []
                out.append([int(r.seq), r.k, *clean])
        if held and now >= deadline:
            out += merged(held)
            held = []
        if held:  # of a field only the last value is kept
            slim = {(p, t, f): [s, p, t, f, v] for s, p, t, f, v in merged_order(held)}
            state.update((json.dumps(list(slim.values())), deadline))
            state.setTimeoutDuration(max(1, deadline - now))
        elif state.exists:
            state.remove()
        yield pd.DataFrame([[*key, *x] for x in out], columns=["client_id", "session_id", "seq", "k", "prim", "time", "field", "value"])

    def merged_order(held: list[list[Any]]) -> list[list[Any]]:
        return [[s, p, t, f, v] for s, _, p, t, f, v in merged(held)]

    return log.groupBy("client_id", "session_id").applyInPandasWithState(fold, COALESCED, "held string, deadline long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def rate_limit(requests: DataFrame, *, rate: float, burst: int) -> DataFrame:
    """Seconds that each request must wait (0: it took a token), by client: `burst` tokens at most, `rate` new ones a second of arrival time."""
    if rate <= 0 or burst <= 0:
        raise ValueError("rate and burst must be positive")

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = _in_order(frames, "arrival")
        tokens, last = state.get if state.exists else (float(burst), float(rows.arrival.iloc[0]))
        waits = []
        for t in rows.arrival:
            tokens = min(float(burst), tokens + max(0.0, t - last) * rate)
            last = max(last, t)
            if tokens >= 1:
                tokens -= 1
                waits.append(0.0)
            else:
                waits.append((1 - tokens) / rate)
        state.update((tokens, float(last)))
        yield rows[["client_id", "arrival"]].assign(wait=waits)

    return requests.groupBy("client_id").applyInPandasWithState(fold, LIMITED, "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


def playback(commands: DataFrame) -> DataFrame:
    """Outcome and state after each command of a scene: claim, release, and play, pause, stop, set_time and set_rate by the leader alone."""

    def fold(key: tuple[Any, ...], frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        leader, time, playing, rate = state.get if state.exists else ("", 0.0, False, 1.0)
        rows = _in_order(frames, "seq")
        out = []
        for r in rows.itertuples(index=False):
            own = bool(r.client_id) and leader == r.client_id
            ok = own
            if r.action == "claim":
                ok = bool(r.client_id) and leader in ("", r.client_id)
                leader = r.client_id if ok else leader
                if ok and not pd.isna(r.time):
                    time = float(r.time)
            elif not own:
                pass
            elif r.action == "release":
                leader = ""
            elif r.action in ("play", "pause", "stop"):
                playing = r.action == "play"
                time = 0.0 if r.action == "stop" else time
            elif r.action == "set_time":
                time = 0.0 if pd.isna(r.time) else float(r.time)
            elif r.action == "set_rate":
                rate = 1.0 if pd.isna(r.rate) else float(r.rate)
            else:
                ok = False
            out.append((r.scene_id, r.seq, r.client_id, r.action, ok, leader, time, playing, rate))
        state.update((leader, time, playing, rate))
        yield pd.DataFrame(out, columns=["scene_id", "seq", "client_id", "action", "ok", "leader", "time", "playing", "rate"])

    return commands.groupBy("scene_id").applyInPandasWithState(fold, PLAYED, "leader string, time double, playing boolean, rate double", "append", GroupStateTimeout.NoTimeout)
