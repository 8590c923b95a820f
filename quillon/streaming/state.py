"""State machines of the bus: circuit breaker, token bucket, heartbeat, bounded history; one step each, shared by streams and replays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Failures that open a breaker, seconds until it is tried again, calls that may try it.
FAILURES, RECOVERY, PROBES = 5, 60.0, 2
#: Seconds of silence after which an agent is unhealthy; half of it makes a healthy one degraded.
SILENCE = 60.0

Breaker = tuple[str, int, float, int]
CLOSED: Breaker = ("closed", 0, 0.0, 0)


def breaker_step(state: Breaker, now: float, success: bool, failures: int = FAILURES, recovery: float = RECOVERY, probes: int = PROBES) -> tuple[Breaker, bool]:
    """The breaker after one call, and whether the call was let through; a call that is not let through leaves no result."""
    name, n, last, calls = state
    allowed = True
    if name == "open":
        allowed = now - last > recovery
        if allowed:
            name, calls = "half_open", 0
    elif name == "half_open":
        allowed = calls < probes
        if allowed:
            calls += 1
    if not allowed:
        return (name, n, last, calls), False
    if success:
        return CLOSED, True
    n += 1
    return ("open" if n >= failures else name, n, now, calls), True


def bucket_step(state: tuple[float, float] | None, now: float, capacity: float = 5.0, rate: float = 0.001) -> tuple[tuple[float, float], bool]:
    """Tokens and time after one request, and whether it is allowed."""
    tokens, last = state or (capacity, now)
    tokens = min(capacity, tokens + (now - last) * rate)
    return ((tokens - 1.0, now), True) if tokens >= 1.0 else ((tokens, now), False)


def health_status(silent: float, status: str, tasks: int, failed: int, timeout: float = SILENCE) -> str:
    """An agent's status by its silence in seconds and its failure rate."""
    if silent > timeout:
        status = "unhealthy"
    elif silent > timeout / 2 and status == "healthy":
        status = "degraded"
    return "unhealthy" if tasks > 10 and failed * 2 > tasks else status


def replay(rows: Iterable[tuple[int, float, bool]], state: Breaker = CLOSED) -> Iterator[tuple[int, str, bool]]:
    """Event, state after it and whether it was let through, for one agent's calls in order."""
    for event, now, success in rows:
        state, allowed = breaker_step(state, now, success)
        yield event, state[0], allowed


#: Rows of a group that are Python values at a time.
STEP = 10_000


def in_order(batches: Iterable[pd.DataFrame], types: dict[str, pa.DataType | None], order: tuple[str, ...], step: int = STEP) -> Iterator[pd.DataFrame]:
    """A group's rows in order, in frames of at most step rows; meanwhile they are Arrow columns, without an object for each value.

    types: the columns and, where a batch may not show it, their type.
    """
    held: list[pa.Table] = []
    for batch in batches:
        if len(batch):
            held.append(pa.table({c: pa.Array.from_pandas(batch[c], type=t) for c, t in types.items()}))
    if not held:
        return
    rows = pa.concat_tables(held).combine_chunks()
    held.clear()
    places = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in order])
    for at in range(0, len(places), step):
        yield rows.take(places.slice(at, step)).to_pandas()


def breaker_stream(events: DataFrame) -> DataFrame:
    """event_id, agent_id, state and allowed for every call; the state is kept by agent.

    events: event_id, agent_id, ts (timestamp), success. Calls are taken in order of time within a micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: Breaker = state.get if state.exists else CLOSED
        for rows in in_order(batches, {"event_id": None, "ts": None, "success": pa.bool_()}, ("ts", "event_id")):
            out = []
            for event, ts, success in zip(rows["event_id"], rows["ts"], rows["success"]):
                now, allowed = breaker_step(now, ts.timestamp(), bool(success))
                out.append((int(event), int(key[0]), now[0], allowed))
            yield pd.DataFrame(out, columns=["event_id", "agent_id", "state", "allowed"])
        state.update(now)

    return events.groupBy("agent_id").applyInPandasWithState(run, "event_id long, agent_id long, state string, allowed boolean", "name string, failures int, last double, calls int", "append", GroupStateTimeout.NoTimeout)


def limiter_stream(events: DataFrame) -> DataFrame:
    """event_id, identity and allowed for every request by the token bucket of its identity."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        for rows in in_order(batches, {"event_id": None, "ts": None}, ("ts", "event_id")):
            out = []
            for event, ts in zip(rows["event_id"], rows["ts"]):
                now, allowed = bucket_step(now, ts.timestamp())
                out.append((int(event), int(key[0]), allowed))
            yield pd.DataFrame(out, columns=["event_id", "identity", "allowed"])
        state.update(now)

    return events.groupBy("identity").applyInPandasWithState(run, "event_id long, identity long, allowed boolean", "tokens double, last double", "append", GroupStateTimeout.NoTimeout)


#: Fixed values of the delivery breaker: successes that close it again; seconds before each further attempt; attempts.
CLOSING, DELAYS, ATTEMPTS = 3, (1, 5, 30), 3
Delivery = tuple[str, int, int, float]
READY: Delivery = ("closed", 0, 0, 0.0)


def delivery_allowed(state: Delivery, now: float, recovery: float = RECOVERY, closing: int = CLOSING) -> tuple[Delivery, bool]:
    """Whether an endpoint may be called; an open breaker is half open once its time has passed."""
    name, failed, ok, last = state
    if name == "open":
        return (("half_open", 0, 0, last), True) if now - last >= recovery else (state, False)
    return state, name == "closed" or ok < closing


def delivery_result(state: Delivery, now: float, success: bool, failures: int = FAILURES, closing: int = CLOSING) -> Delivery:
    """The breaker after a call: a failure while half open opens it, enough successes close it."""
    name, failed, ok, last = state
    if success:
        ok += 1
        if name == "half_open" and ok >= closing:
            return "closed", 0, 0, last
        return ("half_open", 0, 1, last) if name == "open" else (name, 0, ok, last)
    failed += 1
    if name == "half_open":
        return "open", failed, 0, now
    return ("open" if name == "closed" and failed >= failures else name), failed, ok, now


def delivered(state: Delivery, now: float, outcomes: Iterable[bool], attempts: int = ATTEMPTS, delays: tuple[int, ...] = DELAYS) -> tuple[Delivery, str, int, float]:
    """One event's delivery with retries: the breaker, the logged status, the number of the last attempt and the time after it.

    Only the last attempt is logged: DELIVERED, EXHAUSTED, or FAILED with attempt 0 where the breaker is open.
    """
    state, allowed = delivery_allowed(state, now)
    if not allowed:
        return state, "FAILED", 0, now
    results = iter(outcomes)
    for attempt in range(1, attempts + 1):
        if attempt > 1:
            now += delays[min(attempt - 2, len(delays) - 1)]
        success = next(results, False)
        state = delivery_result(state, now, success)
        if success:
            return state, "DELIVERED", attempt, now
    return state, "EXHAUSTED", attempts, now


def delivery_replay(rows: Iterable[tuple[int, float, list[bool]]], state: Delivery = READY) -> Iterator[tuple[int, str, int, str]]:
    """Event, logged status, number of the last attempt and the breaker's state after it, for one endpoint's events in order."""
    for event, now, outcomes in rows:
        state, logged, attempt, _ = delivered(state, now, outcomes)
        yield event, logged, attempt, state[0]


def delivery_stream(events: DataFrame) -> DataFrame:
    """event_id, endpoint, status, attempt and breaker for every event's delivery with retries; the breaker is kept by endpoint.

    events: event_id, endpoint, ts (timestamp), outcomes (of the attempts, in order). Events are taken in order of time
    within a micro-batch, in Arrow batches of a sorted group.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now: Delivery = state.get if state.exists else READY
        for rows in in_order(batches, {"event_id": None, "ts": None, "outcomes": pa.list_(pa.bool_())}, ("ts", "event_id")):
            out = []
            for event, ts, outcomes in zip(rows["event_id"], rows["ts"], rows["outcomes"]):
                now, logged, attempt, _ = delivered(now, ts.timestamp(), [bool(x) for x in outcomes])
                out.append((int(event), int(key[0]), logged, attempt, now[0]))
            yield pd.DataFrame(out, columns=["event_id", "endpoint", "status", "attempt", "breaker"])
        state.update(now)

    return events.groupBy("endpoint").applyInPandasWithState(run, "event_id long, endpoint long, status string, attempt int, breaker string", "name string, failed int, ok int, last double", "append", GroupStateTimeout.NoTimeout)


def chained(previous: str, record: str) -> str:
    """The hash of a record that follows another in a chain."""
    return hashlib.sha256(f"{previous}|{record}".encode()).hexdigest()


def chain_stream(records: DataFrame) -> DataFrame:
    """chain, sequence, previous_hash and entry_hash of every record appended to its chain; the last hash is kept by chain.

    records: chain, sequence, record (text). A chain begins with 64 zeros; records are taken by sequence in a micro-batch.
    """

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else "0" * 64
        for rows in in_order(batches, {"sequence": None, "record": pa.large_string()}, ("sequence",)):
            out = []
            for sequence, record in zip(rows["sequence"], rows["record"]):
                entry = chained(last, record)
                out.append((int(key[0]), int(sequence), last, entry))
                last = entry
            yield pd.DataFrame(out, columns=["chain", "sequence", "previous_hash", "entry_hash"])
        state.update((last,))

    return records.groupBy("chain").applyInPandasWithState(run, "chain long, sequence long, previous_hash string, entry_hash string", "last string", "append", GroupStateTimeout.NoTimeout)
