"""A sliding-window rate limit per key, in batch and as a stateful stream.

At most ``most`` events of a key lie in (now - window, now]; only accepted events count, so a refused one does not prolong the
block.  That depends on earlier decisions, so it is state and not a window function.  A key's events are read in order from a
sorted partition and only the accepted times of one window are held, so a hot key needs no more memory than any other.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "key {kind}, event_id bigint, ts timestamp, accepted boolean, wait_s double"


def decide(times: deque[float], now: float, most: int, window: float) -> float | None:
    """None and the event is counted, or the seconds until one is allowed; an event exactly ``window`` old has expired."""
    while times and times[0] <= now - window:
        times.popleft()
    if len(times) >= most:
        return times[0] + window - now
    times.append(now)
    return None


def limited(events: DataFrame, key: str, ts: str, event_id: str, most: int, window_s: float) -> DataFrame:
    """(key, event_id, ts, accepted, wait_s): batch form.  One shuffle by key, sorted within partitions, streamed through."""
    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.col(ts).cast("timestamp").alias("ts")).where("key is not null and ts is not null")
    rows = rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").withColumn("s", F.unix_micros("ts") / 1e6)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, times = None, deque()
        for part in parts:
            waits = []
            for k, now in zip(part["key"], part["s"]):
                if k != last:
                    last, times = k, deque()
                waits.append(decide(times, now, most, window_s))
            wait = pd.Series(waits, index=part.index, dtype="float64")
            yield part.assign(accepted=wait.isna(), wait_s=wait)[["key", "event_id", "ts", "accepted", "wait_s"]]

    return rows.mapInPandas(run, SCHEMA.format(kind=kind))


def limited_stream(events: DataFrame, key: str, ts: str, event_id: str, most: int, window_s: float) -> DataFrame:
    """The same over a stream: state per key is the list of accepted times, and it is dropped a window after the key falls silent.

    Events of a micro-batch are taken in time order; later micro-batches are later events."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    kind = events.schema[key].dataType.simpleString()
    rows = events.select(F.col(key).alias("key"), F.col(event_id).cast("bigint").alias("event_id"), F.col(ts).cast("timestamp").alias("ts"), (F.unix_micros(F.col(ts).cast("timestamp")) / 1e6).alias("s"))

    def run(name: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times = deque(state.get[0]) if state.exists else deque()
        batch = pd.concat(list(parts)).sort_values(["s", "event_id"])
        waits = pd.Series([decide(times, now, most, window_s) for now in batch["s"]], index=batch.index, dtype="float64")
        state.update((list(times),))
        state.setTimeoutDuration(int(window_s * 1000) + 1)
        yield batch.assign(accepted=waits.isna(), wait_s=waits)[["key", "event_id", "ts", "accepted", "wait_s"]]

    return rows.groupBy("key").applyInPandasWithState(run, SCHEMA.format(kind=kind), "times array<double>", "append", GroupStateTimeout.ProcessingTimeTimeout)
