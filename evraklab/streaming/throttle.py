"""Over-limit events on a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evraklab.operators.throttle import EXPIRY_SECONDS, LIMIT, NEVER, fold

# A key's state is dropped after so long without an event, by the wall clock.
IDLE_SECONDS = 3600.0


def throttle_stream(
    events: DataFrame,
    key: str,
    ts: str,
    event_id: str,
    limit: int = LIMIT,
    expiry_seconds: float = EXPIRY_SECONDS,
    idle_seconds: float = IDLE_SECONDS,
) -> DataFrame:
    """(key, event_id, ts, denied, late) for a stream with an event-time timestamp column.

    State per key is the count, the time of the last accepted event and the newest time
    seen; it is dropped after ``idle_seconds`` without an event, or the expiry if that is
    longer. A key's events are put in order within each micro-batch, whose size the
    source bounds. No event is lost: one that arrives in a later batch than a newer event
    of its key is judged by the state it finds and marked ``late``, where the batch form
    would have judged it in its place. Events without key or time come back undecided.
    """
    idle = int(max(idle_seconds, expiry_seconds) * 1000)
    expiry = int(expiry_seconds * 1_000_000)
    key_type = events.schema[key].dataType.simpleString()
    id_type = events.schema[event_id].dataType.simpleString()

    def step(
        keys: tuple, batches: Iterator[pd.DataFrame], state: GroupState
    ) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["_us", event_id], kind="stable")
        count, last, newest = state.get if state.exists else (0, NEVER, NEVER)
        late = rows["_us"].to_numpy() < newest
        denied, count, last = fold(rows["_us"].tolist(), count, last, limit, expiry)
        state.update((count, last, max(newest, int(rows["_us"].max()))))
        state.setTimeoutTimestamp(int(rows["_seen_ms"].max()) + idle)
        yield pd.DataFrame(
            {key: keys[0], event_id: rows[event_id], "ts": rows["ts"], "denied": denied, "late": late}
        )

    source = events.select(F.col(key), F.col(event_id), F.col(ts).cast("timestamp").alias("ts"))
    judged = F.col(key).isNotNull() & F.col("ts").isNotNull()
    none = F.lit(None).cast("boolean")
    undecided = source.where(~judged).withColumns({"denied": none, "late": none})
    # The watermark runs on arrival times, behind which no event can be: it ends idle
    # states and drops nothing.
    arrived = (
        source.where(judged)
        .withColumns({"_us": F.unix_micros("ts"), "_seen": F.current_timestamp()})
        .withColumn("_seen_ms", F.unix_millis("_seen"))
        .withWatermark("_seen", "1 second")
    )
    flagged = arrived.groupBy(key).applyInPandasWithState(
        step,
        f"{key} {key_type}, {event_id} {id_type}, ts timestamp, denied boolean, late boolean",
        "count long, last long, newest long",
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    return flagged.unionByName(undecided)
