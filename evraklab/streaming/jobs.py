"""Latest stage of each job on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from evraklab.operators.jobs import latest_stage


def track_stages(events: DataFrame, checkpoint: str, sink, *, available_now: bool = True) -> StreamingQuery:
    """Send changed jobs of a stage-event stream to ``sink(batch, batch_id)`` in update mode."""
    writer = (
        latest_stage(events)
        .writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(sink)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
