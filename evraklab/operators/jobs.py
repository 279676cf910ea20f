"""Latest stage of each job out of a stage-event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Progress a stage stands for.
STAGE_PROGRESS = {
    "QUEUED": 0,
    "FILE_PREP": 10,
    "OCR": 25,
    "CLASSIFICATION": 50,
    "EXTRACTION": 75,
    "FINISHED": 100,
}


def progress_of(stage: Column) -> Column:
    out = F.lit(0)
    for name, value in STAGE_PROGRESS.items():
        out = F.when(stage == name, value).otherwise(out)
    return out


def latest_stage(events: DataFrame, tie_breaker: str | None = None) -> DataFrame:
    """(job_id, current_stage, progress, updated_at) by event time.

    On equal times the stage further along wins. ``max_by`` merges partial
    results, so a job with very many events is reduced before the shuffle; the
    same aggregation runs on a stream in update mode.
    """
    progress = progress_of(F.col("stage"))
    order = [F.col("ts"), progress] + ([F.col(tie_breaker)] if tie_breaker else [])
    kept = F.struct(F.col("stage").alias("current_stage"), F.col("ts").alias("updated_at"))
    return (
        events.groupBy("job_id")
        .agg(F.max_by(kept, F.struct(*order)).alias("s"))
        .select(
            "job_id",
            "s.current_stage",
            progress_of(F.col("s.current_stage")).alias("progress"),
            "s.updated_at",
        )
    )
