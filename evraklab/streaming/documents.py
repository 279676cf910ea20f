"""Documents as they land: one row per document, processed batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from evraklab.operators.doc_text import nested_states
from evraklab.plans.documents import results_of
from evraklab.schemas import OCR_DOCUMENT
from evraklab.sinks.store import append_results, to_store_rows


def landing_documents(
    spark: SparkSession, path: str, max_files_per_trigger: int | None = None
) -> DataFrame:
    """Stream of landed documents; all lines of a document are in its row."""
    reader = spark.readStream.schema(OCR_DOCUMENT)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.parquet(path)


def lines_of(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.inline("lines"))


def process_landed(documents: DataFrame, **options) -> DataFrame:
    """Store rows of a batch of landed documents; blank ones are left out.

    A document delivered twice is taken once, the latest
    by ``received_at``. A document without a task id goes by its own id.
    """
    order = F.struct("received_at", F.xxhash64(*documents.columns))
    packed = documents.groupBy("doc_id").agg(F.max_by(F.struct(*documents.columns), order).alias("_d"))
    # Lines, reply and manifest of a document are in its row, so they never part to be joined.
    once = packed.where(F.col("doc_id").isNotNull()).select("_d.*")
    results = results_of(nested_states(once), keep=["received_at"], **options)
    return to_store_rows(results, F.coalesce("received_at", F.current_timestamp()))


def ingest(
    spark: SparkSession,
    landing: str,
    store: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    max_files_per_trigger: int | None = None,
    **options,
) -> StreamingQuery:
    """Process landed documents into the store.

    The checkpoint resumes after a restart; a batch run twice adds nothing, since
    the store takes a task_id once.
    """

    def write(batch: DataFrame, _: int) -> None:
        append_results(process_landed(batch, **options), store)

    writer = (
        landing_documents(spark, landing, max_files_per_trigger)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(write)
    )
    return (writer.trigger(availableNow=True) if available_now else writer).start()
