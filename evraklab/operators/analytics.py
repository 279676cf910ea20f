"""Questions over the store: statistics, insights, newest rows."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

# Thresholds of the dashboard, the insights and the anomaly list.
SUCCESS_TRUST = 0.90
EFFICIENT_TRUST = 0.85
MINUTES_SAVED = 5
RECENT_DAYS = 7
COUNT_MIN_TRUST, COUNT_MAX_SECONDS = 0.5, 30
LIST_MIN_TRUST, LIST_MAX_SECONDS = 0.6, 40
MAX_REVIEW_LIMIT = 50
ANOMALY_COLUMNS = ("filename", "document_type", "trust_score", "processing_time", "created_at")


def is_recent(as_of: date, days: int = RECENT_DAYS, column: str = "created_at") -> Column:
    """On or after midnight ``days`` before ``as_of``."""
    return F.col(column) >= F.lit(as_of - timedelta(days=days))


def recent(df: DataFrame, as_of: date, days: int = RECENT_DAYS) -> DataFrame:
    """Rows of the last days; prunes partitions where the store has ``created_date``."""
    if "created_date" in df.columns:
        df = df.where(F.col("created_date") >= F.lit(as_of - timedelta(days=days)))
    return df.where(is_recent(as_of, days))


def is_anomaly(min_trust: float = LIST_MIN_TRUST, max_seconds: float = LIST_MAX_SECONDS) -> Column:
    return (F.col("trust_score") < min_trust) | (F.col("processing_time") > max_seconds)


def docs_by_type(extractions: DataFrame) -> DataFrame:
    return extractions.groupBy("document_type").agg(F.count("*").alias("n"))


def dashboard_stats(extractions: DataFrame) -> DataFrame:
    """One row: documents per type, success rate, mean time, total.

    A single scan: per type first, then the few type rows. An empty store
    reports a total of 1 and no success.
    """
    per_type = extractions.groupBy("document_type").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("trust_score") >= SUCCESS_TRUST).alias("good"),
        F.sum("processing_time").alias("seconds"),
        F.count("processing_time").alias("timed"),
    )
    total = F.greatest(F.coalesce(F.sum("n"), F.lit(0)), F.lit(1))
    mean = F.sum("seconds") / F.nullif(F.sum("timed"), F.lit(0))
    return per_type.agg(
        F.array_sort(F.collect_list(F.struct("document_type", "n"))).alias("doc_types"),
        (F.coalesce(F.sum("good"), F.lit(0)) / total * 100).alias("success_rate"),
        F.round(F.coalesce(mean, F.lit(0.0)), 2).alias("avg_processing_time"),
        total.alias("total_documents"),
    )


def platform_insights(extractions: DataFrame, as_of: date) -> DataFrame:
    """One row: hours saved, automation rate, recent accuracy, learning, anomalies; one scan."""
    facts = extractions.agg(
        F.count("*").alias("n"),
        F.count_if(F.col("trust_score") > EFFICIENT_TRUST).alias("efficient"),
        F.avg(F.when(is_recent(as_of), F.col("trust_score"))).alias("recent_trust"),
        F.count_if(F.col("is_verified") == 1).alias("verified"),
        F.count_if(is_anomaly(COUNT_MIN_TRUST, COUNT_MAX_SECONDS)).alias("anomalies"),
    )
    return facts.select(
        F.round(F.col("efficient") * MINUTES_SAVED / 60, 1).alias("hours_saved"),
        F.round(F.col("efficient") / F.greatest("n", F.lit(1)) * 100, 1).alias("automation_rate"),
        F.round(F.coalesce("recent_trust", F.lit(0.0)) * 100, 1).alias("accuracy_score"),
        F.col("verified").alias("knowledge_base_size"),
        F.col("anomalies").alias("active_anomalies"),
    )


def newest(df: DataFrame, limit: int) -> DataFrame:
    """Newest rows; ``id`` and ``task_id`` break ties of the one-second clock."""
    order = [F.desc(c) for c in ("created_at", "id", "task_id") if c in df.columns]
    return df.orderBy(*order).limit(limit)


def history(extractions: DataFrame, limit: int = 10) -> DataFrame:
    return newest(extractions, limit)


def pending_reviews(extractions: DataFrame, limit: int = 20) -> DataFrame:
    if limit > MAX_REVIEW_LIMIT:
        raise ValueError(f"at most {MAX_REVIEW_LIMIT} rows can be asked for")
    return newest(extractions.where(F.col("status") == "REVIEW_REQUIRED"), limit)


def anomalies(extractions: DataFrame, limit: int = 5) -> DataFrame:
    """Newest rows with low trust or long processing, five columns."""
    keys = [c for c in ("id", "task_id") if c in extractions.columns]
    narrow = extractions.where(is_anomaly()).select(*ANOMALY_COLUMNS, *keys)
    return newest(narrow, limit).select(*ANOMALY_COLUMNS)


def verified_examples(extractions: DataFrame, limit: int = 3) -> DataFrame:
    """The newest verified rows per document type, with their rank.

    Spark filters the rank before the shuffle (window group limit), so a type
    with most of the rows sends at most ``limit`` of them per task.
    """
    keys = [c for c in ("id", "task_id") if c in extractions.columns]
    order = [F.desc(c) for c in ("created_at", *keys)]
    rank = F.row_number().over(W.partitionBy("document_type").orderBy(*order))
    return (
        extractions.where(F.col("is_verified") == 1)
        .select("document_type", "raw_text", "corrected_json", "created_at", *keys)
        .withColumn("rank", rank)
        .where(F.col("rank") <= limit)
    )


def active_only(df: DataFrame, keys: DataFrame, on: str = "api_key_id") -> DataFrame:
    """Rows whose key (id, is_active) is active.

    Many rows share a key, so a shuffle on it would be lopsided: the key table
    is broadcast when it is small enough and joined by Spark's choice otherwise.
    """
    active = keys.where(F.col("is_active") == 1).select(F.col("id").alias(on)).distinct()
    return df.join(active, on, "left_semi")


def verify_key(keys: DataFrame, key: str) -> DataFrame:
    """Id of an active key, by its text."""
    return keys.where((F.col("key_hash") == key) & (F.col("is_active") == 1)).select("id")
