"""The results table: append, correct, evolve, insert if absent.

A stored table is two folders that only ever grow. ``results`` has the rows as they were
decided, each with the schema version it was written in, in partitions by a hash of the
task. ``corrections`` has every correction. Reading gives columns a row's version did not
know their defaults, and lays the newest correction of each task over its row. Each call
writes a folder of its own, so writers do not meet and nothing stored is ever rewritten.
"""

from __future__ import annotations

import uuid
from collections.abc import Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from evraklab.operators.analytics import newest
from evraklab.schemas import CORRECTIONS, EXTRACTIONS, SINCE_VERSION, STORE_DEFAULTS, STORE_VERSION
from evraklab.session import cut_lineage

# Marks of the audit trail.
APPROVED = "APPROVED"
OVERRIDE_FIELDS = '["manual_override"]'
NO_FIELDS = "[]"
VERSION = "store_version"
PREFIX = "prefix"
#: Partitions of the stored results; a batch reads the keys of those it has tasks in.
PREFIXES = 256


class Matched(NamedTuple):
    """Rows after an update, and the requests that met no row."""

    rows: DataFrame
    unmatched: DataFrame


# -- reading and schema evolution -------------------------------------------------


def evolve(
    df: DataFrame,
    schema: T.StructType = EXTRACTIONS,
    defaults: Mapping[str, object] = STORE_DEFAULTS,
) -> DataFrame:
    """Bring older rows to ``schema``: missing columns take their default, else null.

    A projection only; columns beyond the schema are kept at the end.
    """
    present = set(df.columns)
    columns = []
    for field in schema.fields:
        if field.name in present:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            value = F.lit(defaults.get(field.name)).cast(field.dataType)
            columns.append(value.alias(field.name))
    extra = [F.col(c) for c in df.columns if c not in schema.fieldNames()]
    return df.select(*columns, *extra)


def union_evolved(
    old: DataFrame, new: DataFrame, defaults: Mapping[str, object] = STORE_DEFAULTS
) -> DataFrame:
    """Rows of two generations of the table; a column only one has takes its default in the other."""

    def filled(df: DataFrame, other: DataFrame) -> DataFrame:
        missing = [f for f in other.schema.fields if f.name not in df.columns]
        return df.select(
            "*", *[F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in missing]
        )

    return filled(old, new).unionByName(filled(new, old))


def with_version_defaults(rows: DataFrame) -> DataFrame:
    """Columns that a row's ``store_version`` did not know take their default.

    A null that was stored in a known column stays null; without a version a row has
    the current one.
    """
    version = F.coalesce(VERSION, F.lit(STORE_VERSION))
    filled = {
        name: F.when(version < SINCE_VERSION.get(name, 1), F.lit(default)).otherwise(F.col(name))
        for name, default in STORE_DEFAULTS.items()
    }
    return rows.withColumns(filled).select(*EXTRACTIONS.fieldNames())


def current(rows: DataFrame, corrections: DataFrame) -> DataFrame:
    """The table as it stands: rows of any version under the newest correction of each task."""
    return apply_corrections(with_version_defaults(rows), corrections).rows


def _stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows under ``path``, none if nothing was written yet. The schema is given, so no file is opened for it."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def stored_results(spark: SparkSession, path: str) -> DataFrame:
    """Results as written, with their version and partition."""
    more = [T.StructField(VERSION, T.IntegerType()), T.StructField(PREFIX, T.IntegerType())]
    return _stored(spark, f"{path}/results", T.StructType([*EXTRACTIONS.fields, *more]))


def stored_corrections(spark: SparkSession, path: str) -> DataFrame:
    return _stored(spark, f"{path}/corrections", CORRECTIONS)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """The table at ``path`` as it stands."""
    return current(stored_results(spark, path), stored_corrections(spark, path))


def unmatched_corrections(spark: SparkSession, path: str) -> DataFrame:
    """The newest correction of each task that has no stored row, or none yet."""
    latest = latest_corrections(stored_corrections(spark, path))
    return latest.join(stored_results(spark, path).select("task_id"), "task_id", "left_anti")


def _own_folder(path: str) -> str:
    return f"{path}/batch={uuid.uuid4().hex}"


# -- append ------------------------------------------------------------------------


def row_id(task_id: Column) -> Column:
    """A positive number out of the task's id: 60 bits of its md5, the same on every run."""
    return F.conv(F.substring(F.md5(task_id), 1, 15), 16, 10).cast("bigint")


def to_store_rows(results: DataFrame, as_of: Column | None = None) -> DataFrame:
    """Store rows out of pipeline results: nested values as JSON, a null report as ``{}``.

    Null fields are written out: missing and null mean different things.
    """
    options = {"ignoreNullFields": "false"}
    result = F.struct(
        "status",
        "overall_trust_score",
        "stages",
        "data",
        "full_raw_text",
        "processing_time",
        "validation_report",
        "decision_engine",
    )
    return results.select(
        row_id(F.col("task_id")).alias("id"),
        "task_id",
        "filename",
        F.col("classification.domain").alias("document_type"),
        "trust_score",
        F.to_json(result, options).alias("extracted_json"),
        "status",
        F.lit(0).alias("is_verified"),
        F.lit(None).cast("string").alias("corrected_json"),
        F.coalesce(F.to_json("validation_report", options), F.lit("{}")).alias("validation_report"),
        "processing_time",
        F.lit(None).cast("string").alias("error_type"),
        F.col("key_id").cast("bigint").alias("api_key_id"),
        F.col("full_raw_text").alias("raw_text"),
        F.lit(None).cast("string").alias("approved_by"),
        F.lit(None).cast("timestamp").alias("approved_at"),
        F.lit(None).cast("string").alias("corrected_fields"),
        (F.current_timestamp() if as_of is None else as_of).alias("created_at"),
    )


def one_per_key(rows: DataFrame, key: str) -> DataFrame:
    """The least row of each key, comparing columns from left to right; a null key is a key."""
    order = F.struct(*rows.columns)
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min(order).alias("_row")).select("_row.*")


def not_stored(rows: DataFrame, stored: DataFrame, key: str = "task_id") -> DataFrame:
    """One row per new key that ``stored`` does not have; reads only its key column."""
    return one_per_key(rows, key).join(stored.select(key), key, "left_anti").select(*rows.columns)


def prefix_of(task_id: Column) -> Column:
    return F.pmod(F.xxhash64(task_id), F.lit(PREFIXES)).cast("int")


def stored_keys(spark: SparkSession, path: str, prefixes: list[int]) -> DataFrame:
    """(task_id) of the stored results in the given partitions."""
    rows = stored_results(spark, path)
    return rows.where(F.col(PREFIX).isin(prefixes)).select("task_id")


def append_results(rows: DataFrame, path: str, version: int = STORE_VERSION) -> None:
    """Append rows whose task_id is new. Repeating a call adds nothing.

    Of the stored table only the keys in the partitions of the batch's own tasks are read;
    the batch is settled first, so it is computed once.
    """
    spark = rows.sparkSession
    known = [F.col(f.name).cast(f.dataType).alias(f.name) for f in EXTRACTIONS if f.name in rows.columns]
    dealt = rows.select(*known, F.lit(version).alias(VERSION), prefix_of(F.col("task_id")).alias(PREFIX))
    batch = cut_lineage(dealt)
    prefixes = [r[0] for r in batch.select(PREFIX).distinct().collect()]  # at most PREFIXES
    fresh = not_stored(batch, stored_keys(spark, path, prefixes))
    spread = fresh.repartition(PREFIX).sortWithinPartitions(PREFIX, "created_at")
    spread.write.partitionBy(PREFIX).parquet(_own_folder(f"{path}/results"))


# -- corrections --------------------------------------------------------------------


def latest_corrections(corrections: DataFrame) -> DataFrame:
    """The last correction per task_id, by ``corrected_at``."""
    kept = F.struct("corrected_json", "approved_by", "corrected_fields", "corrected_at")
    order = F.struct("corrected_at", "corrected_json")
    return (
        corrections.groupBy("task_id").agg(F.max_by(kept, order).alias("c")).select("task_id", "c.*")
    )


def _approve(row: DataFrame) -> DataFrame:
    hit = F.col("c").isNotNull()
    new = {
        "corrected_json": F.col("c.corrected_json"),
        "is_verified": F.lit(1),
        "approved_by": F.col("c.approved_by"),
        "approved_at": F.col("c.corrected_at"),
        "corrected_fields": F.coalesce("c.corrected_fields", F.lit(NO_FIELDS)),
        "status": F.lit(APPROVED),
    }
    types = {f.name: f.dataType for f in row.schema.fields}
    return row.select(
        *[
            F.when(hit, new[c].cast(types[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(c)
            for c in row.columns
            if c != "c"
        ]
    )


def apply_corrections(extractions: DataFrame, corrections: DataFrame) -> Matched:
    """Write the latest correction of each task into its row, with the audit trail.

    ``corrections`` is (task_id, corrected_json, approved_by, corrected_fields,
    corrected_at).
    """
    latest = latest_corrections(corrections)
    packed = latest.select("task_id", F.struct(*latest.columns[1:]).alias("c"))
    rows = _approve(extractions.join(packed, "task_id", "left").select(*extractions.columns, "c"))
    unmatched = latest.join(extractions.select("task_id"), "task_id", "left_anti")
    return Matched(rows, unmatched)


def correct(extractions: DataFrame, requests: DataFrame) -> Matched:
    """Corrections by people: (task_id, corrected_json, approved_by, corrected_at)."""
    return apply_corrections(
        extractions, requests.withColumn("corrected_fields", F.lit(OVERRIDE_FIELDS))
    )


def approvals(extractions: DataFrame, requests: DataFrame, window: int | None = None) -> Matched:
    """Approvals as corrections: (task_id, approved_by, corrected_at) requests.

    The extracted JSON of a row becomes the corrected one. With ``window`` only the newest
    so many rows can be approved. Requests for any other row come back as unmatched.
    """
    current = extractions.select("task_id", F.col("extracted_json").alias("corrected_json"))
    if window is not None:
        keys = newest(extractions.select("task_id", "created_at", *_optional(extractions, "id")), window)
        current = current.join(keys.select("task_id"), "task_id", "left_semi")
    rows = requests.join(current, "task_id").withColumn("corrected_fields", F.lit(NO_FIELDS))
    return Matched(rows, requests.join(current.select("task_id"), "task_id", "left_anti"))


def approve(extractions: DataFrame, requests: DataFrame, window: int | None = None) -> Matched:
    """Approve tasks with the data they already have."""
    granted = approvals(extractions, requests, window)
    return Matched(apply_corrections(extractions, granted.rows).rows, granted.unmatched)


def _optional(df: DataFrame, name: str) -> list[str]:
    return [name] if name in df.columns else []


def append_corrections(corrections: DataFrame, path: str) -> None:
    """Store corrections beside the results, which stay as they are.

    Repeating a call changes nothing, as the newest correction of a task counts once.
    """
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in CORRECTIONS]
    corrections.select(*columns).write.parquet(_own_folder(f"{path}/corrections"))


# -- insert if absent -----------------------------------------------------------------


def insert_if_absent(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key is not there yet, one per key."""
    return not_stored(new, existing, key)


def create_api_keys(users: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new users, new keys) for (request_id, user_name, label) requests.

    Users are created when absent; a key ``sk_`` + 12 hex digits is drawn from the
    request's id, so a repeated task yields the same key. Ids derive from the name
    and the key instead of a counter, which no parallel writer could share.
    """
    named = requests.select(
        F.xxhash64("user_name").alias("id"), F.col("user_name").alias("name")
    )
    new_users = insert_if_absent(users, named, "name")
    known = users.select("id", "name").unionByName(new_users)
    key_hash = F.concat(
        F.lit("sk_"),
        F.substring(F.sha2(F.concat_ws("|", F.col("request_id").cast("string"), "user_name"), 256), 1, 12),
    )
    keys = (
        requests.join(known, F.col("user_name") == F.col("name"))
        .withColumn("key_hash", key_hash)
        .select(
            F.xxhash64("key_hash").alias("id"),
            "key_hash",
            known["id"].alias("user_id"),
            F.coalesce("label", F.lit("Default")).alias("label"),
            F.lit(1).alias("is_active"),
        )
    )
    return new_users, keys
