"""Landing zone of uploaded files: manifest, rejects and retention."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Accepted file types and the age at which an upload expires.
ALLOWED_EXTENSIONS = (".png", ".jpg", ".jpeg", ".pdf")
RETENTION = timedelta(hours=24)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def file_extension(path: Column) -> Column:
    """Lower-cased extension with its dot; '' for none and for a leading-dot name."""
    return F.lower(F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def file_stem(path: Column) -> Column:
    name = file_name(path)
    return F.substring(name, F.lit(1), F.length(name) - F.length(file_extension(path)))


def is_pdf(path: Column) -> Column:
    return F.endswith(F.lower(path), F.lit(".pdf"))


def scan_uploads(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Files under ``path``: path, modificationTime, length. Contents are not read."""
    reader = spark.readStream if stream else spark.read
    source = reader.format("binaryFile").option("recursiveFileLookup", "true")
    if stream:
        source = source.schema(
            "path string, modificationTime timestamp, length bigint, content binary"
        )
    return source.load(path).select("path", "modificationTime", "length")


def manifest(files: DataFrame) -> DataFrame:
    """(doc_id, path, filename, ext, is_pdf, length, modificationTime, accepted)."""
    ext = file_extension(F.col("path"))
    return files.select(
        F.xxhash64("path").alias("doc_id"),
        "path",
        file_name(F.col("path")).alias("filename"),
        ext.alias("ext"),
        is_pdf(F.col("path")).alias("is_pdf"),
        "length",
        "modificationTime",
        ext.isin(*ALLOWED_EXTENSIONS).alias("accepted"),
    )


def accepted(files: DataFrame) -> DataFrame:
    return manifest(files).where("accepted").drop("accepted")


def rejected(files: DataFrame) -> DataFrame:
    return manifest(files).where(~F.col("accepted")).drop("accepted")


def is_expired(time: Column, as_of: datetime, age: timedelta = RETENTION) -> Column:
    """Strictly older than ``age`` at ``as_of``."""
    return time < F.lit(as_of - age)


def split_by_age(
    df: DataFrame, time: str, as_of: datetime, age: timedelta = RETENTION
) -> tuple[DataFrame, DataFrame]:
    """(expired, kept) rows."""
    old = F.coalesce(is_expired(F.col(time), as_of, age), F.lit(False))
    return df.where(old), df.where(~old)
