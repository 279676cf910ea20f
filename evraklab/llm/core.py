"""Shared pieces of the text operators: row keys, staged tables, components.

Words are ``[^\\x20\\x09-\\x0D]+`` everywhere. On UTF-8 bytes that is exactly
``bytes.split()``, and ``bytes.lower()`` lower-cases exactly A-Z.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evraklab.session import configure, ensure_checkpoint_dir

BATCH_ROWS = 2048


def prepare(spark: SparkSession) -> SparkSession:
    """Session options of this package; small Arrow batches bound a task's memory.

    The limit of a method's length is Spark's own here: only the plan of documents needs a lower one.
    """
    configure(spark)
    spark.conf.set("spark.sql.codegen.hugeMethodLimit", "65535")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have yet, whatever the case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def staged(df: DataFrame, codec: str = "snappy") -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there.

    Cuts the lineage like ``checkpoint()``, survives lost executors, and as Parquet
    is smaller and has sizes that the planner can use.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Apply ``fn`` to every Arrow batch, alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def utf8(column: pa.Array) -> list[bytes]:
    """The column's texts as bytes; null becomes empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def ragged(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def splitmix(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit values (the finaliser of the splitmix64 generator)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def most_frequent(counted: DataFrame, size: int) -> DataFrame:
    """The rows of ``counted`` with the greatest ``n``, as many levels of it as ``size`` holds.

    Four levels double the count, so nothing is sorted and ties stay together.
    """
    level = F.floor(4 * F.log2("n")).cast("int")
    total, least = 0, None
    for row in counted.groupBy(level.alias("k")).count().orderBy(F.desc("k")).collect():  # at most 256 rows
        total += row["count"]
        if total > size:
            break
        least = row["k"]
    return counted.limit(0) if least is None else counted.filter(level >= least)


class Codes(dict):
    """Codes of words: a known word's place, or -1, -2, ... for the others of a text."""

    def begin(self) -> None:
        self.rare: dict = {}

    def __missing__(self, word) -> int:
        return self.rare.setdefault(word, -1 - len(self.rare))


def components(edges: DataFrame) -> DataFrame:
    """Connected components of ``edges`` (a, b): rows (node, root), root the least node.

    Nodes without an edge are left out. Each round hooks every node to its least
    neighbour, halves the pointer chains twice, and contracts the edges; the nodes
    left fall fast, also on long chains and on stars. No link or label passes
    through the driver.
    """
    spark = edges.sparkSession
    a, b = F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")
    live = staged(edges.select(a, b).filter("a < b").distinct())
    labels = None
    while not live.isEmpty():
        both = live.select("a", "b").unionByName(live.selectExpr("b AS a", "a AS b"))
        hooks = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
        parent = staged(hooks.select("node", F.least("node", "low").alias("root")))
        for _ in range(2):
            up = parent.selectExpr("node AS root", "root AS top")
            parent = parent.join(up, "root").select("node", F.col("top").alias("root"))
        parent = staged(parent)
        if labels is None:
            labels = parent
        else:
            up = parent.selectExpr("node AS root", "root AS top")
            moved = labels.join(up, "root", "left")
            labels = staged(moved.select("node", F.coalesce("top", "root").alias("root")))
        pa_, pb_ = parent.selectExpr("node AS a", "root AS ra"), parent.selectExpr("node AS b", "root AS rb")
        moved = live.join(pa_, "a").join(pb_, "b")
        a, b = F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")
        live = staged(moved.filter("ra <> rb").select(a, b).distinct())
    if labels is None:
        return spark.createDataFrame([], "node bigint, root bigint")
    return labels
