"""Mixing sources to target weights by temperature.

Source s holds a share p of all tokens and is given the weight p**a / sum(p**a). A
smaller exponent flattens the mix. The exponent is bisected (many points a pass, each
pass one aggregate over the sources) to the largest that reaches the target entropy,
a fraction of the entropy of equal weights, and then raised as far as the repetition
limit asks: no source may be drawn more than ``max_epochs`` times over.

Weights become token budgets, and budgets become block permutations. In each epoch the
documents of a source stand in the order of a seeded hash; the leading digits of the hash
are blocks, blocks within blocks. A budget takes whole epochs, and of the last one the
leading blocks: the block in which the budget ends is opened into its own blocks, three
levels deep, until what is left undecided is a 2**-24th of the source. Sums over blocks
are all that is shuffled; no source is gathered or sorted.

Tokens are words. A null source is a source of its own, null and empty texts have no
tokens and are drawn with their block, a source of nothing but such texts is drawn once,
and rows of the same id fall into the same block.
The result has one row for each drawn copy; sources whose budget is below their first
document's block give none. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evraklab.llm.core import fresh, map_batches, staged, utf8

ENTROPY = 0.95
MAX_EPOCHS = 4.0
DIGIT = 8  # bits
LEVELS = 3
GRID = 32
PASSES = 6


@dataclass
class Plan:
    """The exponent, and what it gives."""

    exponent: float
    entropy: float
    budget: float


def tokens(docs: DataFrame, row: str | None = None) -> DataFrame:
    """Rows (row, doc_id, source, tokens); ``row`` is a column that numbers the rows, if there is one."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n = pa.array([len(t.split()) for t in utf8(batch.column(3))], pa.int64())
        names = ["row", "doc_id", "source", "tokens"]
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), n], names)

    slim = docs.select(
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), "doc_id",
        F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"),
    )
    kind = slim.schema["doc_id"].dataType.simpleString()
    return map_batches(slim, run, f"row bigint, doc_id {kind}, source string, tokens bigint")


def _key(source: Column) -> Column:
    """A source's name that is never null."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit(""))


def _entropies(sources: DataFrame, total: float, exponents: list[float]) -> list[tuple[float, float]]:
    """(entropy, log of the sum of p**a) of the weights for each exponent, in one pass."""
    log_p = F.log(F.col("tokens") / F.lit(total))
    sums = [F.sum(F.exp(log_p * a)).alias(f"z{i}") for i, a in enumerate(exponents)]
    sums += [F.sum(F.exp(log_p * a) * log_p).alias(f"l{i}") for i, a in enumerate(exponents)]
    row = sources.agg(*sums).first()
    return [
        (math.log(row[f"z{i}"]) - a * row[f"l{i}"] / row[f"z{i}"], math.log(row[f"z{i}"]))
        for i, a in enumerate(exponents)
    ]


def plan(sources: DataFrame, budget: float | None, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS) -> Plan:
    """Find the exponent for sources (key, tokens > 0). Without a budget every source is kept whole.

    Both conditions are monotone in the exponent, so each pass narrows it to the grid
    cell in which the answer changes.
    """
    whole = sources.agg(F.sum("tokens").alias("t"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.count("*").alias("n")).first()
    total, n = float(whole["t"]), whole["n"]
    log_low, log_high = math.log(whole["low"] / total), math.log(whole["high"] / total)
    target = entropy * math.log(n)

    def epochs(a: float, log_z: float) -> float:
        """Copies of the smallest source, which are the most for exponents up to one."""
        if budget is None:  # the largest source is taken once
            return math.exp((a - 1) * (log_low - log_high))
        return math.exp((a - 1) * log_low - log_z) * budget / total

    def good(a: float, h: float, log_z: float) -> bool:
        """Whether the exponent is above the one that is sought."""
        return h < target and epochs(a, log_z) <= max_epochs

    low, high = 0.0, 1.0
    (h0, z0), (h1, z1) = _entropies(sources, total, [low, high])
    if n == 1 or h1 >= target or epochs(1.0, z1) > max_epochs:
        return Plan(1.0, h1, total if budget is None else budget)
    for _ in range(PASSES):
        points = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        above = [good(a, *x) for a, x in zip(points, _entropies(sources, total, points))]
        first = above.index(True) if True in above else GRID
        low, high = points[max(first - 1, 0)], points[first]
    # At the limit of repetition the upper end holds it; at the entropy the lower end does.
    (h_low, z_low), (h_high, z_high) = _entropies(sources, total, [low, high])
    a, h, z = (low, h_low, z_low) if epochs(low, z_low) <= max_epochs else (high, h_high, z_high)
    return Plan(a, h, budget if budget is not None else total * math.exp((1 - a) * log_high + z))


def mix(
    docs: DataFrame, budget: float | None = None, entropy: float = ENTROPY, max_epochs: float = MAX_EPOCHS, seed: int = 1,
    row: str | None = None,
) -> DataFrame:
    """One row per drawn copy: row, doc_id, source, tokens, weight, epoch, block.

    ``budget`` is in tokens; without one it is the least that keeps every document.
    """
    read = staged(tokens(docs, row).withColumn("key", _key(F.col("source"))))
    sources = staged(read.groupBy("key").agg(F.sum("tokens").alias("tokens")).filter("tokens > 0"))
    if sources.isEmpty():
        return read.select("row", "doc_id", "source", "tokens", F.lit(0.0).alias("weight"), F.lit(0).alias("epoch"), F.lit(0).alias("block"))
    found = plan(sources, budget, entropy, max_epochs)
    total = sources.agg(F.sum("tokens")).first()[0]
    share = F.exp(F.lit(found.exponent) * F.log(F.col("tokens") / F.lit(float(total))))
    z = sources.agg(F.sum(share)).first()[0]
    quota = F.col("weight") * F.lit(found.budget) / F.col("tokens")
    # An epoch is whole also where rounding leaves it a hair short.
    weighted = sources.withColumn("weight", share / F.lit(z)).select(
        "key", "weight", F.col("tokens").alias("source_tokens"),
        F.floor(quota + 1e-9).cast("int").alias("whole"),
        (F.greatest(quota - F.floor(quota + 1e-9), F.lit(0.0)) * F.col("tokens")).alias("rest"),
    )

    def digits(epoch: Column) -> Column:
        """The leading bits of a document's place in the permutation of an epoch."""
        hashed = F.xxhash64(F.lit(seed), epoch.cast("int"), F.col("key"), F.col("doc_id").cast("string"))
        return F.shiftrightunsigned(hashed, 64 - DIGIT * LEVELS)

    # A source without a token costs nothing and is taken once.
    marked = read.join(weighted, "key", "left").withColumns(
        {"weight": F.coalesce("weight", F.lit(0.0)), "whole": F.coalesce("whole", F.lit(1))}
    )
    marked = marked.withColumn("place", digits(F.col("whole")))
    # Open the block in which each source's budget ends, level by level.
    cut = weighted.select("key", F.lit(0).cast("bigint").alias("prefix"), "rest")
    for level in range(1, LEVELS + 1):
        here = F.shiftrightunsigned("place", DIGIT * (LEVELS - level))
        inside = read.select("key", "doc_id", "tokens").join(weighted.select("key", "whole"), "key")
        inside = inside.withColumn("place", digits(F.col("whole"))).join(cut, "key")
        inside = inside.filter(F.shiftrightunsigned("place", DIGIT * (LEVELS - level + 1)) == F.col("prefix"))
        blocks = inside.groupBy("key", "rest", here.alias("here")).agg(F.sum("tokens").alias("n"))
        # At most 2**DIGIT blocks a source.
        before = F.sum("n").over(Window.partitionBy("key").orderBy("here")) - F.col("n")
        blocks = blocks.withColumn("left", F.col("rest") - before).filter((F.col("left") >= 0) & (F.col("left") < F.col("n")))
        ends = blocks.groupBy("key").agg(F.min_by("here", "here").alias("prefix"), F.min_by("left", "here").alias("rest"))
        cut = staged(ends)
    cut = cut.select("key", F.col("prefix").alias("stop"))
    drawn = marked.join(cut, "key", "left").withColumn(
        "copies", F.col("whole") + (F.col("place") < F.coalesce("stop", F.lit(0))).cast("int")
    )
    drawn = drawn.filter("copies > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
    block = F.shiftrightunsigned(digits(F.col("epoch")), DIGIT * (LEVELS - 1)).cast("int")
    return drawn.select("row", "doc_id", "source", "tokens", "weight", "epoch", block.alias("block"))


def realise(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as drawn: each row as often as its copies, all columns as they were.

    Rows are numbered once, in a stored copy: positions of another scan may differ.
    """
    row, times = fresh(docs, "row_"), fresh(docs, "times_")
    numbered = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    copies = mix(numbered, row=row, **options).groupBy("row").agg(F.count("*").cast("int").alias("copies"))
    drawn = numbered.join(
        copies.select(F.col("row").alias(row), F.col("copies").alias(times)), row
    )
    repeated = drawn.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times))))
    return repeated.select(*docs.columns)
