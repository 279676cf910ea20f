"""Nearest number to the right of, or below, a label."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.fuzzy import (
    ROUNDING_LENGTH,
    contains_exactly,
    may_reach,
    partial_ratio,
)
from evraklab.functions.patterns import has_digit
from evraklab.operators.doc_text import chunk_of, runs_of

# How far a number may lie from its label.
LABEL_SCORE = 85
REACH_RIGHT = 400.0
REACH_BELOW = 150.0
ALIGNMENT = 60.0


def _centre(box: Column, axis: int) -> Column:
    return (_at(box, 0, axis) + _at(box, 2, axis)) / F.lit(2.0)


def _at(box: Column, corner: int, axis: int) -> Column:
    return F.get(F.get(box, F.lit(corner)), F.lit(axis))


def find_labels(
    lines: DataFrame, keywords: Sequence[str], min_score: int = LABEL_SCORE
) -> DataFrame:
    """(doc_id, keyword_no, box): the first line that matches each keyword."""
    words = [k.upper() for k in keywords]
    wanted = F.array(
        *[F.struct(F.lit(i).alias("no"), F.lit(w).alias("word")) for i, w in enumerate(words)]
    )
    hits = (
        lines.select("doc_id", "line_no", "bbox", F.upper("text").alias("upper"))
        .withColumn(
            "k", F.explode(F.filter(wanted, lambda k: may_reach(k["word"], F.col("upper"), min_score)))
        )
        .withColumn(
            "exact",
            contains_exactly(F.col("k.word"), F.col("upper"))
            & (F.length("k.word") < ROUNDING_LENGTH),
        )
    )
    score = F.coalesce(
        F.when(F.col("exact"), F.lit(100.0)),
        partial_ratio(
            F.when(~F.col("exact"), F.col("k.word")), F.when(~F.col("exact"), F.col("upper"))
        ),
    )
    return (
        hits.select("doc_id", "line_no", "bbox", F.col("k.no").alias("keyword_no"), score.alias("score"))
        .where(F.col("score") > min_score)
        .groupBy("doc_id", "keyword_no")
        .agg(F.min_by("bbox", "line_no").alias("label_box"))
    )


def nearest_numbers(
    lines: DataFrame,
    keywords: Sequence[str],
    alignment: float = ALIGNMENT,
    min_score: int = LABEL_SCORE,
) -> DataFrame:
    """(doc_id, keyword_no, text, distance, line_no, side): the nearest number of the
    first keyword, in list order, that has one.

    Labels are at most one per document and keyword. They are repeated for each
    run of lines their document has and meet the numbers on (doc_id, chunk), so
    the join keys of a huge document are many.
    """
    labels = find_labels(lines, keywords, min_score)
    keyed = lines.withColumn("chunk", chunk_of(F.col("line_no")))
    numbers = keyed.where(has_digit(F.col("text"))).select(
        "doc_id",
        "chunk",
        "line_no",
        "text",
        _at(F.col("bbox"), 0, 0).alias("x0"),
        _at(F.col("bbox"), 0, 1).alias("y0"),
        _centre(F.col("bbox"), 0).alias("xc"),
        _centre(F.col("bbox"), 1).alias("yc"),
    )
    anchors = labels.join(runs_of(lines), "doc_id").select(
        "doc_id",
        "chunk",
        "keyword_no",
        _at(F.col("label_box"), 2, 0).alias("lx"),
        _at(F.col("label_box"), 2, 1).alias("ly"),
        _centre(F.col("label_box"), 0).alias("lxc"),
        _centre(F.col("label_box"), 1).alias("lyc"),
    )
    dx, dy = F.col("x0") - F.col("lx"), F.col("y0") - F.col("ly")
    right = (dx > 0) & (dx < REACH_RIGHT) & (F.abs(F.col("yc") - F.col("lyc")) < alignment)
    below = (dy > 0) & (dy < REACH_BELOW) & (F.abs(F.col("xc") - F.col("lxc")) < alignment)
    # A line may qualify both ways; on equal distance "right" was noted first.
    both = F.least(F.when(right, F.struct(dx.alias("distance"), F.lit(0).alias("side"))),
                   F.when(below, F.struct(dy.alias("distance"), F.lit(1).alias("side"))))
    near = (
        numbers.join(anchors, ["doc_id", "chunk"])
        .where(right | below)
        .select("doc_id", "keyword_no", "line_no", "text", both.alias("near"))
    )
    order = F.struct("keyword_no", "near.distance", "line_no", "near.side")
    kept = F.struct(
        "keyword_no",
        "text",
        F.col("near.distance").alias("distance"),
        "line_no",
        F.when(F.col("near.side") == 0, "right").otherwise("below").alias("side"),
    )
    return near.groupBy("doc_id").agg(F.min_by(kept, order).alias("best")).select("doc_id", "best.*")
