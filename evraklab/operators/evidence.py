"""Best supporting line for each extracted value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.fuzzy import ROUNDING_LENGTH, best_of, contains_exactly, may_reach
from evraklab.functions.lang import with_settled
from evraklab.operators.doc_text import line_chunks, runs_of

MIN_SCORE = 80


def with_best_lines(df: DataFrame, min_score: int = MIN_SCORE, fuzzy: bool = True) -> DataFrame:
    """Add ``hits`` from ``lines`` and ``targets``, and drop these two.

    ``lines`` is an ordered array of struct(line_no, text), ``targets`` an array of
    struct(slot, target); ``hits`` is an array of struct(slot, score, line_no, text).

    The first line that holds the value (or is held by it) scores 100 and needs no
    further look. Where there is none, the lines that can reach ``min_score`` at all go
    to the similarity UDF; ties go to the earliest line.
    """
    kept = [c for c in df.columns if c not in ("lines", "targets")]
    line = "struct<line_no:int,text:string,upper:string>"
    none = F.array().cast(f"array<{line}>")
    found = df.withColumns(
        {
            "lines": F.transform(
                "lines",
                lambda l: F.struct(l["line_no"], l["text"], F.upper(l["text"]).alias("upper")).cast(line),
            ),
            "targets": F.transform(
                F.coalesce("targets", F.array().cast("array<struct<slot:int,target:string>>")),
                lambda t: F.struct(t["slot"].alias("slot"), F.upper(t["target"]).alias("target")),
            ),
        }
    )

    def first_exact(t: Column) -> Column:
        held = F.filter("lines", lambda l: contains_exactly(l["upper"], t["target"]))
        return F.struct(t["slot"].alias("slot"), t["target"].alias("target"), F.get(held, F.lit(0)).alias("exact"))

    def hit(slot: Column, score: Column, at: Column) -> Column:
        return F.struct(slot.alias("slot"), score.alias("score"), at["line_no"].alias("line_no"), at["text"].alias("text"))

    found = with_settled(found, {"looked": F.transform("targets", first_exact)})
    sure = lambda t: t["exact"].isNotNull() & (F.length(t["target"]) < ROUNDING_LENGTH)
    settled = (lambda t: t["exact"].isNotNull()) if not fuzzy else sure
    exact = F.transform(F.filter("looked", settled), lambda t: hit(t["slot"], F.lit(100.0), t["exact"]))
    if not fuzzy:
        return found.select(*kept, exact.alias("hits"))

    near = F.transform(
        F.filter("looked", lambda t: ~sure(t)),
        lambda t: F.struct(
            t["slot"].alias("slot"),
            t["target"].alias("target"),
            F.coalesce(F.filter("lines", lambda l: may_reach(t["target"], l["upper"], min_score)), none).alias("near"),
        ),
    )
    opened = with_settled(
        found.select(*kept, exact.alias("exact"), near.alias("open")).withColumn(
            "open", F.filter("open", lambda t: F.size(t["near"]) > 0)
        ),
        {"exact": F.col("exact"), "open": F.col("open")},
    )
    # Rows without an open value travel to Python as nulls.
    some = F.size("open") > 0
    scored = opened.withColumn(
        "best",
        best_of(
            F.when(some, F.transform("open", lambda t: t["target"])),
            F.when(some, F.transform("open", lambda t: F.transform(t["near"], lambda l: l["upper"]))),
        ),
    )
    similar = F.transform(
        F.filter(F.arrays_zip("open", "best"), lambda z: z["best"]["score"] > min_score),
        lambda z: hit(z["open"]["slot"], z["best"]["score"], F.get(z["open"]["near"], z["best"]["at"])),
    )
    return scored.select(*kept, F.concat("exact", similar).alias("hits"))


def find_evidence(
    chunks: DataFrame, targets: DataFrame, min_score: int = MIN_SCORE, fuzzy: bool = True
) -> DataFrame:
    """(doc_id, slot, evidence_text, score): the line that matches each value best.

    ``chunks`` comes from ``line_chunks``; ``targets`` is (doc_id, chunk, targets)
    where ``targets`` is an array of struct(slot, target), repeated for every
    chunk of the document. The two meet on (doc_id, chunk), the partitioning
    ``line_chunks`` already has, so the lines are not shuffled again and a huge
    document stays spread.
    """
    joined = chunks.select("doc_id", "chunk", "lines").join(targets, ["doc_id", "chunk"])
    hits = with_best_lines(joined, min_score, fuzzy).select("doc_id", F.inline("hits"))
    best = F.max_by("text", F.struct(F.col("score"), -F.col("line_no")))
    return hits.groupBy("doc_id", "slot").agg(
        best.alias("evidence_text"), F.max("score").alias("score")
    )


def evidence_for(
    lines: DataFrame, values: DataFrame, min_score: int = MIN_SCORE, fuzzy: bool = True
) -> DataFrame:
    """Evidence for (doc_id, slot, value) rows; falsy values have none."""
    chunks = line_chunks(lines)
    chunk_ids = runs_of(lines)
    wanted = (
        values.where(F.coalesce(F.col("value"), F.lit("")) != "")
        .groupBy("doc_id")
        .agg(
            F.collect_list(F.struct(F.col("slot"), F.col("value").alias("target"))).alias("targets")
        )
    )
    return find_evidence(chunks, chunk_ids.join(wanted, "doc_id"), min_score, fuzzy)
