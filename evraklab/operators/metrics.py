"""Recognition metrics per pass, page and document; choice of the best pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.lang import let


def page_metrics(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Blocks, characters and mean confidence per (doc_id, page).

    With ``pages`` (doc_id, page) given, pages without a line are reported as
    FAILED with zero blocks.
    """
    found = lines.groupBy("doc_id", "page").agg(
        F.count("*").alias("blocks"),
        F.sum(F.length("text")).alias("chars"),
        F.avg("confidence").alias("mean_confidence"),
    )
    if pages is None:
        return found.withColumn("status", F.lit("SUCCESS"))
    return (
        pages.select("doc_id", "page")
        .distinct()
        .join(found, ["doc_id", "page"], "left")
        .select(
            "doc_id",
            "page",
            F.coalesce("blocks", F.lit(0)).alias("blocks"),
            F.coalesce("chars", F.lit(0)).alias("chars"),
            "mean_confidence",
            F.when(F.col("blocks").isNull(), "FAILED").otherwise("SUCCESS").alias("status"),
        )
    )


def document_metrics(per_page: DataFrame) -> DataFrame:
    """Totals per document and the population variance over its readable pages."""
    readable = F.col("status") == "SUCCESS"
    return per_page.groupBy("doc_id").agg(
        F.sum("blocks").alias("total_blocks"),
        F.sum("chars").alias("total_chars"),
        F.count("*").alias("page_count"),
        F.coalesce(F.var_pop(F.when(readable, F.col("blocks"))), F.lit(0.0)).alias("block_variance"),
        F.coalesce(F.var_pop(F.when(readable, F.col("mean_confidence"))), F.lit(0.0)).alias(
            "confidence_variance"
        ),
    )


def _moments(m: Column, value: Column) -> Column:
    """Count, mean and sum of squared deviations with one more value; a null adds nothing."""
    n = m["n"] + 1
    step = value - m["mean"]
    mean = m["mean"] + step / n
    more = F.struct(n.alias("n"), mean.alias("mean"), (m["m2"] + step * (value - mean)).alias("m2"))
    return F.when(value.isNull(), m).otherwise(more)


def metrics_of_pages(pages: Column) -> Column:
    """``document_metrics`` as a struct, from the ``pages`` of ``doc_text.document_states``.

    The runs of a page follow each other; a page is complete where the next one begins.
    """
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("mean"), F.lit(0.0).alias("m2"))
    start = F.struct(
        zero.alias("blocks"),
        zero.alias("conf"),
        F.lit(0).cast("bigint").alias("page_blocks"),
        F.lit(0.0).alias("conf_sum"),
        F.lit(0).cast("bigint").alias("conf_n"),
        F.lit(None).cast("bigint").alias("page"),
        F.lit(True).alias("first"),
    )

    def closed(s: Column) -> tuple[Column, Column]:
        mean = F.when(s["conf_n"] > 0, s["conf_sum"] / s["conf_n"])
        blocks = _moments(s["blocks"], s["page_blocks"].cast("double"))
        return F.when(s["first"], s["blocks"]).otherwise(blocks), _moments(s["conf"], mean)

    def add(s: Column, run: Column) -> Column:
        same = s["page"].eqNullSafe(run["page"]) & ~s["first"]
        blocks, conf = closed(s)
        sums = {"page_blocks": run["blocks"], "conf_sum": F.coalesce(run["conf_sum"], F.lit(0.0)), "conf_n": run["conf_n"]}
        return F.struct(
            F.when(same, s["blocks"]).otherwise(blocks).alias("blocks"),
            F.when(same, s["conf"]).otherwise(conf).alias("conf"),
            *(F.when(same, s[name] + x).otherwise(x).alias(name) for name, x in sums.items()),
            run["page"].cast("bigint").alias("page"),
            F.lit(False).alias("first"),
        )

    def finish(s: Column) -> Column:
        blocks, conf = closed(s)
        return F.struct(blocks.alias("blocks"), conf.alias("conf"))

    def total(name: str) -> Column:
        known = F.filter(F.transform(pages, lambda r: r[name]), lambda x: x.isNotNull())
        summed = F.aggregate(known, F.lit(0).cast("bigint"), lambda a, x: a + x)
        return F.when(F.size(known) > 0, summed).alias(f"total_{name}")

    def spread(moments: Column) -> Column:
        return F.when(moments["n"] > 0, moments["m2"] / moments["n"]).otherwise(F.lit(0.0))

    return let(
        F.aggregate(pages, start, add, finish),
        lambda s: F.struct(
            total("blocks"),
            total("chars"),
            s["blocks"]["n"].alias("page_count"),
            spread(s["blocks"]).alias("block_variance"),
            spread(s["conf"]).alias("confidence_variance"),
        ),
    )


def pass_metrics(blocks: DataFrame) -> DataFrame:
    """Blocks and mean confidence per (doc_id, page, pass_no); 4 decimals."""
    return blocks.groupBy("doc_id", "page", "pass_no", "pass_name").agg(
        F.count("confidence").alias("blocks"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("confidence"),
    )


def mean_passes(passes: DataFrame) -> DataFrame:
    """Mean number of passes a page took, per document."""
    per_page = passes.groupBy("doc_id", "page").agg(F.count("*").alias("n"))
    return per_page.groupBy("doc_id").agg(F.avg("n").alias("avg_passes"))


def best_pass(passes: DataFrame) -> DataFrame:
    """The pass kept per page: the first with any block, else the first tried.

    A pass without blocks never has more blocks than another one, so "most
    blocks, earliest on ties" among empty passes is the earliest.
    """
    rank = F.struct(F.col("blocks") > 0, -F.col("pass_no"))
    kept = F.struct("pass_no", "pass_name", "blocks", "confidence")
    return (
        passes.groupBy("doc_id", "page")
        .agg(F.max_by(kept, rank).alias("best"))
        .select("doc_id", "page", "best.*")
    )


def lines_of_best_pass(blocks: DataFrame) -> DataFrame:
    """Blocks of the kept pass of each page, with the pass name as ``method``."""
    best = best_pass(pass_metrics(blocks)).select("doc_id", "page", "pass_no")
    return blocks.join(best, ["doc_id", "page", "pass_no"], "left_semi").withColumnRenamed(
        "pass_name", "method"
    )
