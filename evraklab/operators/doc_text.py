"""Document text out of line rows.

``document_texts`` first gathers lines in runs of ``CHUNK_LINES`` consecutive line numbers.
A document that holds a large share of all lines is thereby spread over many
tasks; only the joined runs, which together form the one text cell the result
asks for, meet under the document key. ``document_states``, whose result holds the
lines themselves, gathers them by document at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.lang import joined

CHUNK_LINES = 1024


def chunk_of(line_no: Column, size: int = CHUNK_LINES) -> Column:
    return F.floor(line_no / F.lit(size)).cast("int")


def line_chunks(lines: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """(doc_id, chunk, lines, n_lines, conf_sum): ordered lines of one run."""
    return (
        lines.select(
            "doc_id",
            chunk_of(F.col("line_no"), size).alias("chunk"),
            F.struct("line_no", F.coalesce("text", F.lit("")).alias("text")).alias("line"),
            "confidence",
        )
        .groupBy("doc_id", "chunk")
        .agg(
            F.sort_array(F.collect_list("line")).alias("lines"),
            F.count("*").alias("n_lines"),
            F.sum("confidence").alias("conf_sum"),
        )
    )


def runs_of(lines: DataFrame, size: int = CHUNK_LINES) -> DataFrame:
    """(doc_id, chunk): the runs each document has; reads no text."""
    return lines.select("doc_id", chunk_of(F.col("line_no"), size).alias("chunk")).distinct()


def texts_of_chunks(chunks: DataFrame, separator: str = " ") -> DataFrame:
    """(doc_id, raw_text, n_lines, mean_confidence) out of ``line_chunks``."""
    part = F.struct("chunk", joined(F.col("lines"), "text", separator).alias("text"))
    per_doc = (
        chunks.select("doc_id", part.alias("part"), "n_lines", "conf_sum")
        .groupBy("doc_id")
        .agg(
            F.sort_array(F.collect_list("part")).alias("parts"),
            F.sum("n_lines").alias("n_lines"),
            F.sum("conf_sum").alias("conf_sum"),
        )
    )
    return per_doc.select(
        "doc_id",
        joined(F.col("parts"), "text", separator).alias("raw_text"),
        "n_lines",
        (F.col("conf_sum") / F.col("n_lines")).alias("mean_confidence"),
    )


def document_states(lines: DataFrame, separator: str = " ") -> DataFrame:
    """One row per document with all that is told from its lines, read and moved once.

    (doc_id, raw_text, n_lines, mean_confidence, lines, pages): ``lines`` is the ordered
    array of struct(line_no, text, confidence), ``pages`` one struct(page, blocks, chars, conf_sum,
    conf_n) for each line, ordered by page; metrics add up those of a page. All lines of a
    document meet in its row in any case, so they are gathered by the document at once.
    """
    text = F.coalesce("text", F.lit(""))
    merged = (
        lines.select(
            "doc_id",
            F.struct("line_no", text.alias("text"), "confidence").alias("line"),
            F.struct(
                "page",
                F.lit(1).cast("bigint").alias("blocks"),
                F.length("text").cast("bigint").alias("chars"),
                F.col("confidence").alias("conf_sum"),
                F.col("confidence").isNotNull().cast("bigint").alias("conf_n"),
            ).alias("run"),
            "confidence",
        )
        .groupBy("doc_id")
        .agg(
            F.collect_list("line").alias("lines"),
            F.sort_array(F.collect_list("run")).alias("pages"),
            F.count("*").alias("n_lines"),
            F.count("confidence").alias("known"),
        )
    )
    return _told(merged, separator)


def nested_states(documents: DataFrame, separator: str = " ") -> DataFrame:
    """``document_states`` of documents that carry their ``lines`` in their own row; nothing is moved.

    The other columns stay. Documents without a line are left out. Each line is a run of its
    own in ``pages``.
    """

    def line(l: Column) -> Column:
        text = F.coalesce(l["text"], F.lit(""))
        return F.struct(l["line_no"].alias("line_no"), text.alias("text"), l["confidence"].alias("confidence"))

    def run(l: Column) -> Column:
        return F.struct(
            l["page"].alias("page"),
            F.lit(1).cast("bigint").alias("blocks"),
            F.length(l["text"]).cast("bigint").alias("chars"),
            l["confidence"].alias("conf_sum"),
            l["confidence"].isNotNull().cast("bigint").alias("conf_n"),
        )

    some = documents.where(F.size("lines") > 0)
    merged = some.withColumns(
        {
            "lines": F.transform("lines", line),
            "pages": F.sort_array(F.transform("lines", run)),
            "n_lines": F.size("lines").cast("bigint"),
            "known": F.size(F.filter("lines", lambda l: l["confidence"].isNotNull())),
        }
    )
    return _told(merged, separator)


def _told(merged: DataFrame, separator: str) -> DataFrame:
    """Text, mean confidence and ordered lines of documents whose ``lines`` have been gathered."""
    # The confidences are summed in the order of the lines, so that the mean does not depend
    # on the order in which they were gathered.
    ordered = merged.withColumn("lines", F.sort_array("lines"))
    total = F.aggregate("lines", F.lit(0.0), lambda a, l: a + F.coalesce(l["confidence"], F.lit(0.0)))
    told = ("lines", "pages", "n_lines", "known")
    return ordered.select(
        *[c for c in merged.columns if c not in told],
        joined(F.col("lines"), "text", separator).alias("raw_text"),
        "n_lines",
        F.when(F.col("known") > 0, total / F.col("n_lines")).alias("mean_confidence"),
        "lines",
        "pages",
    )


def document_texts(lines: DataFrame, separator: str = " ") -> DataFrame:
    """One row per document with its whole text, line count and mean confidence."""
    return texts_of_chunks(line_chunks(lines), separator)
