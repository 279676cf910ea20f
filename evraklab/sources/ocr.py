"""Recogniser output into the line table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evraklab.functions.lang import strip, with_settled
from evraklab.schemas import BOX

LINE = "array<struct<text:string,confidence:double,bbox:array<array<double>>>>"


BOXES = f"array<{BOX.simpleString()}>"


def _zipped(polys: Column, texts: Column, scores: Column) -> Column:
    """Blocks of parallel lists, padded to the longest; blank texts drop out."""
    zipped = F.arrays_zip(
        F.coalesce(polys, F.array().cast(BOXES)).alias("p"),
        F.coalesce(texts, F.array().cast("array<string>")).alias("t"),
        F.coalesce(scores, F.array().cast("array<double>")).alias("s"),
    )
    trimmed = F.transform(
        zipped,
        lambda z: F.struct(
            strip(F.coalesce(z["t"], F.lit(""))).alias("text"),
            F.coalesce(z["s"], F.lit(0.0)).alias("confidence"),
            z["p"].alias("bbox"),
        ),
    )
    return F.filter(trimmed, lambda b: b["text"] != "").cast(LINE)


def blocks_of_parallel_lists(df: DataFrame) -> DataFrame:
    """Add ``blocks`` from ``dt_polys``, ``rec_texts``, ``rec_scores``.

    Lists of unequal length are padded (no box, no text, score 0); blocks with
    blank text are dropped, the others trimmed.
    """
    return df.withColumn(
        "blocks", _zipped(F.col("dt_polys"), F.col("rec_texts"), F.col("rec_scores"))
    )


def blocks_of_pairs(df: DataFrame, column: str = "pairs") -> DataFrame:
    """Add ``blocks`` from an array of struct(box, text, conf); nothing is dropped."""
    return df.withColumn(
        "blocks",
        F.transform(
            column,
            lambda p: F.struct(
                p["text"].alias("text"), p["conf"].alias("confidence"), p["box"].alias("bbox")
            ),
        ).cast(LINE),
    )


# A noncharacter put before JSON strings that begin like a container.
MARK = "\ufdd0"
OBJECT = "struct<dt_polys:array<string>,rec_texts:array<string>,rec_scores:array<string>>"


def _marked(payload: Column) -> Column:
    """Compact JSON text of a payload, in which only containers begin with a bracket.

    ``from_json`` gives containers and strings alike as text; strings that begin with a
    bracket or a brace get ``MARK``, so the first character tells the two apart.
    """
    compact = F.from_json(F.concat(F.lit('{"a":'), payload, F.lit("}")), "struct<a:string>")["a"]
    return F.regexp_replace(compact, r'(?<!\\)"(?=[\[{])', f'"{MARK}')


def _plain(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit(MARK)), F.substring(text, 2, 2**31 - 1)).otherwise(text)


def _score(text: Column) -> Column:
    return text.try_cast("double")


def _is_pair(members: Column) -> Column:
    """``[box, [text, ...]]``, told from two points of a box by the text."""
    return (F.size(members) == 2) & F.startswith(F.get(members, F.lit(1)), F.lit('["'))


def blocks_of_json(df: DataFrame, column: str = "payload") -> DataFrame:
    """Add ``blocks`` from a payload's JSON text, whichever of its shapes the items have.

    The payload is a list. An object in it holds parallel lists, padded to the longest;
    its texts are trimmed and blank ones dropped. An array holds ``[box, [text, conf]]``
    pairs of exactly two members: itself, its members, or the members of its first member;
    nothing of them is dropped. Each item is read by its own shape and all others are
    passed over, as is a payload that is no JSON list. Scores may be numbers or text; what
    is no number counts 0 in parallel lists and null in pairs.
    """
    strings = "array<string>"
    list_of = lambda text: F.from_json(F.when(F.startswith(text, F.lit("[")), text), strings)
    items = F.transform(
        F.from_json(_marked(F.col(column)), strings),
        lambda x: F.struct(
            F.from_json(F.when(F.startswith(x, F.lit("{")), x), OBJECT).alias("lists"),
            list_of(x).alias("members"),
        ),
    )
    items = F.transform(
        items,
        lambda x: F.struct(
            x["lists"].alias("lists"),
            x["members"].alias("members"),
            list_of(F.get(x["members"], F.lit(0))).alias("first"),
        ),
    )

    def lines(x: Column) -> Column:
        nested = F.startswith(F.get(x["members"], F.lit(0)), F.lit("[["))
        level = F.when(nested & ~_is_pair(x["first"]), x["first"]).otherwise(x["members"])
        found = F.when(_is_pair(x["members"]), F.array(x["members"])).otherwise(F.transform(level, list_of))
        pairs = F.filter(
            found, lambda y: (F.size(y) == 2) & F.startswith(F.get(y, F.lit(1)), F.lit("["))
        )
        return F.transform(
            F.transform(
                pairs,
                lambda y: F.struct(
                    F.from_json(F.get(y, F.lit(1)), strings).alias("read"),
                    F.from_json(F.get(y, F.lit(0)), BOX.simpleString()).alias("bbox"),
                ),
            ),
            lambda y: F.struct(
                _plain(F.get(y["read"], F.lit(0))).alias("text"),
                _score(F.get(y["read"], F.lit(1))).alias("confidence"),
                y["bbox"].alias("bbox"),
            ),
        ).cast(LINE)

    def parallel(o: Column) -> Column:
        return _zipped(
            F.transform(o["dt_polys"], lambda p: F.from_json(p, BOX.simpleString())),
            F.transform(o["rec_texts"], _plain),
            F.transform(o["rec_scores"], _score),
        )

    # Settled: exploding ``blocks`` would else test its size, and so parse, before any exchange.
    none = F.array().cast(LINE)
    blocks = F.transform(
        items,
        lambda x: F.when(x["lists"].isNotNull(), parallel(x["lists"])).otherwise(F.coalesce(lines(x), none)),
    )
    return with_settled(df, {"blocks": F.coalesce(F.flatten(blocks), none)})


def lines_of_blocks(df: DataFrame) -> DataFrame:
    """Line table from (doc_id, page, method, blocks), one row per page.

    Line numbers run through the document: a page's first number comes from the block
    counts of the pages before it. Only whole pages are windowed, never their lines, and
    blocks are made once. Rows of equal (doc_id, page) each take the places of all of them;
    rows without one of the two are counted but give no lines.
    """
    pages = W.partitionBy("doc_id").orderBy("page")
    before = F.sum(F.size("blocks")).over(pages.rowsBetween(W.unboundedPreceding, -1))
    placed = df.withColumn("_before", F.coalesce(before, F.lit(0)))
    offsets = F.collect_list("_before").over(W.partitionBy("doc_id", "page"))
    return (
        placed.withColumn("_offsets", offsets)
        .where(F.col("doc_id").isNotNull() & F.col("page").isNotNull())
        .withColumn("offset", F.explode("_offsets"))
        .select("doc_id", "page", "method", "offset", F.posexplode("blocks").alias("pos", "b"))
        .select(
            "doc_id",
            (F.col("offset") + F.col("pos") + 1).cast("int").alias("line_no"),
            "page",
            "b.text",
            "b.confidence",
            "b.bbox",
            "method",
        )
    )


def passes_of_blocks(df: DataFrame) -> DataFrame:
    """One row per recognised block of every pass, for ``metrics.lines_of_best_pass``.

    A pass without a block keeps one row with null text, so that it still counts.
    """
    return df.select(
        "doc_id", "page", "pass_no", "pass_name", F.posexplode_outer("blocks").alias("pos", "b")
    ).select("doc_id", "page", "pass_no", "pass_name", "pos", "b.text", "b.confidence", "b.bbox")


def table_texts(regions: DataFrame) -> DataFrame:
    """(doc_id, tables): the HTML of a document's table regions, in page order.

    ``regions`` is (doc_id, page, region_no, type, html). Regions are gathered
    per page first, then per document, so that pages share the work.
    """
    tables = regions.where((F.col("type") == "table") & (F.coalesce("html", F.lit("")) != ""))
    text = F.format_string("Page %d Table:\nHTML_TABLE:\n%s\n", F.col("page"), F.col("html"))

    def ordered(structs: str):
        return F.array_join(
            F.transform(F.array_sort(F.collect_list(structs)), lambda s: s["text"]), "\n"
        )

    per_page = (
        tables.select("doc_id", "page", F.struct("region_no", text.alias("text")).alias("r"))
        .groupBy("doc_id", "page")
        .agg(ordered("r").alias("text"))
    )
    return (
        per_page.select("doc_id", F.struct("page", "text").alias("p"))
        .groupBy("doc_id")
        .agg(ordered("p").alias("tables"))
    )
