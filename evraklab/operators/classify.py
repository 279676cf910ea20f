"""Keyword classification: domain, family, type and transaction."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evraklab.functions.lang import listed
from evraklab.operators.doc_text import document_texts

UNKNOWN = "UNKNOWN"


class Rule(NamedTuple):
    """A domain, the family it leads to and the signals that speak for it."""

    domain: str
    family: str
    signals: tuple[str, ...]


class Subtype(NamedTuple):
    """Refinement of a domain by one word; the first that occurs applies."""

    domain: str
    word: str
    transaction_type: str
    document_type: str


# The built-in rules in order of precedence.
RULES = (
    Rule(
        "BANKING",
        "RECEIPT",
        (
            "DEKONT", "HAVALE", "EFT", "IBAN", "HESAP NUMARASI", "MÜŞTERİ NUMARASI",
            "MASRAF TUTARI", "BSMV", "TUTAR", "BANKASI",
        ),
    ),
    Rule(
        "RETAIL",
        "INVOICE",
        ("FATURA", "FİŞ", "BELGE NO", "KDV", "TAX", "PERAKENDE", "SATIŞ"),
    ),
)
SUBTYPES = (
    Subtype("BANKING", "HAVALE", "HAVALE", "BANK_TRANSFER_RECEIPT"),
    Subtype("BANKING", "EFT", "EFT", "BANK_TRANSFER_RECEIPT"),
    Subtype("BANKING", "DEKONT", UNKNOWN, "BANK_RECEIPT"),
)
SIGNALS_FOR_FULL_CONFIDENCE = 5.0


def rules_table(spark: SparkSession, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Rules as rows (domain, family, priority, position, signal)."""
    rows = [
        (r.domain, r.family, p, i, s)
        for p, r in enumerate(rules)
        for i, s in enumerate(r.signals)
    ]
    return spark.createDataFrame(
        rows, "domain string, family string, priority int, position int, signal string"
    )


#: Characters of a signal by which texts look it up.
GRAM = 4
#: Rule tables up to so many signals become literals of the plan; larger ones are joined.
LITERAL_SIGNALS = 512
#: Signals with their names up to so many bytes are broadcast to the texts; more are joined by a shuffle.
BROADCAST_BYTES = 4 << 20


def small_rules(table: DataFrame, limit: int = LITERAL_SIGNALS) -> list[Rule] | None:
    """The rules of a table of at most ``limit`` signals, in order of precedence; else None."""
    signals = table.where(F.length("signal") > 0)
    rows = signals.orderBy("priority", "position", "signal").limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    rules: dict[tuple, list[str]] = {}
    for r in rows:
        rules.setdefault((r["priority"], r["domain"], r["family"]), []).append(r["signal"])
    return [Rule(domain, family, tuple(found)) for (_, domain, family), found in rules.items()]


def near_signals(texts: DataFrame, table: DataFrame, text: str = "raw_text") -> DataFrame:
    """(doc_id, near): the signals whose first ``GRAM`` characters stand in the upper-cased text.

    Signals shorter than that are looked up whole. A text gives its distinct grams only, so
    what travels to the signals does not hold the text.
    """
    signals = table.where(F.length("signal") > 0).select(
        F.substring("signal", 1, GRAM).alias("gram"),
        F.struct("priority", "position", "signal", "domain", "family").alias("rule"),
    )
    held = F.sum(sum(F.coalesce(F.octet_length(f"rule.{c}"), F.lit(0)) for c in ("signal", "domain", "family")))
    measured = signals.groupBy(F.length("gram").alias("k")).agg(held.alias("bytes")).collect()  # 1 to GRAM rows
    sizes = [r["k"] for r in measured]
    small = sum(r["bytes"] or 0 for r in measured) <= BROADCAST_BYTES
    upper = texts.select("doc_id", F.upper(F.coalesce(text, F.lit(""))).alias("upper"))

    def grams(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.length("upper") - (k - 1))
        cut = F.transform(starts, lambda i: F.substring("upper", i, k))
        return F.when(F.length("upper") >= k, cut).otherwise(F.array().cast("array<string>"))

    every = F.array_distinct(F.concat(F.array().cast("array<string>"), *[grams(k) for k in sizes]))
    # Named, as the planner guesses both sizes: it would send all grams of the texts through the driver.
    met = F.broadcast(signals) if small else signals.hint("merge")
    found = upper.select("doc_id", F.explode(every).alias("gram")).join(met, "gram")
    return found.groupBy("doc_id").agg(F.collect_set("rule").alias("near"))


def with_classification_of(
    df: DataFrame, text: str = "raw_text", subtypes: Sequence[Subtype] = SUBTYPES
) -> DataFrame:
    """Add ``classification`` from ``near`` (of ``near_signals``), and drop that."""
    upper = df.withColumn("_upper", F.upper(F.coalesce(text, F.lit(""))))
    rules = F.coalesce(
        "near",
        F.array().cast("array<struct<priority:int,position:int,signal:string,domain:string,family:string>>"),
    )
    hits = F.array_sort(F.filter(rules, lambda r: F.contains("_upper", r["signal"])))
    found = upper.withColumn("_hits", hits)
    # Strictly more signals win, so the earliest rule takes a tie.
    counts = F.transform(
        F.array_distinct(F.transform("_hits", lambda r: r["priority"])),
        lambda p: F.struct(
            F.size(F.filter("_hits", lambda r: r["priority"] == p)).alias("n"), (-p).alias("less")
        ),
    )
    picked = found.withColumn("_best", -F.array_max(counts)["less"]).withColumn(
        "_hits", F.filter("_hits", lambda r: r["priority"] == F.col("_best"))
    )
    first = F.get("_hits", F.lit(0))

    def by_word(column: str) -> Column:
        out = F.when(F.lit(False), F.lit(UNKNOWN))
        for s in subtypes:
            hit = (first["domain"] == s.domain) & F.contains("_upper", F.lit(s.word))
            out = out.when(hit, F.lit(getattr(s, column)))
        return out.otherwise(F.lit(UNKNOWN))

    seen = F.coalesce(F.transform("_hits", lambda r: r["signal"]), F.array().cast("array<string>"))
    share = F.round(F.size(seen) / F.lit(SIGNALS_FOR_FULL_CONFIDENCE), 2)
    result = F.struct(
        F.coalesce(first["domain"], F.lit(UNKNOWN)).alias("domain"),
        F.coalesce(first["family"], F.lit(UNKNOWN)).alias("document_family"),
        by_word("document_type").alias("document_type"),
        by_word("transaction_type").alias("transaction_type"),
        F.least(share, F.lit(1.0)).alias("confidence"),
        seen.alias("classification_signals"),
    )
    return picked.withColumn("classification", result).drop("_upper", "_hits", "_best", "near")


def classify_by_table(
    texts: DataFrame,
    table: DataFrame,
    text: str = "raw_text",
    subtypes: Sequence[Subtype] = SUBTYPES,
) -> DataFrame:
    """Classify (doc_id, text) by a table of any number of rules, as ``rules_table`` lays out.

    Null and empty signals never match. Rows: doc_id and the fields of a classification.
    """
    near = near_signals(texts, table, text)
    joined = texts.select("doc_id", text).join(near, "doc_id", "left")
    return with_classification_of(joined, text, subtypes).select("doc_id", "classification.*")


def with_classification(
    df: DataFrame,
    text: str = "raw_text",
    rules: Sequence[Rule] = RULES,
    subtypes: Sequence[Subtype] = SUBTYPES,
) -> DataFrame:
    """Add ``classification`` (a struct) by testing the upper-cased text for the signals.

    Steps are separate projections so that each is computed once per row.
    """
    upper = df.withColumn("_upper", F.upper(F.col(text)))
    seen = upper.withColumn(
        "_found",
        F.struct(
            *[
                listed("string", *[(F.contains("_upper", F.lit(s)), F.lit(s)) for s in r.signals]).alias(f"r{i}")
                for i, r in enumerate(rules)
            ]
        ),
    )
    sizes = [F.size(F.col(f"_found.r{i}")) for i in range(len(rules))]
    most = F.greatest(*sizes, F.lit(0)) if len(sizes) > 1 else sizes[0]
    # Strictly more signals win, so the earliest rule takes a tie.
    pick = F.when(most == 0, F.lit(-1))
    for i, size in enumerate(sizes):
        pick = pick.when(size == most, F.lit(i))
    picked = seen.withColumn("_pick", pick)

    def by_rule(values: list[Column], default: Column) -> Column:
        out = F.when(F.lit(False), default)
        for i, value in enumerate(values):
            out = out.when(F.col("_pick") == i, value)
        return out.otherwise(default)

    domain = by_rule([F.lit(r.domain) for r in rules], F.lit(UNKNOWN))
    signals = by_rule(
        [F.col(f"_found.r{i}") for i in range(len(rules))], F.array().cast("array<string>")
    )

    def by_word(column: str) -> Column:
        out = F.when(F.lit(False), F.lit(UNKNOWN))
        for s in subtypes:
            at = [i for i, r in enumerate(rules) if r.domain == s.domain]
            out = out.when(
                F.col("_pick").isin(at) & F.contains("_upper", F.lit(s.word)),
                F.lit(getattr(s, column)),
            )
        return out.otherwise(F.lit(UNKNOWN))

    result = F.struct(
        domain.alias("domain"),
        by_rule([F.lit(r.family) for r in rules], F.lit(UNKNOWN)).alias("document_family"),
        by_word("document_type").alias("document_type"),
        by_word("transaction_type").alias("transaction_type"),
        F.least(F.round(F.size(signals) / F.lit(SIGNALS_FOR_FULL_CONFIDENCE), 2), F.lit(1.0)).alias(
            "confidence"
        ),
        signals.alias("classification_signals"),
    )
    return picked.withColumn("classification", result).drop("_upper", "_found", "_pick")


def classify(
    lines: DataFrame,
    rules: Sequence[Rule] = RULES,
    subtypes: Sequence[Subtype] = SUBTYPES,
) -> DataFrame:
    """Classify every document of a line table: (doc_id, domain, ... , signals)."""
    return with_classification(document_texts(lines), "raw_text", rules, subtypes).select(
        "doc_id", "classification.*"
    )
