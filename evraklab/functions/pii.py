"""Masking of personal data by ordered patterns, and its reversal."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from evraklab.functions.lang import let

# Entity names and patterns, in order of application. (?U) gives
# the word boundary its Unicode meaning.
PII_PATTERNS = (
    ("TC_KIMLIK", r"(?U)\b[1-9]{1}[0-9]{9}[02468]{1}\b"),
    ("IBAN", r"(?U)\bTR\d{2}\s?(?:\d{4}\s?){5}\d{2}\b"),
    ("PHONE", r"(?U)\b(?:\+90|0)?\s?5\d{2}\s?\d{3}\s?\d{2}\s?\d{2}\b"),
)


def _mask_one(state: Column, name: str, pattern: str, prefix: str) -> Column:
    """Apply one pattern to ``state`` = struct(text, entries)."""

    def numbered(match: Column, i: Column) -> Column:
        placeholder = F.concat(F.lit(f"[{prefix}{name}_"), i.cast("string"), F.lit("]"))
        return F.struct(placeholder.alias("placeholder"), match.alias("original"))

    matches = F.array_distinct(F.regexp_extract_all(state["text"], F.lit(pattern), F.lit(0)))
    return let(
        F.transform(matches, numbered),
        lambda found: F.struct(
            F.aggregate(
                found, state["text"], lambda t, e: F.replace(t, e["original"], e["placeholder"])
            ).alias("text"),
            F.concat(state["entries"], found).alias("entries"),
        ),
    )


def _step(name: str, pattern: str, prefix: str) -> Callable[[Column], Column]:
    return lambda state: _mask_one(state, name, pattern, prefix)


def mask(
    text: Column,
    patterns: Sequence[tuple[str, str]] = PII_PATTERNS,
    prefix: str = "",
) -> Column:
    """struct(text, entries): masked text and the placeholders in order of creation.

    Each pattern scans the text the earlier ones left. A pattern's matches are
    numbered in order of first occurrence.
    """
    state = F.struct(
        F.coalesce(text, F.lit("")).alias("text"),
        F.array().cast("array<struct<placeholder:string,original:string>>").alias("entries"),
    )
    for name, pattern in patterns:
        state = let(state, _step(name, pattern, prefix))
    return state


def unmask(text: Column, entries: Column) -> Column:
    """Put the originals back, in order of creation."""
    return F.aggregate(
        F.coalesce(entries, F.array().cast("array<struct<placeholder:string,original:string>>")),
        text,
        lambda t, e: F.replace(t, e["placeholder"], e["original"]),
    )


def mapping(entries: Column) -> Column:
    """The placeholders as a map."""
    return F.map_from_entries(entries)
