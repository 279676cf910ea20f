"""Pattern scans over a document's text: account numbers, dates, references."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and keywords, in order of preference.
IBAN_LENGTH = 26
IBAN_SHORT_TAIL = r"(?U)TR\d{2}[\s\d]{22,28}"
IBAN_LONG_TAIL = r"(?U)TR\d{2}[\s\d]{22,32}"
IBAN_FORMAT = r"(?U)TR\d{2}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{4}\s?\d{2}"
DATE = r"(?U)\d{2}[./]\d{2}[./]\d{4}"
REFERENCE_KEYWORDS = ("REF", "İŞLEM NO", "DEKONT NO", "SORGULAMA", "FIS NO", "FİŞ NO")
REFERENCE_TAIL = r"[\s:]*(\d{6,20})"


def _ibans(text: Column, pattern: str) -> Column:
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    compact = F.transform(hits, lambda m: F.translate(m, " ", ""))
    found = F.filter(compact, lambda m: F.length(m) == IBAN_LENGTH)
    # The substring test is far cheaper than the pattern and most texts fail it.
    return F.when(F.contains(text, F.lit("TR")), found).otherwise(F.array().cast("array<string>"))


def all_ibans(text: Column) -> Column:
    """Distinct account numbers in order of first occurrence."""
    return F.array_distinct(_ibans(text, IBAN_LONG_TAIL))


def first_iban(text: Column) -> Column:
    return F.get(_ibans(text, IBAN_SHORT_TAIL), F.lit(0))


def _first_match(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match, null without one."""
    return F.get(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(0))


def first_date(text: Column) -> Column:
    """First DD.MM.YYYY or DD/MM/YYYY as YYYY-MM-DD; the calendar is not checked."""
    return F.regexp_replace(_first_match(text, DATE, 0), r"(?s)^(..).(..).(....)$", "$3-$2-$1")


def reference_number(text: Column, keywords: tuple[str, ...] = REFERENCE_KEYWORDS) -> Column:
    """Digits after the first keyword, in keyword order, that is followed by any."""
    return F.coalesce(
        *[
            _first_match(text, rf"(?iU)\Q{word}\E{REFERENCE_TAIL}", 1)
            for word in keywords
        ]
    )


def has_digit(text: Column) -> Column:
    return F.rlike(text, F.lit(r"(?U)\d"))


def is_iban_format(text: Column) -> Column:
    return F.rlike(text, F.lit(IBAN_FORMAT))
