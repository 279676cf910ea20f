"""Amount strings as recognised from paper: noise repair and locale-aware parse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from evraklab.functions.lang import let

# Characters a recogniser confuses with digits. The euro sign is
# read as a 6; TL, $ and ~ carry no digits and are dropped.
LOOKALIKES = {
    "E": "6", "O": "0", "o": "0", "B": "8", "I": "1", "i": "1", "l": "1",
    "|": "1", "L": "1", "G": "6", "g": "9", "Z": "2", "A": "4", "€": "6",
}
DROPPED_WORD = "TL"
DROPPED_SIGNS = "$~"


def clean_amount(text: Column) -> Column:
    """Digits, dots and commas of an amount string after noise repair; '' for null."""
    lead = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^[eE]\s*", "")
    no_word = F.replace(lead, F.lit(DROPPED_WORD), F.lit(""))
    # translate() deletes the characters that have no counterpart.
    repaired = F.translate(
        no_word, "".join(LOOKALIKES) + DROPPED_SIGNS, "".join(LOOKALIKES.values())
    )
    return F.regexp_replace(repaired, r"(?U)[^\d.,]", "")


def parse_clean_amount(clean: Column) -> Column:
    """Absolute value of a cleaned amount; 0.0 where it cannot be read.

    The marks alone, in order, tell how to read it. Any sequence not listed is
    left as it is: with at most one dot it is a number, otherwise it fails to
    cast, as does a text with more than two marks.
    """
    marks = F.translate(clean, "0123456789", "")
    number = (
        F.when(marks == ",", F.translate(clean, ",", "."))
        .when(marks == ",.", F.translate(clean, ",", ""))
        .when(marks == ".,", F.translate(clean, ",.", "."))
        .otherwise(clean)
    )
    return F.coalesce(F.abs(number.try_cast("double")), F.lit(0.0))


def parse_amount(text: Column) -> Column:
    """Amount of a string: a lone comma is decimal, otherwise the right-most mark is."""
    return let(clean_amount(text), parse_clean_amount)
