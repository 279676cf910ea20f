"""Cross-checks of an extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.lang import float_text, let, listed
from evraklab.functions.patterns import is_iban_format
from evraklab.schemas import VALIDATION_REPORT

# Tolerances and thresholds of the checks.
SUM_TOLERANCE = 0.01
LONG_NAME = 20
MIN_AMOUNT_CONFIDENCE = 0.6
CHECK = "struct<name:string,status:string,details:string>"


def _check(name: Column, status: Column, details: Column) -> Column:
    return F.struct(name.alias("name"), status.alias("status"), details.alias("details"))


def math_check(group: Column, total: Column, breakdown: Column) -> Column:
    """PASS or FAIL for a non-empty breakdown, null for an empty one."""
    parts = F.aggregate(F.map_values(breakdown), F.lit(0.0), lambda s, x: s + x)

    def with_sum(s: Column) -> Column:
        ok = F.abs(s - total) < SUM_TOLERANCE
        lead = F.when(ok, F.lit("Math matches for ")).otherwise(F.lit("Math MISMATCH for "))
        between = F.when(ok, F.lit(" == ")).otherwise(F.lit(" vs "))
        return _check(
            F.concat(F.lit("math_check_"), group),
            F.when(ok, "PASS").otherwise("FAIL"),
            F.concat(lead, group, F.lit(": "), float_text(s), between, float_text(total)),
        )

    return F.when(F.size(F.map_keys(breakdown)) > 0, let(parts, with_sum))


def _party_check(name: str, value: Column) -> tuple[Column, Column]:
    """Only a party that looks like an account number is checked for its format."""
    text = F.coalesce(value, F.lit("None"))
    ok = is_iban_format(text)
    return F.contains(text, F.lit("IBAN")) | (F.length(text) > LONG_NAME), _check(
        F.lit(f"iban_format_{name}"),
        F.when(ok, "PASS").otherwise("WARNING"),
        F.when(ok, f"Valid TR IBAN found for {name}").otherwise(
            f"Possible IBAN detected for {name} but format is non-standard"
        ),
    )


def with_validation(df: DataFrame, extraction: str = "extraction") -> DataFrame:
    """Add ``validation_report``: struct(status, checks), null where there is no extraction.

    The worst check decides the status: FAIL, then WARNING.
    """
    analysis = F.col(f"{extraction}.document_analysis")
    hierarchy = F.col(f"{extraction}.financial_hierarchy")
    confidence = F.coalesce(
        hierarchy["root_transaction"]["amount"]["confidence"], F.lit(1.0)
    )
    sums = F.transform(
        hierarchy["adjustments_and_fees"],
        lambda a: math_check(
            F.coalesce(a["group_name"]["value"], F.lit("None")),
            F.coalesce(a["total_impact"]["value"], F.lit(0.0)),
            a["breakdown"],
        ),
    )
    others = listed(
        CHECK,
        _party_check("sender", analysis["sender"]["value"]),
        _party_check("receiver", analysis["receiver"]["value"]),
        (
            confidence < MIN_AMOUNT_CONFIDENCE,
            _check(
                F.lit("low_confidence_warning"),
                F.lit("WARNING"),
                F.format_string("Primary amount has low OCR confidence (%.2f)", confidence),
            ),
        ),
    )
    checked = df.withColumn("_checks", F.concat(F.array_compact(sums), others))
    states = F.col("_checks")["status"]
    status = (
        F.when(F.array_contains(states, "FAIL"), "ERROR")
        .when(F.array_contains(states, "WARNING"), "WARNING")
        .otherwise("SUCCESS")
    )
    report = F.struct(status.alias("status"), F.col("_checks").alias("checks"))
    return checked.withColumn(
        "validation_report",
        F.when(F.col(extraction).isNotNull(), report).cast(VALIDATION_REPORT),
    ).drop("_checks")
