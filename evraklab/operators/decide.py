"""Trust, decision, final status and stage report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.lang import float_text, listed
from evraklab.schemas import ANALYSIS_FIELDS

# Weights and thresholds of the rules.
WEIGHT_RECOGNITION = 0.7
WEIGHT_REPLY = 0.3
AUTO_APPROVE_MIN_TRUST = 0.90
HIGH_VALUE = 100000.0
LOW_TRUST = 0.6


def overall_trust(mean_confidence: Column, reply_status: Column) -> Column:
    reply_ok = F.when(reply_status == "ERROR", 0.0).otherwise(1.0)
    return mean_confidence * WEIGHT_RECOGNITION + reply_ok * WEIGHT_REPLY


def flagged_fields(extraction: Column) -> Column:
    """Number of analysis fields marked for review."""
    analysis = extraction["document_analysis"]
    marks = [F.coalesce(analysis[n]["review_required"], F.lit(False)) for n in ANALYSIS_FIELDS]
    return sum((m.cast("int") for m in marks), F.lit(0))


def provisional_status(reply_status: Column, report_status: Column, trust: Column) -> Column:
    """Status before the decision: low trust and findings outrank a failed reply."""
    return (
        F.when(trust < LOW_TRUST, "REVIEW_REQUIRED")
        .when(report_status.isin("WARNING", "ERROR"), "REVIEW_REQUIRED")
        .when(reply_status == "ERROR", "PARTIAL_FAILURE")
        .otherwise("SUCCESS")
    )


def final_status(action: Column, provisional: Column) -> Column:
    """A decision of REVIEW_REQUIRED leaves the provisional status as it is."""
    return (
        F.when(action == "REJECT", "FAILED")
        .when(action == "ESCALATE", "REVIEW_REQUIRED")
        .when(action.isin("AUTO_APPROVE", "AUTO_BOOK"), "SUCCESS")
        .otherwise(provisional)
    )


def with_decision(
    df: DataFrame,
    *,
    status: Column,
    amount: Column,
    sender: Column,
    receiver: Column,
    report_status: Column,
    trust: Column,
    flagged: Column,
    ocr_status: Column | None = None,
    auto_approve_min_trust: float = AUTO_APPROVE_MIN_TRUST,
    high_value: float = HIGH_VALUE,
) -> DataFrame:
    """Add ``decision_engine``: action, risk and reasons; the first group of rules that
    holds wins.

    ``trust`` is the score rounded to four decimals.
    """
    has_sender = F.coalesce(sender, F.lit("")) != ""
    has_receiver = F.coalesce(receiver, F.lit("")) != ""
    value = F.coalesce(amount, F.lit(0.0))
    failed = F.coalesce(status == "FAILED", F.lit(False))
    if ocr_status is not None:
        failed = failed | F.coalesce(ocr_status == "FAILED", F.lit(False))
    escalations = listed(
        "string",
        (
            value >= high_value,
            F.concat(
                F.lit("Transaction amount ("),
                float_text(value),
                F.lit(") exceeds escalation threshold"),
            ),
        ),
        (
            report_status == "ERROR",
            F.lit("Severe mathematical or logical mismatch detected in validation"),
        ),
        (
            ~has_sender & ~has_receiver,
            F.lit("Both sender and receiver are missing from extraction"),
        ),
    )
    doubts = listed(
        "string",
        (
            trust < auto_approve_min_trust,
            F.format_string("Trust score (%.2f) is below auto-approval threshold", trust),
        ),
        (
            ~report_status.eqNullSafe(F.lit("SUCCESS")),
            F.concat(
                F.lit("Validation report status is "),
                F.coalesce(report_status, F.lit("None")),
            ),
        ),
        (
            flagged > 0,
            F.concat(
                F.lit("Extraction contains "),
                flagged.cast("string"),
                F.lit(" flagged fields requiring review"),
            ),
        ),
    )

    def result(action: Column, risk: Column, review: bool, reasons: Column) -> Column:
        return F.struct(
            action.alias("recommended_action"),
            risk.cast("double").alias("risk_score"),
            F.lit(review).alias("requires_human_review"),
            F.lit(not review).alias("auto_process_allowed"),
            reasons.alias("decision_reason"),
        )

    def one_reason(text: str) -> Column:
        return F.array(F.lit(text))

    booked = F.when(has_sender & has_receiver, "AUTO_BOOK").otherwise("AUTO_APPROVE")
    up, doubt = F.col("_up"), F.col("_doubt")
    decision = (
        F.when(
            failed,
            result(
                F.lit("REJECT"), F.lit(1.0), True,
                one_reason("OCR stage failed or document status is FAILED"),
            ),
        )
        .when(
            value <= 0,
            result(
                F.lit("REJECT"), F.lit(0.95), True,
                one_reason("Root transaction amount is missing or invalid"),
            ),
        )
        .when(F.size(up) > 0, result(F.lit("ESCALATE"), F.lit(0.85), True, up))
        .when(
            F.size(doubt) == 0,
            result(
                booked, F.round(F.lit(1.0) - trust, 4), False,
                one_reason("High trust score and clean validation check"),
            ),
        )
        .otherwise(
            result(
                F.lit("REVIEW_REQUIRED"),
                F.round(F.lit(0.4) + (F.lit(1.0) - trust) * 0.4, 4),
                True,
                F.concat(
                    doubt,
                    one_reason(
                        "Document requires manual verification due to warnings or moderate confidence"
                    ),
                ),
            )
        )
    )
    return (
        df.select("*", escalations.alias("_up"), doubts.alias("_doubt"))
        .withColumn("decision_engine", decision)
        .drop("_up", "_doubt")
    )


def stage_report(
    domain: Column, document_type: Column, reply_status: Column, reply_msg: Column
) -> Column:
    """map stage -> struct(status, details) of a document that had text."""

    def stage(status: Column, details: Column) -> Column:
        return F.struct(status.alias("status"), details.cast("string").alias("details"))

    none = F.lit(None)
    return F.create_map(
        F.lit("file_processing"), stage(F.lit("SUCCESS"), none),
        F.lit("ocr"), stage(F.lit("SUCCESS"), none),
        F.lit("classification"),
        stage(
            F.when(domain != "UNKNOWN", "SUCCESS").otherwise("PARTIAL_SUCCESS"),
            F.concat(F.lit("Domain: "), domain, F.lit(" | Type: "), document_type),
        ),
        F.lit("llm_extraction"),
        stage(
            F.when(reply_status == "ERROR", "FAILED").otherwise("SUCCESS"),
            F.when(reply_status == "ERROR", reply_msg),
        ),
    )


BLANK_DETAILS = "Document appears blank or unreadable after 3-tier processing."


def blank_stage_report() -> Column:
    """Stages of a document without a single line: it goes no further than recognition."""
    waiting = F.struct(
        F.lit("NOT_STARTED").alias("status"), F.lit(None).cast("string").alias("details")
    )
    done = F.struct(F.lit("SUCCESS").alias("status"), F.lit(None).cast("string").alias("details"))
    return F.create_map(
        F.lit("file_processing"), done,
        F.lit("ocr"), F.struct(F.lit("FAILED").alias("status"), F.lit(BLANK_DETAILS).alias("details")),
        F.lit("classification"), waiting,
        F.lit("llm_extraction"), waiting,
    )
