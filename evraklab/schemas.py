"""Row types shared by the operators."""

from __future__ import annotations

from pyspark.sql import types as T

BOX = T.ArrayType(T.ArrayType(T.DoubleType()))

OCR_LINE = T.StructType(
    [
        T.StructField("line_no", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
        T.StructField("text", T.StringType()),
        T.StructField("confidence", T.DoubleType()),
        T.StructField("bbox", BOX),
        T.StructField("method", T.StringType()),
    ]
)

# One row per recognised line; line_no is dense (1..n) within a document.
OCR_LINES = T.StructType([T.StructField("doc_id", T.LongType()), *OCR_LINE.fields])

# One row per document with its lines inside: the streaming landing format.
OCR_DOCUMENT = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("key_id", T.LongType()),
        T.StructField("received_at", T.TimestampType()),
        T.StructField("lines", T.ArrayType(OCR_LINE)),
        T.StructField("reply", T.StringType()),
    ]
)


def audited_field(value_type: T.DataType) -> T.StructType:
    """A value with its audit trail."""
    return T.StructType(
        [
            T.StructField("value", value_type),
            T.StructField("confidence", T.DoubleType()),
            T.StructField("is_valid", T.BooleanType()),
            T.StructField("review_required", T.BooleanType()),
            T.StructField("source", T.StringType()),
            T.StructField("evidence_text", T.StringType()),
            T.StructField("reason_if_flagged", T.StringType()),
        ]
    )


TEXT_FIELD = audited_field(T.StringType())
NUMBER_FIELD = audited_field(T.DoubleType())

ANALYSIS_FIELDS = (
    "type",
    "status",
    "sender",
    "receiver",
    "description",
    "currency",
    "transaction_id",
    "transaction_date",
    "sender_iban",
    "receiver_iban",
)

ANALYSIS = T.StructType([T.StructField(name, TEXT_FIELD) for name in ANALYSIS_FIELDS])

ADJUSTMENT = T.StructType(
    [
        T.StructField("group_name", TEXT_FIELD),
        T.StructField("total_impact", NUMBER_FIELD),
        T.StructField("breakdown", T.MapType(T.StringType(), T.DoubleType())),
        T.StructField("math_status", T.StringType()),
    ]
)

HIERARCHY = T.StructType(
    [
        T.StructField(
            "root_transaction",
            T.StructType(
                [
                    T.StructField("amount", NUMBER_FIELD),
                    T.StructField("label", TEXT_FIELD),
                    T.StructField("text_confirmation", TEXT_FIELD),
                    T.StructField("is_valid", T.BooleanType()),
                ]
            ),
        ),
        T.StructField("adjustments_and_fees", T.ArrayType(ADJUSTMENT)),
    ]
)

# As the model wrote it, whatever its keys.
ENGINE_REPORT = T.VariantType()

EXTRACTION = T.StructType(
    [
        T.StructField("document_analysis", ANALYSIS),
        T.StructField("financial_hierarchy", HIERARCHY),
        T.StructField("engine_report", ENGINE_REPORT),
    ]
)

CHECK = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("details", T.StringType()),
    ]
)

VALIDATION_REPORT = T.StructType(
    [
        T.StructField("status", T.StringType()),
        T.StructField("checks", T.ArrayType(CHECK)),
    ]
)

# The store: 18 columns, with the value a missing column takes.
EXTRACTIONS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("task_id", T.StringType()),
        T.StructField("filename", T.StringType()),
        T.StructField("document_type", T.StringType()),
        T.StructField("trust_score", T.DoubleType()),
        T.StructField("extracted_json", T.StringType()),
        T.StructField("status", T.StringType()),
        T.StructField("is_verified", T.IntegerType()),
        T.StructField("corrected_json", T.StringType()),
        T.StructField("validation_report", T.StringType()),
        T.StructField("processing_time", T.DoubleType()),
        T.StructField("error_type", T.StringType()),
        T.StructField("api_key_id", T.LongType()),
        T.StructField("raw_text", T.StringType()),
        T.StructField("approved_by", T.StringType()),
        T.StructField("approved_at", T.TimestampType()),
        T.StructField("corrected_fields", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
STORE_DEFAULTS = {"status": "SUCCESS", "is_verified": 0}
# Schema versions of the store: these columns came with version 2, all others with 1.
STORE_VERSION = 2
SINCE_VERSION = {
    name: 2
    for name in (
        "task_id status is_verified corrected_json validation_report processing_time error_type"
        " api_key_id raw_text approved_by approved_at corrected_fields"
    ).split()
}
CORRECTIONS = T.StructType(
    [
        T.StructField("task_id", T.StringType()),
        T.StructField("corrected_json", T.StringType()),
        T.StructField("approved_by", T.StringType()),
        T.StructField("corrected_fields", T.StringType()),
        T.StructField("corrected_at", T.TimestampType()),
    ]
)
