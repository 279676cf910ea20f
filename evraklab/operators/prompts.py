"""Prompts with verified examples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evraklab.functions.json_text import canonical_json
from evraklab.functions.pii import PII_PATTERNS, mask
from evraklab.session import cut_lineage

# The prompt's text, in order of appearance, and the built-in example.
ROLE_TEXT = (
    "You are an Expert Accounting Auditor. Your goal is to extract structured data from OCR text "
    "with 100% precision."
)
GOALS_TEXT = """GOALS:
1. Identify the 'root_transaction' (Final Total Amount).
2. Validate 'root_transaction' against 'written_amount' (text representation).
3. Extract 'adjustments_and_fees' (Sub-items like Tax, Fee, Subtotal).
4. Identify BANKING METADATA: 
   - Look for 'TR' followed by 24 digits (IBAN). 
   - Look for Reference Numbers (Referans, Islem No, Dekont No).
   - Look for the official Transaction Date.

Return ONLY a JSON object matching this schema:
{
    "document_analysis": {
        "type": "STRING", 
        "status": "VERIFIED|REVIEW_REQUIRED",
        "sender": "FULL_NAME",
        "receiver": "FULL_NAME",
        "description": "REASON_FOR_TRANSFER",
        "currency": "CURRENCY_CODE",
        "transaction_id": "REFERENCE_NUMBER",
        "transaction_date": "YYYY-MM-DD",
        "sender_iban": "IBAN_FULL",
        "receiver_iban": "IBAN_FULL"
    },
    "financial_hierarchy": {
        "root_transaction": {"amount": FLOAT, "label": "STRING", "text_confirmation": "STRING", "is_valid": BOOLEAN},
        "adjustments_and_fees": [{"group_name": "STRING", "total_impact": FLOAT, "breakdown": DICT, "math_status": "MATCH|MISMATCH"}]
    },
    "engine_report": {"trust_score": FLOAT, "logic_applied": "Hierarchical_Validation_V3"}
}

CRITICAL: Return ONLY raw JSON. No commentary. No markdown blocks."""
STATIC_EXAMPLES = (
    (
        "BANKING",
        "Para Transferi. Tarih: 22.08.2018. Ref No: 987654321. Tutar: 1.250,00 TL. "
        "Alıcı: Ahmet Yılmaz. IBAN: TR12 0001 0002...",
        '{"document_analysis": {"currency": "TRY", "receiver_iban": "TR1200010002...", '
        '"status": "VERIFIED", "transaction_date": "2018-08-22", "transaction_id": "987654321", '
        '"type": "BANKING_DEKONT"}, "engine_report": {"logic_applied": "StaticFewShot", '
        '"trust_score": 0.99}, "financial_hierarchy": {"adjustments_and_fees": [], '
        '"root_transaction": {"amount": 1250.0, "is_valid": true, "label": "TUTAR", '
        '"text_confirmation": "Bin \\u0130ki Y\\u00fcz Elli"}}}',
    ),
)
SAMPLE_INPUT = "SAMPLE_DOC_TEXT"
TABLE_PREFIX = "T_"

# Bytes of example text up to which the examples are broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024
# Copies of an example row when the join has to shuffle: a category may hold
# most documents, and each copy takes its share of them.
CATEGORY_SALTS = 256


def static_examples(spark: SparkSession) -> DataFrame:
    """Built-in examples (category, rank, input, output)."""
    rows = [(c, i, text, out) for i, (c, text, out) in enumerate(STATIC_EXAMPLES)]
    return spark.createDataFrame(rows, "category string, rank int, input string, output string")


def example_rows(verified: DataFrame) -> DataFrame:
    """Static, then verified examples as (category, ordinal, input, output); duplicates stay.

    ``verified`` comes from ``analytics.verified_examples``; its outputs are decoded and
    written in canonical form. One that is no JSON voids all verified examples of its category.
    """
    own = verified.select(
        F.col("document_type").alias("category"),
        F.col("rank").cast("int").alias("rank"),
        F.when(F.coalesce("raw_text", F.lit("")) != "", F.col("raw_text"))
        .otherwise(F.lit(SAMPLE_INPUT))
        .alias("input"),
        canonical_json(F.col("corrected_json")).alias("output"),
    ).withColumn("bad", F.col("output").isNull())
    voided = own.where("bad").select("category").distinct()
    own = own.join(voided, "category", "left_anti")
    static = static_examples(verified.sparkSession)
    return static.select("category", F.col("rank").alias("ordinal"), "input", "output").unionByName(
        own.select("category", (F.col("rank") + F.lit(1000)).alias("ordinal"), "input", "output")
    )


def example_sets(examples: DataFrame) -> DataFrame:
    """(category, examples): the ordered examples of each category in one row.

    A category has the built-in examples and at most three verified ones.
    """
    return examples.groupBy("category").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("ordinal", "input", "output"))),
            lambda e: F.struct(e["input"].alias("input"), e["output"].alias("output")),
        ).alias("examples")
    )


def render_prompt(
    category: Column, text: Column, tables: Column, examples: Column
) -> Column:
    """The prompt of one document."""
    shots = F.array_join(
        F.transform(
            examples,
            lambda e: F.concat(
                F.lit("\nINPUT: "), e["input"], F.lit("\nOUTPUT: "), e["output"], F.lit("\n---\n")
            ),
        ),
        "",
    )
    table_text = F.coalesce(tables, F.lit(""))
    return F.concat(
        F.lit("\n" + ROLE_TEXT + "\n\n\nCONTEXT:\nDocument Type: "),
        category,
        F.lit("\n"),
        F.when(
            table_text != "",
            F.concat(F.lit("\nTABLE DATA (Detected via Layout Engine):\n"), table_text, F.lit("\n")),
        ).otherwise(F.lit("")),
        F.lit("\n\nFULL OCR TEXT:\n"),
        text,
        F.lit("\n\n"),
        F.when(
            F.size(F.coalesce(examples, F.array().cast("array<struct<input:string,output:string>>")))
            > 0,
            F.concat(F.lit("\nEXAMPLES:\n"), shots, F.lit("\n")),
        ).otherwise(F.lit("")),
        F.lit("\n\n" + GOALS_TEXT),
    )


def _attach_examples(docs: DataFrame, sets: DataFrame) -> DataFrame:
    """Left join on ``category``, whose few values would make a lopsided shuffle.

    The example table is measured: within BROADCAST_BYTES it is broadcast, beyond
    that both sides are salted.
    """
    size = F.sum(
        F.aggregate(
            "examples",
            F.lit(0).cast("long"),
            lambda n, e: n + F.octet_length(e["input"]) + F.octet_length(e["output"]),
        )
    )
    total = sets.agg(size.alias("bytes")).first()["bytes"] or 0
    if total <= BROADCAST_BYTES:
        return docs.join(F.broadcast(sets), "category", "left")
    salted = sets.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(CATEGORY_SALTS - 1))))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(CATEGORY_SALTS)).cast("int")
    return (
        docs.withColumn("_salt", salt).join(salted, ["category", "_salt"], "left").drop("_salt")
    )


def build_prompts(
    docs: DataFrame,
    verified: DataFrame,
    *,
    mask_pii: bool = False,
    patterns: Sequence[tuple[str, str]] = PII_PATTERNS,
) -> DataFrame:
    """(doc_id, category, prompt, entries) for (doc_id, category, text[, tables]) rows.

    ``entries`` holds the placeholders of the text, for the reply. Tables are
    masked apart, with placeholders of their own that no reply restores.
    """
    sets = cut_lineage(example_sets(example_rows(verified)))
    if "tables" not in docs.columns:
        docs = docs.withColumn("tables", F.lit(None).cast("string"))
    joined = _attach_examples(docs.select("doc_id", "category", "text", "tables"), sets)
    if mask_pii:
        masked = joined.withColumn("_m", mask(F.col("text"), patterns)).withColumn(
            "_t", mask(F.col("tables"), patterns, TABLE_PREFIX)["text"]
        )
    else:
        masked = joined.withColumn("_m", mask(F.col("text"), ())).withColumn("_t", F.col("tables"))
    return masked.select(
        "doc_id",
        "category",
        render_prompt(
            F.col("category"), F.col("_m.text"), F.col("_t"), F.col("examples")
        ).alias("prompt"),
        F.col("_m.entries").alias("entries"),
    )
