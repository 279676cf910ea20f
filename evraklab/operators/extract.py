"""From a parsed reply and the document's text to the audited extraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.json_text import (
    amount_of,
    described,
    is_object,
    is_truthy,
    parts_of,
    text_of,
    typed,
)
from evraklab.functions.patterns import all_ibans, first_date, reference_number
from evraklab.schemas import ANALYSIS_FIELDS, EXTRACTION

# What a missing key means, provenance marks, tolerances.
ANALYSIS_DEFAULTS = {"status": "VERIFIED", "currency": "TRY"}
LABEL_DEFAULT = "TUTAR"
CONFIRMATION_DEFAULT = "N/A"
GROUP_DEFAULT = "FEE"
FROM_REPLY = "llm"
FROM_TEXT = "deterministic_fallback"
MATCH_TOLERANCE = 0.05
# Slots of values that get evidence; adjustment i has slot FIRST_ADJUSTMENT + i.
EVIDENCE_SLOTS = {"sender": 0, "receiver": 1, "description": 2, "amount": 3}
FIRST_ADJUSTMENT = 4


def audited(
    value: Column,
    source: Column | str = FROM_REPLY,
    evidence: Column | None = None,
    confidence: float = 1.0,
) -> Column:
    """Wrap a value with its audit trail."""
    return F.struct(
        value.alias("value"),
        F.lit(confidence).alias("confidence"),
        F.lit(True).alias("is_valid"),
        F.lit(False).alias("review_required"),
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        (F.lit(None).cast("string") if evidence is None else evidence).alias("evidence_text"),
        F.lit(None).cast("string").alias("reason_if_flagged"),
    )


NO_ADJUSTMENTS = (
    "array<struct<ok:boolean,group:struct<kind:string,text:string>,"
    "total:struct<text:string,truthy:boolean,amount:double>,breakdown:map<string,double>>>"
)


def _adjustments(values: Column) -> Column:
    """Typed view of the reply's list of adjustment VARIANTs, one lambda per step."""

    def part(x: Column, name: str) -> Column:
        return F.try_variant_get(x, f"$.{name}", "variant")

    def found(x: Column) -> Column:
        return F.struct(
            x.alias("item"),
            part(x, "group_name").alias("group"),
            part(x, "total_impact").alias("total"),
            part(x, "breakdown").alias("breakdown"),
        )

    def open_up(x: Column) -> Column:
        parts = F.try_variant_get(x["breakdown"], "$", "map<string,variant>")
        return F.struct(
            (is_object(x["item"]) & (x["breakdown"].isNull() | is_object(x["breakdown"]))).alias("ok"),
            typed(x["group"]).alias("group"),
            typed(x["total"]).alias("total"),
            F.transform_values(parts, lambda _, y: typed(y)).alias("parts"),
        )

    def read(a: Column) -> Column:
        amounts = F.transform_values(a["parts"], lambda _, t: amount_of(t))
        return F.struct(
            a["ok"].alias("ok"),
            F.struct(
                a["group"]["kind"].alias("kind"), text_of(a["group"]).alias("text")
            ).alias("group"),
            F.struct(
                text_of(a["total"]).alias("text"),
                is_truthy(a["total"]).alias("truthy"),
                amount_of(a["total"]).alias("amount"),
            ).alias("total"),
            F.coalesce(amounts, F.create_map().cast("map<string,double>")).alias("breakdown"),
        )

    return F.transform(F.transform(F.transform(values, found), open_up), read)


ROOT = "$.financial_hierarchy.root_transaction"
LIST = "$.financial_hierarchy.adjustments_and_fees"
PATHS = {
    **{n: f"$.document_analysis.{n}" for n in ANALYSIS_FIELDS},
    "amount": f"{ROOT}.amount",
    "label": f"{ROOT}.label",
    "text_confirmation": f"{ROOT}.text_confirmation",
}
REPORT = "$.engine_report"


def read_reply_fields(df: DataFrame) -> DataFrame:
    """Add ``reply_fields``: typed view of ``reply_json`` (null where that is null).

    ``malformed`` marks a reply whose shape cannot be transformed: a root
    transaction, adjustment or breakdown that is not an object.
    """
    v = F.col("reply_json")
    found = df.select(
        "*",
        *[F.variant_get(v, path, "variant").alias(f"_at_{n}") for n, path in PATHS.items()],
        F.variant_get(v, LIST, "variant").alias("_at_list"),
        F.variant_get(v, ROOT, "variant").isNull().alias("_no_root"),
    )
    opened = found.select(
        *df.columns,
        "_at_list",
        "_no_root",
        *[part.alias(f"_{name}_{n}") for n in PATHS for name, part in parts_of(F.col(f"_at_{n}")).items()],
        F.try_variant_get("_at_list", "$", "array<variant>").alias("_list"),
    )
    # Plain columns: the planner copies a struct's parts into every place that reads one of them.
    at = {n: {name: F.col(f"_{name}_{n}") for name in ("kind", "raw")} for n in PATHS}
    read = opened.withColumn(
        "_adj", F.coalesce(_adjustments(F.col("_list")), F.array().cast(NO_ADJUSTMENTS))
    ).withColumn("_amount", amount_of(at["amount"]))
    # A non-list is only harmless when iterating it yields nothing.
    harmless = (
        F.col("_at_list").isNull()
        | F.col("_list").isNotNull()
        | F.coalesce(F.try_variant_get("_at_list", "$", "string").isin("", "{}"), F.lit(False))
    )
    malformed = (
        ~harmless
        | ~(F.col("_no_root") | is_object(v, ROOT))
        | F.exists("_adj", lambda a: ~a["ok"])
    )
    given = [described(at[n]).alias(n) for n in PATHS]
    fields = F.struct(
        *given,
        F.col("_amount").alias("root_amount"),
        F.col("_adj").alias("adjustments"),
        F.try_variant_get(v, REPORT, "variant").alias("report"),
        malformed.alias("malformed"),
    )
    return read.select(
        *df.columns, F.when(F.col("reply_json").isNotNull(), fields).alias("reply_fields")
    )


def evidence_targets(fields: Column) -> Column:
    """The values of ``reply_fields`` evidence is sought for: array of struct(slot, target)."""
    single = [
        F.when(fields[n]["truthy"], F.struct(F.lit(slot).alias("slot"), fields[n]["text"].alias("target")))
        for n, slot in EVIDENCE_SLOTS.items()
    ]
    listed = F.transform(
        fields["adjustments"],
        lambda a, i: F.when(
            a["total"]["truthy"],
            F.struct((i + F.lit(FIRST_ADJUSTMENT)).alias("slot"), a["total"]["text"].alias("target")),
        ),
    )
    return F.array_compact(F.concat(F.array(*single), listed))


def fallbacks(fields: Column, text: Column, ibans: Column) -> dict[str, Column]:
    """Values of the four fields the text can supply; ``source_of`` tells where each is from.

    Only the first account number found is ever used to fill a single missing
    side, and only when it is not the other side's.
    """

    def given(name: str) -> Column:
        return fields[name]["truthy"]

    def own(name: str) -> Column:
        return fields[name]["text"]

    n = F.size(ibans)
    first, second = F.get(ibans, F.lit(0)), F.get(ibans, F.lit(1))
    neither = ~given("sender_iban") & ~given("receiver_iban")
    sender = (
        F.when(neither & (n >= 2), first)
        .when(given("receiver_iban") & ~given("sender_iban") & (n > 0)
              & (first != own("receiver_iban")), first)
        .otherwise(own("sender_iban"))
    )
    receiver = (
        F.when(neither & (n >= 2), second)
        .when(neither & (n == 1), first)
        .when(given("sender_iban") & ~given("receiver_iban") & (n > 0)
              & (first != own("sender_iban")), first)
        .otherwise(own("receiver_iban"))
    )
    return {
        "transaction_id": F.when(given("transaction_id"), own("transaction_id")).otherwise(
            reference_number(text)
        ),
        "transaction_date": F.when(given("transaction_date"), own("transaction_date")).otherwise(
            first_date(text)
        ),
        "sender_iban": sender,
        "receiver_iban": receiver,
    }


def source_of(field: Column, value: Column) -> Column:
    """Where the value of a field comes from that the text may have filled."""
    filled = ~field["truthy"] & (F.coalesce(value, F.lit("")) != "")
    return F.when(filled, F.lit(FROM_TEXT)).otherwise(F.lit(FROM_REPLY))


def _or_default(field: Column, default: Column | str) -> Column:
    """The default stands in for a missing key, not for a JSON null."""
    value = F.lit(default) if isinstance(default, str) else default
    return F.when(field["kind"] == "MISSING", value).otherwise(field["text"])


def with_extraction(
    df: DataFrame, text: str = "raw_text", category: str = "category", evidence: str | None = None
) -> DataFrame:
    """Add ``extraction``; null where there is no usable or well-formed reply.

    Needs ``reply_fields``. ``evidence`` names a map slot -> line text.
    """
    fields = F.col("reply_fields")
    usable = fields.isNotNull() & ~F.coalesce(fields["malformed"], F.lit(True))

    def proof(slot: Column) -> Column | None:
        return None if evidence is None else F.element_at(F.col(evidence), slot)

    scanned = df.withColumn("_ibans", F.when(usable, all_ibans(F.col(text))))
    filled = fallbacks(fields, F.col(text), F.coalesce("_ibans", F.array().cast("array<string>")))
    found = scanned.withColumn(
        "_filled", F.when(usable, F.struct(*[value.alias(name) for name, value in filled.items()]))
    )

    def analysis_field(name: str) -> Column:
        if name in filled:
            value = F.col(f"_filled.{name}")
            return audited(value, source_of(fields[name], value))
        if name == "type":
            return audited(_or_default(fields["type"], F.col(category)))
        if name in ANALYSIS_DEFAULTS:
            return audited(_or_default(fields[name], ANALYSIS_DEFAULTS[name]))
        return audited(fields[name]["text"], evidence=proof(F.lit(EVIDENCE_SLOTS[name])))

    analysis = F.struct(*[analysis_field(n).alias(n) for n in ANALYSIS_FIELDS])
    root_amount = fields["root_amount"]

    def adjustment(a: Column, i: Column) -> Column:
        total = a["total"]["amount"]
        parts = F.aggregate(F.map_values(a["breakdown"]), F.lit(0.0), lambda s, x: s + x)
        retested = (i == 0) & (root_amount != 0) & ~(F.abs(parts - total) < MATCH_TOLERANCE)
        return F.struct(
            audited(
                F.when(a["group"]["kind"] == "MISSING", GROUP_DEFAULT).otherwise(a["group"]["text"])
            ).alias("group_name"),
            audited(total, evidence=proof(i + F.lit(FIRST_ADJUSTMENT))).alias("total_impact"),
            a["breakdown"].alias("breakdown"),
            F.when(retested, "MISMATCH").otherwise("MATCH").alias("math_status"),
        )

    hierarchy = F.struct(
        F.struct(
            audited(root_amount, evidence=proof(F.lit(EVIDENCE_SLOTS["amount"]))).alias("amount"),
            audited(_or_default(fields["label"], LABEL_DEFAULT)).alias("label"),
            audited(_or_default(fields["text_confirmation"], CONFIRMATION_DEFAULT)).alias(
                "text_confirmation"
            ),
            F.lit(True).alias("is_valid"),
        ).alias("root_transaction"),
        F.transform(fields["adjustments"], adjustment).alias("adjustments_and_fees"),
    )
    built = F.struct(
        analysis.alias("document_analysis"),
        hierarchy.alias("financial_hierarchy"),
        fields["report"].alias("engine_report"),
    ).cast(EXTRACTION)
    return found.withColumn("extraction", F.when(usable, built)).drop("_ibans", "_filled")


def math_status(total: Column, breakdown: Column, tolerance: float = MATCH_TOLERANCE) -> Column:
    """MATCH where the breakdown adds up to the total."""
    parts = F.aggregate(F.map_values(breakdown), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.abs(parts - total) < tolerance, "MATCH").otherwise("MISMATCH")


def skeleton(category: Column, trust: Column) -> Column:
    """Stand-in for a document without an extraction."""

    def mark(value: Column, confidence: float, source: str) -> Column:
        return F.struct(
            value.alias("value"),
            F.lit(confidence).alias("confidence"),
            F.lit(None).cast("boolean").alias("is_valid"),
            F.lit(None).cast("boolean").alias("review_required"),
            F.lit(source).alias("source"),
            F.lit(None).cast("string").alias("evidence_text"),
            F.lit(None).cast("string").alias("reason_if_flagged"),
        )

    types = {f.name: f.dataType for f in EXTRACTION["document_analysis"].dataType.fields}
    known = {
        "type": mark(category, 1.0, "classifier"),
        "status": mark(F.lit("FAILED"), 0.0, "system"),
    }
    analysis = F.struct(
        *[known.get(n, F.lit(None).cast(types[n])).alias(n) for n in ANALYSIS_FIELDS]
    )
    root_type = EXTRACTION["financial_hierarchy"].dataType["root_transaction"].dataType
    root = F.struct(
        mark(F.lit(0.0), 0.0, "system").alias("amount"),
        F.lit(None).cast(root_type["label"].dataType).alias("label"),
        F.lit(None).cast(root_type["text_confirmation"].dataType).alias("text_confirmation"),
        F.lit(False).alias("is_valid"),
    )
    none = F.array().cast(
        EXTRACTION["financial_hierarchy"].dataType["adjustments_and_fees"].dataType
    )
    return F.struct(
        analysis.alias("document_analysis"),
        F.struct(root.alias("root_transaction"), none.alias("adjustments_and_fees")).alias(
            "financial_hierarchy"
        ),
        F.to_variant_object(
            F.struct(F.round(trust, 4).alias("trust_score"), F.lit("SkeletonFallback").alias("logic_applied"))
        ).alias("engine_report"),
    ).cast(EXTRACTION)
