"""Exports: flat CSV rows and invoice XML."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.lang import float_text

# Invoice namespaces, version and currency.
INVOICE_NS = "urn:oasis:names:specification:ubl:schema:xsd:Invoice-2"
AGGREGATE_NS = "urn:oasis:names:specification:ubl:schema:xsd:CommonAggregateComponents-2"
BASIC_NS = "urn:oasis:names:specification:ubl:schema:xsd:CommonBasicComponents-2"
INVOICE_VERSION = "2.1"
INVOICE_CURRENCY = "TRY"
BOM = "﻿"


def _json_key(key: Column) -> Column:
    return F.concat(
        F.lit('"'),
        F.replace(F.replace(key, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')),
        F.lit('"'),
    )


def breakdown_text(breakdown: Column) -> Column:
    """A map of amounts as JSON text with a blank after each mark: ``{"fee": 2.14, "tax": 0.11}``."""
    parts = F.transform(
        F.map_entries(breakdown),
        lambda e: F.concat(_json_key(e["key"]), F.lit(": "), float_text(e["value"])),
    )
    return F.concat(F.lit("{"), F.array_join(parts, ", "), F.lit("}"))


def export_rows(results: DataFrame) -> DataFrame:
    """One row per adjustment of a result, or one row with null adjustment columns."""
    root = F.col("data.financial_hierarchy.root_transaction")
    flat = results.select(
        F.coalesce("filename", F.lit("N/A")).alias("Filename"),
        F.coalesce(root["amount"]["value"], F.lit(0.0)).alias("Total_Amount"),
        F.coalesce(root["label"]["value"], F.lit("")).alias("Label"),
        F.coalesce(root["text_confirmation"]["value"], F.lit("")).alias("Text_Confirmation"),
        F.coalesce("data.document_analysis.type.value", F.lit("UNKNOWN")).alias("Document_Type"),
        F.explode_outer("data.financial_hierarchy.adjustments_and_fees").alias("a"),
    )
    return flat.select(
        "Filename",
        "Total_Amount",
        "Label",
        "Text_Confirmation",
        "Document_Type",
        F.col("a.group_name.value").alias("Adjustment_Group"),
        F.col("a.total_impact.value").alias("Group_Total"),
        F.col("a.math_status").alias("Math_Status"),
        breakdown_text(F.col("a.breakdown")).alias("Breakdown"),
    )


def write_csv(rows: DataFrame, path: str, bom: bool = False) -> None:
    """CSV files with a header; ``bom`` marks its first name for spreadsheet programs."""
    if bom:
        rows = rows.withColumnRenamed(rows.columns[0], BOM + rows.columns[0])
    rows.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path)


def _escaped(text: Column) -> Column:
    out = text
    for sign, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(sign), F.lit(entity))
    return out


def invoice_id(task_id: Column) -> Column:
    """16 upper-case characters drawn from the task's id, equal on every run."""
    return F.upper(F.substring(F.sha2(task_id, 256), 1, 16))


def invoice_xml(task_id: Column, amount: Column, issue_date: date | Column) -> Column:
    """Invoice document of one result, indented by two blanks."""
    issued = F.lit(issue_date.isoformat()) if isinstance(issue_date, date) else issue_date
    payable = float_text(F.coalesce(amount, F.lit(0.0)))

    def basic(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<cbc:{name}>"), _escaped(value), F.lit(f"</cbc:{name}>\n"))

    return F.concat(
        F.lit("<?xml version='1.0' encoding='UTF-8'?>\n"),
        F.lit(f'<Invoice xmlns="{INVOICE_NS}" xmlns:cac="{AGGREGATE_NS}" xmlns:cbc="{BASIC_NS}">\n'),
        F.lit("  "), basic("UBLVersionID", F.lit(INVOICE_VERSION)),
        F.lit("  "), basic("ID", invoice_id(task_id)),
        F.lit("  "), basic("IssueDate", issued),
        F.lit("  <cac:LegalMonetaryTotal>\n"),
        F.lit(f'    <cbc:PayableAmount currencyID="{INVOICE_CURRENCY}">'),
        payable,
        F.lit("</cbc:PayableAmount>\n"),
        F.lit("  </cac:LegalMonetaryTotal>\n</Invoice>\n"),
    )


def export_invoices(results: DataFrame, issue_date: date) -> DataFrame:
    """(task_id, xml) per result."""
    amount = F.col("data.financial_hierarchy.root_transaction.amount.value")
    return results.select("task_id", invoice_xml(F.col("task_id"), amount, issue_date).alias("xml"))


def write_invoices(invoices: DataFrame, path: str) -> None:
    """Text files with one invoice per line; indentation is dropped to keep it there."""
    one_line = F.regexp_replace("xml", r"\n\s*", "")
    invoices.select(one_line.alias("value")).write.mode("overwrite").text(path)
