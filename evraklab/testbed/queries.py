"""Every operator as a query over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evraklab.functions.amounts import clean_amount, parse_amount
from evraklab.functions.json_text import canonical_json, reply_text
from evraklab.functions.lang import float_text
from evraklab.functions.patterns import all_ibans, first_date, first_iban, reference_number
from evraklab.functions.pii import PII_PATTERNS, mask, unmask
from evraklab.operators import analytics, metrics, proximity
from evraklab.operators.classify import classify, classify_by_table, rules_table
from evraklab.operators.decide import flagged_fields
from evraklab.operators.doc_text import document_texts
from evraklab.operators.evidence import evidence_for
from evraklab.operators.extract import math_status
from evraklab.operators.jobs import latest_stage
from evraklab.operators.prompts import build_prompts, example_rows
from evraklab.operators.replies import parse_replies
from evraklab.operators.throttle import throttle_flags
from evraklab.operators.validate import math_check, with_validation
from evraklab.plans.documents import early_rejects, process_documents
from evraklab.schemas import EXTRACTION, SINCE_VERSION
from evraklab.session import configure
from evraklab.sinks import export, store
from evraklab.sources import ocr, uploads
from evraklab.streaming.documents import process_landed
from evraklab.testbed import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

PHONE_PATTERN = ("PHONE", r"\+1 \(\d{3}\) 555-\d{4}")


def query(fn: Query) -> Query:
    @wraps(fn)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(configure(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return run


def _stamp(column: str = "created_at") -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(column)


# -- store questions --------------------------------------------------------------------


@query
def platform_insights(spark, sf_dir):
    return analytics.platform_insights(fx.fx_extractions(spark, sf_dir), fx.AS_OF)


@query
def dashboard_stats(spark, sf_dir):
    stats = analytics.dashboard_stats(fx.fx_extractions(spark, sf_dir))
    return stats.withColumn("doc_types", F.to_json("doc_types"))


@query
def docs_by_type(spark, sf_dir):
    return analytics.docs_by_type(fx.fx_extractions(spark, sf_dir))


@query
def recent_by_day(spark, sf_dir):
    recent = analytics.recent(fx.fx_extractions(spark, sf_dir), fx.AS_OF)
    return recent.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.round(F.avg("trust_score"), 6).alias("mean_trust")
    )


@query
def history_top(spark, sf_dir):
    rows = analytics.history(fx.fx_extractions(spark, sf_dir))
    return rows.select("task_id", "filename", "status", "trust_score", _stamp())


@query
def pending_reviews(spark, sf_dir):
    rows = analytics.pending_reviews(fx.fx_extractions(spark, sf_dir))
    return rows.select("task_id", "filename", "status", "trust_score", _stamp())


@query
def anomalies_top(spark, sf_dir):
    rows = analytics.anomalies(fx.fx_extractions(spark, sf_dir))
    return rows.withColumn("created_at", _stamp())


@query
def verified_examples(spark, sf_dir):
    rows = analytics.verified_examples(fx.fx_extractions(spark, sf_dir))
    return rows.select("document_type", "rank", "task_id", "raw_text", "corrected_json", _stamp())


@query
def active_only(spark, sf_dir):
    rows = fx.fx_extractions(spark, sf_dir)
    keys = rows.select(F.col("api_key_id").alias("id")).distinct().withColumn(
        "is_active", (F.col("id") % 3 != 0).cast("int")
    )
    return (
        analytics.active_only(rows, keys)
        .groupBy("api_key_id")
        .agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    )


# -- text functions ---------------------------------------------------------------------


def _noisy_amounts(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    plain = F.col("o_totalprice").cast("decimal(12,2)").cast("string")
    comma = F.replace(plain, F.lit("."), F.lit(","))
    whole, cents = F.split_part(plain, F.lit("."), F.lit(1)), F.split_part(plain, F.lit("."), F.lit(2))
    variants = (
        comma,
        F.concat(F.lit("- "), comma, F.lit(" TL")),
        F.concat(F.lit("E "), plain, F.lit(" €")),
        F.replace(F.replace(plain, F.lit("0"), F.lit("O")), F.lit("1"), F.lit("I")),
        F.concat(whole, F.lit(".000,"), cents),
        F.concat(whole, F.lit(",000."), cents),
        F.concat(plain, F.lit(".00,5")),
        F.concat(whole, F.lit(" , "), cents, F.lit(" ~$")),
        F.lit(""),
        F.replace(F.replace(comma, F.lit("8"), F.lit("B")), F.lit("4"), F.lit("A")),
        F.concat(whole, F.lit(",1,2")),
    )
    text = F.element_at(F.array(*variants), (key % len(variants) + 1).cast("int"))
    return o.select(F.col("o_orderkey"), text.alias("noisy"))


@query
def amount_parse(spark, sf_dir):
    return _noisy_amounts(spark, sf_dir).select(
        "o_orderkey",
        clean_amount(F.col("noisy")).alias("clean"),
        parse_amount(F.col("noisy")).alias("amount"),
    )


def _texts(spark, sf_dir):
    return document_texts(fx.fx_ocr_lines(spark, sf_dir))


@query
def iban_scan(spark, sf_dir):
    text = F.col("raw_text")
    return _texts(spark, sf_dir).select(
        "doc_id",
        first_iban(text).alias("first_iban"),
        F.array_join(all_ibans(text), "|").alias("ibans"),
    )


@query
def date_scan(spark, sf_dir):
    return _texts(spark, sf_dir).select("doc_id", first_date(F.col("raw_text")).alias("found_date"))


@query
def txid_scan(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "doc_id", reference_number(F.col("raw_text")).alias("transaction_id")
    )


@query
def document_text(spark, sf_dir):
    return _texts(spark, sf_dir).select(
        "doc_id", "raw_text", "n_lines", F.round("mean_confidence", 6).alias("mean_confidence")
    )


@query
def classify_docs(spark, sf_dir):
    rows = classify(fx.fx_ocr_lines(spark, sf_dir))
    return rows.withColumn("classification_signals", F.array_join("classification_signals", "|"))


@query
def classify_by_rule_table(spark, sf_dir):
    texts = document_texts(fx.fx_ocr_lines(spark, sf_dir))
    rows = classify_by_table(texts, rules_table(spark))
    return rows.withColumn("classification_signals", F.array_join("classification_signals", "|"))


@query
def outcomes_user_rules(spark, sf_dir):
    """The whole plan with a user's rule table: days of the month in five domains, and a letter."""
    nation = fx.table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    rules = nation.select(
        F.concat(F.lit("D"), (key % 5).cast("string")).alias("domain"),
        F.concat(F.lit("F"), (key % 5).cast("string")).alias("family"),
        (key % 5).cast("int").alias("priority"),
        key.cast("int").alias("position"),
        F.when(key == 3, "Y").when(key == 9, "").otherwise(
            F.concat(F.lpad((key + 1).cast("string"), 2, "0"), F.lit("."))
        ).alias("signal"),
    )
    rows = _processed(
        spark, sf_dir, fx.fx_fee_replies(spark, sf_dir), rules=rules, with_evidence=False, with_metrics=False
    )
    c = F.col("classification")
    return rows.select(
        "doc_id",
        c["domain"].alias("domain"),
        c["document_family"].alias("family"),
        c["confidence"].alias("confidence"),
        F.array_join(c["classification_signals"], "|").alias("signals"),
        F.col("data.document_analysis.type.value").alias("type"),
    )


# -- personal data ------------------------------------------------------------------------


def _masked_documents(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "text")
    return d.withColumn("m", mask(F.col("text"), [PHONE_PATTERN]))


@query
def mask_text(spark, sf_dir):
    unnumbered = F.regexp_replace("m.text", r"\[PHONE_\d+\]", "[PHONE]")
    return _masked_documents(spark, sf_dir).select(
        "doc_id", F.md5(unnumbered).alias("masked_md5"), F.size("m.entries").alias("n_entries")
    )


@query
def mask_entries(spark, sf_dir):
    rows = _masked_documents(spark, sf_dir).select("doc_id", F.inline("m.entries"))
    return rows


@query
def mask_iban(spark, sf_dir):
    lines = fx.fx_ocr_lines(spark, sf_dir)
    masked = lines.select("doc_id", mask(F.col("text"), [PII_PATTERNS[1]]).alias("m"))
    return masked.select("doc_id", F.col("m.text").alias("masked"))


@query
def unmask_roundtrip(spark, sf_dir):
    return _masked_documents(spark, sf_dir).select(
        "doc_id", F.md5(unmask(F.col("m.text"), F.col("m.entries"))).alias("text_md5")
    )


# -- recogniser output ----------------------------------------------------------------------


@query
def normalise_ocr(spark, sf_dir):
    pages = ocr.blocks_of_json(fx.fx_payloads(spark, sf_dir)).drop("payload")
    lines = ocr.lines_of_blocks(pages)
    return lines.select(
        "doc_id",
        "line_no",
        "page",
        "text",
        "confidence",
        F.get(F.get("bbox", F.lit(0)), F.lit(0)).alias("x0"),
    )


@query
def table_regions(spark, sf_dir):
    rows = ocr.table_texts(fx.fx_regions(spark, sf_dir))
    return rows.select(
        "doc_id", F.md5("tables").alias("tables_md5"), F.length("tables").alias("n_chars")
    )


@query
def page_metrics(spark, sf_dir):
    return metrics.page_metrics(fx.fx_ocr_lines(spark, sf_dir)).withColumn(
        "mean_confidence", F.round("mean_confidence", 6)
    )


@query
def doc_metrics(spark, sf_dir):
    rows = metrics.document_metrics(metrics.page_metrics(fx.fx_ocr_lines(spark, sf_dir)))
    return rows.withColumns(
        {
            "block_variance": F.round("block_variance", 6),
            "confidence_variance": F.round("confidence_variance", 6),
        }
    )


@query
def pass_metrics(spark, sf_dir):
    return metrics.pass_metrics(ocr.passes_of_blocks(fx.fx_passes(spark, sf_dir)))


@query
def mean_passes(spark, sf_dir):
    passes = metrics.pass_metrics(ocr.passes_of_blocks(fx.fx_passes(spark, sf_dir)))
    return metrics.mean_passes(passes)


@query
def best_pass(spark, sf_dir):
    return metrics.best_pass(
        metrics.pass_metrics(ocr.passes_of_blocks(fx.fx_passes(spark, sf_dir)))
    )


# -- replies, extraction, rules -----------------------------------------------------------


@query
def parse_reply(spark, sf_dir):
    rows = parse_replies(fx.fx_replies(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.col("reply_status").alias("status"),
        "reply_confidence",
        F.expr("variant_get(reply_json, '$.document_analysis.sender', 'string')").alias("sender"),
        F.expr(
            "variant_get(reply_json, '$.financial_hierarchy.root_transaction.amount', 'double')"
        ).alias("amount"),
    )


def _processed(spark, sf_dir, replies, **options):
    lines = fx.fx_ocr_lines(spark, sf_dir)
    return process_documents(lines, replies, **options).results


@query
def fill_fallbacks(spark, sf_dir):
    rows = _processed(
        spark, sf_dir, fx.fx_replies(spark, sf_dir), with_evidence=False, with_metrics=False
    )
    a = F.col("data.document_analysis")
    names = ("transaction_id", "transaction_date", "sender_iban", "receiver_iban")
    read = lambda column: F.when(F.col("reply_status") == "SUCCESS", column)
    columns = [read(a[n]["value"]).alias(n) for n in names]
    sources = [read(a[n]["source"]).alias(f"{n}_source") for n in names]
    return rows.select(
        "doc_id", read(a["type"]["value"]).alias("type"), read(a["currency"]["value"]).alias("currency"),
        *columns, *sources,
    )


@query
def math_check_items(spark, sf_dir):
    rows = fx.fx_adjustments(spark, sf_dir)
    return rows.select(
        "doc_id",
        "l_linenumber",
        "l_partkey",
        math_status(F.col("total_impact"), F.col("breakdown")).alias("math_status"),
        math_check(F.lit("FEE"), F.col("total_impact"), F.col("breakdown"))["status"].alias("check"),
    )


@query
def validate_docs(spark, sf_dir):
    rows = _processed(
        spark, sf_dir, fx.fx_fee_replies(spark, sf_dir), with_evidence=False, with_metrics=False
    )
    checks = F.transform(
        "validation_report.checks",
        lambda c: F.concat_ws("/", c["name"], c["status"], c["details"]),
    )
    first = F.get("data.financial_hierarchy.adjustments_and_fees", F.lit(0))
    return rows.select(
        "doc_id",
        F.col("validation_report.status").alias("status"),
        F.array_join(checks, "; ").alias("checks"),
        first["math_status"].alias("math_status"),
    )


def _decision_columns():
    d = F.col("decision_engine")
    return (
        d["recommended_action"].alias("action"),
        F.round(d["risk_score"], 4).alias("risk_score"),
        d["requires_human_review"].cast("int").alias("human_review"),
        F.array_join(d["decision_reason"], "; ").alias("reasons"),
    )


@query
def decide_docs(spark, sf_dir):
    rows = _processed(
        spark, sf_dir, fx.fx_fee_replies(spark, sf_dir), with_evidence=False, with_metrics=False
    )
    return rows.select("doc_id", "status", *_decision_columns())


@query
def document_outcomes(spark, sf_dir):
    """The whole plan: text, classes, replies, evidence, checks, decision, metrics."""
    rows = _processed(spark, sf_dir, fx.fx_replies(spark, sf_dir))
    return rows.select(
        "doc_id",
        F.col("classification.domain").alias("domain"),
        F.round("overall_trust_score", 4).alias("trust"),
        "status",
        *_decision_columns(),
        F.col("stages")["llm_extraction"]["status"].alias("reply_stage"),
        F.col("stages")["classification"]["status"].alias("class_stage"),
        "total_blocks",
        "page_count",
        F.variant_get("data.engine_report", "$.logic_applied", "string").alias("logic_applied"),
    )


@query
def early_rejected(spark, sf_dir):
    """A manifest of twice the event numbers, of which those without an order have no line."""
    lines = fx.fx_ocr_lines(spark, sf_dir)
    manifest = fx.table(spark, sf_dir, "events").select((F.col("event_id") * 2).alias("doc_id"))
    rows = early_rejects(manifest, lines)
    return rows.select(
        "doc_id",
        "status",
        "overall_trust_score",
        F.col("stages")["ocr"]["status"].alias("ocr_status"),
    )


# -- evidence and proximity -----------------------------------------------------------------


def _party_values(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("slot"), key.alias("value")),
                F.struct(F.lit(1).alias("slot"), F.lit("dekont").alias("value")),
                F.struct(F.lit(2).alias("slot"), F.lit("tarıh 2").alias("value")),
                F.struct(F.lit(3).alias("slot"), F.lit("").alias("value")),
            )
        ).alias("v"),
    ).select("doc_id", "v.*")


@query
def evidence_exact(spark, sf_dir):
    found = evidence_for(
        fx.fx_ocr_lines(spark, sf_dir), _party_values(spark, sf_dir), fuzzy=False
    )
    return found


@query
def evidence_fuzzy(spark, sf_dir):
    """Senders, amounts and misread words against every line, by partial ratio."""
    o = fx.table(spark, sf_dir, "orders")
    values = o.select(
        F.col("o_orderkey").alias("doc_id"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("slot"), float_text(F.col("o_totalprice")).alias("value")),
                F.struct(F.lit(1).alias("slot"), F.lit("Havale Dekonfu").alias("value")),
                F.struct(F.lit(2).alias("slot"), F.lit("SATIS FATURA").alias("value")),
            )
        ).alias("v"),
    ).select("doc_id", "v.*")
    return evidence_for(fx.fx_ocr_lines(spark, sf_dir), values)


@query
def proximity_nearest(spark, sf_dir):
    return proximity.nearest_numbers(fx.fx_boxes(spark, sf_dir), [fx.LABEL]).select(
        "doc_id", "keyword_no", "text", "distance", "side"
    )


# -- writes -----------------------------------------------------------------------------------


def _update_columns(rows):
    return rows.select(
        "task_id",
        "status",
        "is_verified",
        "approved_by",
        "corrected_json",
        "corrected_fields",
        F.date_format("approved_at", "yyyy-MM-dd HH:mm:ss").alias("approved_at"),
    )


@query
def apply_corrections(spark, sf_dir):
    done = store.correct(fx.fx_extractions(spark, sf_dir), fx.fx_corrections(spark, sf_dir))
    return _update_columns(done.rows)


@query
def unmatched_corrections(spark, sf_dir):
    done = store.correct(fx.fx_extractions(spark, sf_dir), fx.fx_corrections(spark, sf_dir))
    return done.unmatched.select("task_id", "corrected_json", "approved_by")


# The newest rows that a user may approve in two of the queries.
APPROVAL_WINDOW = 100


def _approval_requests(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.where(F.col("event_id") % 3 == 0).select(
        F.col("event_id").cast("string").alias("task_id"),
        F.lit("Admin").alias("approved_by"),
        F.col("ts").alias("corrected_at"),
    )


@query
def approve_latest(spark, sf_dir):
    done = store.approve(fx.fx_extractions(spark, sf_dir), _approval_requests(spark, sf_dir), APPROVAL_WINDOW)
    return _update_columns(done.rows)


@query
def approve_not_found(spark, sf_dir):
    done = store.approve(fx.fx_extractions(spark, sf_dir), _approval_requests(spark, sf_dir), APPROVAL_WINDOW)
    return done.unmatched.select("task_id")


@query
def approve_any(spark, sf_dir):
    done = store.approve(fx.fx_extractions(spark, sf_dir), _approval_requests(spark, sf_dir))
    return _update_columns(done.rows)


@query
def append_new_results(spark, sf_dir):
    """Rows an append would add: each new task once, known tasks not at all."""
    rows = fx.fx_extractions(spark, sf_dir)
    known = rows.where(F.col("id") % 3 == 0)
    repeated = rows.select("task_id", "document_type", "trust_score").unionAll(
        rows.where(F.col("id") % 2 == 0).select("task_id", "document_type", "trust_score")
    )
    return store.not_stored(repeated, known)


@query
def insert_if_absent(spark, sf_dir):
    suppliers = fx.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("name")
    )
    customers = fx.table(spark, sf_dir, "customer").select(
        F.concat(F.lit("U"), (F.col("c_custkey") % 1000).cast("string")).alias("name")
    )
    return store.insert_if_absent(suppliers, customers, "name")


@query
def create_keys(spark, sf_dir):
    users = fx.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("id"),
        F.concat(F.lit("U"), F.col("s_suppkey").cast("string")).alias("name"),
    )
    requests = fx.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("request_id"),
        F.concat(F.lit("U"), (F.col("c_custkey") % 1000).cast("string")).alias("user_name"),
        F.lit(None).cast("string").alias("label"),
    )
    _, keys = store.create_api_keys(users, requests)
    return keys.groupBy("label", "is_active").agg(
        F.count("*").alias("n"),
        F.min("key_hash").alias("first_key"),
        F.max("key_hash").alias("last_key"),
        F.countDistinct("user_id").alias("users"),
    )


@query
def stored_corrected(spark, sf_dir):
    """Stored rows of two schema versions, read under the newest of two rounds of corrections."""
    rows = fx.fx_extractions(spark, sf_dir)
    old = F.col("id") % 3 == 0
    unknown = {name: F.when(~old, F.col(name)) for name in SINCE_VERSION if name != "task_id" and name in rows.columns}
    written = rows.withColumns(unknown).withColumns(
        {"status": F.when(F.col("id") % 10 != 1, F.col("status")), "store_version": F.when(old, 1).otherwise(2)}
    )
    corrections = fx.fx_corrections(spark, sf_dir).withColumn("corrected_fields", F.lit('["a"]'))
    return _update_columns(store.current(store.evolve(written), corrections))


@query
def store_rows(spark, sf_dir):
    """Every column of the rows that the whole plan's results are stored as."""
    results = _processed(
        spark, sf_dir, fx.fx_fee_replies(spark, sf_dir), with_evidence=False, with_metrics=False
    )
    rows = store.to_store_rows(results, F.lit(datetime(2024, 1, 31)))
    data = "$.data.document_analysis"
    return rows.select(
        "id", "task_id", "filename", "document_type", F.round("trust_score", 4).alias("trust_score"), "status",
        "is_verified", "corrected_json", "processing_time", "error_type", "api_key_id", F.md5("raw_text").alias("raw_text"),
        "approved_by", F.col("approved_at").cast("string").alias("approved_at"), "corrected_fields", _stamp(),
        F.get_json_object("validation_report", "$.status").alias("report_status"),
        F.get_json_object("extracted_json", "$.status").alias("result_status"),
        F.get_json_object("extracted_json", f"{data}.sender.value").alias("sender"),
        F.get_json_object("extracted_json", "$.data.engine_report").alias("engine_report"),
        F.contains("extracted_json", F.lit('"evidence_text":null')).alias("keeps_nulls"),
    )


@query
def evolve_store(spark, sf_dir):
    """Rows of an older table with fewer columns, read with those of the current one."""
    rows = fx.fx_extractions(spark, sf_dir)
    old = rows.where(F.col("id") % 2 == 0).select("id", "task_id", "document_type", "trust_score")
    new = rows.where(F.col("id") % 2 == 1)
    return store.union_evolved(old, new).select(
        "task_id", "document_type", "status", "is_verified", "raw_text", "processing_time"
    )


@query
def retention_split(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "ts")
    expired, kept = uploads.split_by_age(e, "ts", datetime(2024, 1, 16))
    return (
        expired.select("event_id", F.lit(1).alias("expired"))
        .unionAll(kept.select("event_id", F.lit(0).alias("expired")))
    )


@query
def upload_manifest(spark, sf_dir):
    rows = uploads.manifest(fx.fx_uploads(spark, sf_dir))
    return rows.select(
        "path",
        "filename",
        uploads.file_stem(F.col("path")).alias("stem"),
        "ext",
        F.col("is_pdf").cast("int").alias("is_pdf"),
        "length",
        F.col("accepted").cast("int").alias("accepted"),
    )


@query
def export_rows(spark, sf_dir):
    rows = _processed(
        spark, sf_dir, fx.fx_fee_replies(spark, sf_dir),
        documents=fx.table(spark, sf_dir, "orders").select(
            F.col("o_orderkey").alias("doc_id"),
            F.concat(F.lit("scan_"), F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("filename"),
        ),
        with_evidence=False, with_metrics=False,
    )
    return export.export_rows(rows)


@query
def invoice_xml(spark, sf_dir):
    rows = _processed(
        spark, sf_dir, fx.fx_fee_replies(spark, sf_dir), with_evidence=False, with_metrics=False
    )
    return export.export_invoices(rows, fx.AS_OF)


# -- prompts -------------------------------------------------------------------------------


@query
def example_set(spark, sf_dir):
    verified = analytics.verified_examples(fx.fx_extractions(spark, sf_dir))
    return example_rows(verified)


@query
def prompts(spark, sf_dir):
    lines = fx.fx_ocr_lines(spark, sf_dir)
    classes = classify(lines).select("doc_id", F.col("domain").alias("category"))
    docs = (
        document_texts(lines, "\n")
        .select("doc_id", F.col("raw_text").alias("text"))
        .join(classes, "doc_id")
        .join(ocr.table_texts(fx.fx_regions(spark, sf_dir)), "doc_id", "left")
    )
    verified = analytics.verified_examples(fx.fx_extractions(spark, sf_dir))
    rows = build_prompts(docs, verified)
    return rows.select(
        "doc_id", "category", F.length("prompt").alias("n_chars"), F.md5("prompt").alias("prompt_md5")
    )


@query
def canonical_outputs(spark, sf_dir):
    """JSON as people store it, written the way prompts show it."""
    rows = fx.fx_stored_json(spark, sf_dir)
    return rows.select("doc_id", canonical_json(F.col("stored")).alias("shown"))


# -- paths that the tables above do not reach --------------------------------------------------


@query
def two_accounts(spark, sf_dir):
    """Texts with up to two account numbers, replies with none or one of them."""
    lines, replies = fx.fx_account_lines(spark, sf_dir), fx.fx_account_replies(spark, sf_dir)
    rows = process_documents(lines, replies, with_evidence=False, with_metrics=False).results
    a = F.col("data.document_analysis")
    names = ("sender_iban", "receiver_iban")
    return rows.select(
        "doc_id", *[a[n]["value"].alias(n) for n in names], *[a[n]["source"].alias(f"{n}_source") for n in names]
    )


@query
def party_checks(spark, sf_dir):
    """Both parties, a misread amount and fields marked for review."""
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = k.cast("string")
    party = lambda n: (
        F.when((k + n) % 3 == 0, F.concat(F.lit("IBAN TR12"), F.lpad(text, 22, "0")))
        .when((k + n) % 3 == 1, F.concat(F.lit("a very long name, number "), text))
        .otherwise("short")
    )
    mark = lambda n: F.when(k % n == 0, "true").otherwise("false")
    made = F.concat(
        F.lit('{"document_analysis":{"sender":{"value":"'), party(0), F.lit('","review_required":'), mark(2),
        F.lit('},"receiver":{"value":"'), party(1), F.lit('","review_required":'), mark(5),
        F.lit('}},"financial_hierarchy":{"root_transaction":{"amount":{"value":5,"confidence":'),
        ((k % 11).cast("double") / 10).cast("string"), F.lit('}},"adjustments_and_fees":[]}}'),
    )
    rows = o.select(k.alias("doc_id"), F.from_json(made, EXTRACTION).alias("extraction"))
    checked = with_validation(rows)
    checks = F.transform(
        "validation_report.checks", lambda c: F.concat_ws("/", c["name"], c["status"], c["details"])
    )
    return checked.select(
        "doc_id",
        F.col("validation_report.status").alias("status"),
        F.array_join(checks, "; ").alias("checks"),
        flagged_fields(F.col("extraction")).alias("flagged"),
    )


@query
def masked_replies(spark, sf_dir):
    """Three patterns in their order, and a reply that names a masked value."""
    o = fx.table(spark, sf_dir, "orders")
    text = F.col("o_orderkey").cast("string")
    person = F.concat(F.lit("1"), F.lpad(text, 9, "0"), F.lit("2"))
    account = F.concat(F.lit("TR12 0001 0002 0003 "), F.lpad((F.col("o_orderkey") % 10000).cast("string"), 4, "0"), F.lit(" 0005 06"))
    made = F.concat(
        F.lit("x "), person, F.lit(" y "), account, F.lit(" tel 0532 123 45 67, "), person, F.lit(" or 0555 765 43 21.")
    )
    reply = '{"document_analysis":{"sender":"[IBAN_0]/[PHONE_1]"},"financial_hierarchy":{},"engine_report":{}}'
    rows = o.select(F.col("o_orderkey").alias("doc_id"), F.lit(reply).alias("reply"), mask(made).alias("m"))
    parsed = parse_replies(rows.select("doc_id", "reply", "m.text", "m.entries"), "reply", "entries")
    shown = F.transform("entries", lambda e: F.concat_ws("=", e["placeholder"], e["original"]))
    return parsed.select(
        "doc_id",
        "text",
        F.array_join(shown, ";").alias("entries"),
        F.expr("variant_get(reply_json, '$.document_analysis.sender', 'string')").alias("sender"),
    )


@query
def failed_pages(spark, sf_dir):
    """Metrics of documents of three pages, the last of which nobody could read."""
    lines = fx.fx_ocr_lines(spark, sf_dir)
    pages = fx.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"), F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("page")
    )
    rows = metrics.document_metrics(metrics.page_metrics(lines, pages))
    return rows.withColumns({c: F.round(c, 6) for c in ("block_variance", "confidence_variance")})


@query
def reference_keywords(spark, sf_dir):
    """Texts with several keywords; the first of the list that digits follow counts."""
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    number = F.lpad(k.cast("string"), 8, "0")
    made = F.concat(
        F.lit("Sorgulama: 9"), number, F.lit(" fis no 7"), number,
        F.when(k % 2 == 0, F.concat(F.lit(" DEKONT NO: 5"), number)).otherwise(" DEKONT NO: 123"),
        F.when(k % 3 == 0, F.concat(F.lit(" ref : 3"), number)).otherwise(" REF yok"),
    )
    return o.select(k.alias("doc_id"), reference_number(made).alias("transaction_id"))


@query
def partial_replies(spark, sf_dir):
    """Every second document has no reply row; none is lost."""
    replies = fx.fx_replies(spark, sf_dir)
    rows = _processed(
        spark, sf_dir, replies.where(F.col("doc_id") % 2 == 0), with_evidence=False, with_metrics=False
    )
    return rows.select(
        "doc_id",
        "reply_status",
        F.col("stages")["llm_extraction"]["status"].alias("stage"),
        F.col("stages")["llm_extraction"]["details"].alias("details"),
    )


@query
def broken_examples(spark, sf_dir):
    """A stored output that is no JSON voids the verified examples of its type."""
    rows = fx.fx_extractions(spark, sf_dir).withColumn(
        "corrected_json", F.when(F.col("document_type") == "RETAIL", "{bad").otherwise(F.col("corrected_json"))
    )
    return example_rows(analytics.verified_examples(rows))


@query
def verified_key(spark, sf_dir):
    """Ids by key text: two active keys and one that is switched off."""
    c = fx.table(spark, sf_dir, "customer")
    keys = c.select(
        F.col("c_custkey").alias("id"),
        F.concat(F.lit("sk_"), F.col("c_custkey").cast("string")).alias("key_hash"),
        (F.col("c_custkey") % 3 != 0).cast("int").alias("is_active"),
    )
    found = [analytics.verify_key(keys, f"sk_{n}") for n in (4, 9, 11)]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query
def reply_bodies(spark, sf_dir):
    """Reply texts inside raw response bodies, some without a candidate."""
    o = fx.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    body = F.when(k % 5 == 0, F.lit('{"candidates":[]}')).otherwise(
        F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":"a \\"'), k.cast("string"), F.lit('\\"\\nb"},{"text":"c"}]}}]}'))
    )
    return o.select(k.alias("doc_id"), reply_text(body).alias("reply"))


@query
def landed_rows(spark, sf_dir):
    """Store rows of landed documents, some delivered twice or without a task id."""
    rows = process_landed(fx.fx_landed(spark, sf_dir), with_evidence=False, with_metrics=False)
    return rows.select("task_id", "filename", "document_type", "status", "api_key_id", _stamp())


# -- event streams in batch form -----------------------------------------------------------


@query
def throttled_events(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events").select("event_id", "user_id", "ts")
    flagged = throttle_flags(
        e, "user_id", "ts", "event_id", limit=3, expiry_seconds=12 * 3600, bucket_seconds=86400
    )
    return flagged.select("event_id", "user_id", F.col("denied").cast("int").alias("denied"))


@query
def throttled_one_key(spark, sf_dir):
    """All events under one key that hardly ever pauses."""
    e = fx.table(spark, sf_dir, "events").select("event_id", F.lit("all").alias("key"), "ts")
    flagged = throttle_flags(e, "key", "ts", "event_id", limit=5, expiry_seconds=3600)
    return flagged.select("event_id", F.col("denied").cast("int").alias("denied"))


@query
def latest_stages(spark, sf_dir):
    rows = latest_stage(fx.fx_stage_events(spark, sf_dir), "event_id")
    return rows.withColumn("updated_at", F.date_format("updated_at", "yyyy-MM-dd HH:mm:ss"))
