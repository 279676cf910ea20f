"""From recognised lines and replies to decided results, as one lazy plan."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evraklab.functions.lang import with_settled
from evraklab.operators.classify import (
    RULES,
    SUBTYPES,
    Rule,
    Subtype,
    near_signals,
    small_rules,
    with_classification,
    with_classification_of,
)
from evraklab.operators.decide import (
    AUTO_APPROVE_MIN_TRUST,
    HIGH_VALUE,
    blank_stage_report,
    final_status,
    flagged_fields,
    overall_trust,
    provisional_status,
    stage_report,
    with_decision,
)
from evraklab.operators.doc_text import document_states
from evraklab.operators.evidence import with_best_lines
from evraklab.operators.extract import (
    evidence_targets,
    read_reply_fields,
    skeleton,
    with_extraction,
)
from evraklab.operators.metrics import metrics_of_pages
from evraklab.operators.replies import parse_replies
from evraklab.operators.validate import with_validation


MANIFEST = ("task_id", "filename", "key_id", "processing_time")
METRICS = ("total_blocks", "total_chars", "page_count", "block_variance", "confidence_variance")


class Outcome(NamedTuple):
    """Decided documents, and those without a single recognised line."""

    results: DataFrame
    rejects: DataFrame


def early_rejects(documents: DataFrame, lines: DataFrame) -> DataFrame:
    """Documents of the manifest that have no line; they are not stored."""
    seen = lines.select("doc_id").distinct()
    return documents.join(seen, "doc_id", "left_anti").withColumns(
        {
            "status": F.lit("FAILED"),
            "overall_trust_score": F.lit(0.0),
            "stages": blank_stage_report(),
        }
    )


def one_of_each(rows: DataFrame) -> DataFrame:
    """One row per document, the greatest by its columns from left to right."""
    rest = [c for c in rows.columns if c != "doc_id"]
    packed = rows.select("doc_id", F.struct(*rest).alias("_row"))
    return packed.groupBy("doc_id").agg(F.max("_row").alias("_row")).select("doc_id", "_row.*")


def process_documents(
    lines: DataFrame,
    replies: DataFrame,
    documents: DataFrame | None = None,
    *,
    entries: str | None = None,
    rules: Sequence[Rule] | DataFrame = RULES,
    subtypes: Sequence[Subtype] = SUBTYPES,
    with_evidence: bool = True,
    fuzzy_evidence: bool = True,
    with_metrics: bool = True,
    auto_approve_min_trust: float = AUTO_APPROVE_MIN_TRUST,
    high_value: float = HIGH_VALUE,
) -> Outcome:
    """Classify, extract, validate and decide every document of ``lines``.

    ``replies`` is (doc_id, reply[, entries]); of several for a document one is taken,
    the greatest. So is one manifest row. ``documents`` optionally supplies (doc_id, task_id, filename, key_id,
    processing_time); without it the document's id is its task.

    ``rules`` are given in code or as a table that ``classify.rules_table`` lays out. A small
    table becomes part of the plan; a large one is joined on what the texts hold of it,
    for which the texts are put together a second time.

    The lines are read once. They are gathered by (doc_id, run, page), and the runs with
    their counts by document, where texts, evidence and metrics are all told from the same
    row; all joins are between tables with one row per document. A reply is parsed once.
    """
    if documents is not None:
        documents = one_of_each(documents)
    reply_columns = ["doc_id", "reply"] + ([entries] if entries else [])
    spread = one_of_each(replies.select(*reply_columns))
    results = results_of(
        document_states(lines),
        spread,
        documents,
        entries=entries,
        rules=rules,
        subtypes=subtypes,
        with_evidence=with_evidence,
        fuzzy_evidence=fuzzy_evidence,
        with_metrics=with_metrics,
        auto_approve_min_trust=auto_approve_min_trust,
        high_value=high_value,
    )
    if documents is None:
        rejects = early_rejects(lines.select("doc_id").limit(0), lines)
    else:
        rejects = early_rejects(documents, lines)
    return Outcome(results, rejects)


def results_of(
    states: DataFrame,
    replies: DataFrame | None = None,
    documents: DataFrame | None = None,
    *,
    entries: str | None = None,
    rules: Sequence[Rule] | DataFrame = RULES,
    subtypes: Sequence[Subtype] = SUBTYPES,
    with_evidence: bool = True,
    fuzzy_evidence: bool = True,
    with_metrics: bool = True,
    auto_approve_min_trust: float = AUTO_APPROVE_MIN_TRUST,
    high_value: float = HIGH_VALUE,
    keep: Sequence[str] = (),
) -> DataFrame:
    """The results of ``process_documents`` from ``document_states`` or ``nested_states``.

    ``replies`` and ``documents`` have one row per document. Without ``replies`` the states
    carry the reply (and its entries), and without ``documents`` the manifest's columns if
    there are any; nothing is joined then. ``keep`` names more columns of the states to keep.
    """
    near = None
    if isinstance(rules, DataFrame):
        few = small_rules(rules)
        if few is None:
            near = near_signals(states, rules)
        else:
            rules = few
    metrics = {}
    if with_metrics:
        states = states.withColumn("metrics", metrics_of_pages(F.col("pages")))
        metrics = {name: F.col("metrics")[name] for name in METRICS}
    states = states.drop("pages")
    if replies is None:
        joined = _read(states, entries)
    else:
        joined = states.join(_read(replies, entries), "doc_id", "left").withColumns(
            {
                "reply_status": F.coalesce("reply_status", F.lit("ERROR")),
                "reply_msg": F.when(F.col("reply_status").isNull(), "no reply").otherwise(
                    F.col("reply_msg")
                ),
            }
        )
    evidence_map = None
    if with_evidence:
        evidence_map = "evidence"
        sought = joined.withColumn("targets", evidence_targets(F.col("reply_fields")))
        entries_of = F.transform("hits", lambda h: F.struct(h["slot"], h["text"]))
        joined = with_best_lines(sought, fuzzy=fuzzy_evidence).withColumn(
            "evidence", F.map_from_entries(entries_of)
        )
    else:
        joined = joined.drop("lines")
    if near is None:
        classified = with_classification(joined, "raw_text", rules, subtypes)
    else:
        classified = with_classification_of(joined.join(near, "doc_id", "left"), "raw_text", subtypes)
    classified = classified.withColumn("category", F.col("classification.domain"))
    extracted = with_extraction(classified, "raw_text", "category", evidence_map)
    return _named(_decided(extracted, auto_approve_min_trust, high_value), documents, metrics, keep)


def _read(df: DataFrame, entries: str | None) -> DataFrame:
    """Put ``reply_status``, ``reply_msg``, ``reply_confidence`` and ``reply_fields`` in the reply's place."""
    kept = [c for c in df.columns if c not in ("reply", entries)]
    parsed = parse_replies(df, "reply", entries)
    return read_reply_fields(parsed).select(
        *kept, "reply_status", "reply_msg", "reply_confidence", "reply_fields"
    )


def _decided(df: DataFrame, auto_approve_min_trust: float, high_value: float) -> DataFrame:
    trusted = with_validation(df).withColumn(
        "trust_score", overall_trust(F.col("mean_confidence"), F.col("reply_status"))
    )
    bare = trusted.withColumn(
        "data", F.coalesce("extraction", skeleton(F.col("category"), F.col("trust_score")))
    ).withColumn("overall_trust_score", F.round("trust_score", 4))
    provisional = bare.withColumn(
        "_status",
        provisional_status(
            F.col("reply_status"), F.col("validation_report.status"), F.col("trust_score")
        ),
    )
    decided = with_decision(
        provisional,
        status=F.col("_status"),
        amount=F.col("data.financial_hierarchy.root_transaction.amount.value"),
        sender=F.col("data.document_analysis.sender.value"),
        receiver=F.col("data.document_analysis.receiver.value"),
        report_status=F.col("validation_report.status"),
        trust=F.col("overall_trust_score"),
        flagged=flagged_fields(F.col("data")),
        auto_approve_min_trust=auto_approve_min_trust,
        high_value=high_value,
    )
    c = F.col("classification")
    return decided.withColumn(
        "status", final_status(F.col("decision_engine.recommended_action"), F.col("_status"))
    ).withColumn(
        "stages",
        stage_report(
            c["domain"], c["document_type"], F.col("reply_status"), F.col("reply_msg")
        ),
    )


def _named(
    df: DataFrame, documents: DataFrame | None, metrics: dict[str, Column], keep: Sequence[str] = ()
) -> DataFrame:
    """Final columns, with the manifest's names where there is one."""
    known = [c for c in MANIFEST if c in (df if documents is None else documents).columns]
    manifest = {
        "task_id": F.col("doc_id").cast("string"),
        "filename": F.lit(None).cast("string"),
        "key_id": F.lit(None).cast("bigint"),
        "processing_time": F.lit(0.0),
    }
    if documents is not None:
        df = df.join(documents.select("doc_id", *known), "doc_id", "left")
    for name in known:
        manifest[name] = F.coalesce(name, manifest[name]) if name != "filename" else F.col(name)

    # Report and decision also travel inside the data record.
    data = F.col("data").withField("validation_report", F.col("validation_report")).withField(
        "decision_engine", F.col("decision_engine")
    )
    kept = df.withColumnRenamed("raw_text", "full_raw_text")
    computed = {
        **manifest,
        "status": F.col("status"),
        "overall_trust_score": F.col("overall_trust_score"),
        "trust_score": F.col("trust_score"),
        "classification": F.col("classification"),
        "stages": F.col("stages"),
        "data": data,
        "validation_report": F.col("validation_report"),
        "decision_engine": F.col("decision_engine"),
        "reply_status": F.col("reply_status"),
        "reply_confidence": F.col("reply_confidence"),
        **metrics,
    }
    return with_settled(kept, computed).select(
        "doc_id",
        "task_id",
        "filename",
        "key_id",
        "status",
        "overall_trust_score",
        "trust_score",
        "classification",
        "stages",
        "data",
        "full_raw_text",
        "processing_time",
        "validation_report",
        "decision_engine",
        "reply_status",
        "reply_confidence",
        *metrics,
        *keep,
    )
