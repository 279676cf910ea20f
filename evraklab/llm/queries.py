"""The thirteen operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evraklab.llm import (
    bpe,
    conversations,
    html_text,
    lm,
    mixing,
    pq,
    quality,
    secrets,
    simhash,
    spelling,
    substring_dedup,
    suffix_dedup,
    toxicity,
)
from evraklab.llm.core import table
from evraklab.llm.oracles import ORACLES

__all__ = ["ORACLES", "QUERIES"]


def _joined(spans, wanted=None):
    kept = F.filter(spans, lambda s: s["kind"].isin(*wanted)) if wanted else spans
    parts = F.transform(kept, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"]))
    return F.array_join(parts, ",")


def op1_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pq.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.removed(table(spark, sf_dir, "documents"))
    gone = F.aggregate("removed", F.lit(0), lambda n, r: n + r["end"] - r["start"])
    return cut.select(
        "doc_id", "n_words", gone.cast("bigint").alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op7_bpe(
    spark: SparkSession, sf_dir: str, vocabulary: str = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    codec = bpe.Codec(spark, bpe.load_ranks(vocabulary), public_tokenizers.PATTERN)
    return codec.encode(docs).select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(codec.decoded(F.col("ids")), 256).alias("decoded_sha256"),
    )


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id",
        *(count(kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(_joined(F.col("spans"), secrets.KINDS[:3]), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As many tokens as the documents hold, mixed to 0.95 of the greatest entropy."""
    docs = table(spark, sf_dir, "documents")
    total = mixing.tokens(docs).agg(F.sum("tokens")).first()[0] or 0
    return mixing.mix(docs, budget=float(total)).drop("row")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversations.damage(table(spark, sf_dir, "conversations"))
    return conversations.report(conversations.edits(turns))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = spelling.runs(table(spark, sf_dir, "documents"))
    return spelling.group(spelling.count(spelling.garble(runs)))


def op13_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_lm,
        op2_html,
        op3_simhash,
        op4_toxicity,
        op5_embeddings,
        op6_substrings,
        op7_bpe,
        op8_secrets,
        op9_quality,
        op10_mixing,
        op11_conversations,
        op12_spelling,
        op13_suffixes,
    )
}
