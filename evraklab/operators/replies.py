"""Model replies: cut, un-mask, parse, check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evraklab.functions.json_text import cut_json, is_object
from evraklab.functions.lang import listed
from evraklab.functions.pii import unmask

# The objects a reply must hold.
REQUIRED_OBJECTS = ("document_analysis", "financial_hierarchy", "engine_report")


def parse_replies(df: DataFrame, reply: str = "reply", entries: str | None = None) -> DataFrame:
    """Add ``reply_json`` (VARIANT, null unless usable), ``reply_status``, ``reply_msg``
    and ``reply_confidence``.

    ``entries`` names the placeholder array of ``pii.mask`` when the prompt was
    masked. A reply that is missing, is no JSON or lacks a required object gets
    status ERROR; nothing is raised.
    """
    body = cut_json(F.col(reply))
    if entries is not None:
        body = unmask(body, F.col(entries))
    parsed = df.withColumn("_v", F.try_parse_json(body))
    paths = {name: f"$.{name}" for name in REQUIRED_OBJECTS}
    kinds = parsed.select(
        "*",
        *[is_object(F.col("_v"), path).alias(f"_k_{n}") for n, path in paths.items()],
        F.try_variant_get("_v", "$.engine_report.trust_score", "double").alias("_trust"),
    )
    bad = listed("string", *[(~F.col(f"_k_{n}"), F.lit(n)) for n in REQUIRED_OBJECTS])
    msg = (
        F.when(F.col(reply).isNull(), "no reply")
        .when(F.col("_v").isNull(), "reply is not valid JSON")
        .when(
            F.size("_bad") > 0,
            F.concat(F.lit("not an object in reply: "), F.array_join("_bad", ", ")),
        )
    )
    checked = kinds.withColumn("_bad", bad).withColumn("reply_msg", msg)
    ok = F.col("reply_msg").isNull()
    result = checked.withColumns(
        {
            "reply_status": F.when(ok, "SUCCESS").otherwise("ERROR"),
            "reply_confidence": F.when(ok, F.coalesce("_trust", F.lit(0.0))),
            "reply_json": F.when(ok, F.col("_v")),
        },
    )
    return result.drop("_v", "_bad", "_trust", *[f"_k_{n}" for n in paths])
