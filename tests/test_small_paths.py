from pyspark.sql import functions as F

from conftest import rows
from evraklab.functions.json_text import reply_text
from evraklab.operators import prompts
from evraklab.operators.analytics import verify_key
from evraklab.operators.metrics import lines_of_best_pass


def test_reply_text_of_a_raw_body(values):
    body = '{"candidates":[{"content":{"parts":[{"text":"hi"}]}}]}'
    assert values(reply_text, [body, "{}"]) == ["hi", None]


def test_verify_key(spark):
    keys = spark.createDataFrame([(1, "a", 1), (2, "b", 0)], "id int, key_hash string, is_active int")
    assert rows(verify_key(keys, "a")) == [(1,)] and rows(verify_key(keys, "b")) == []


def test_lines_of_best_pass(spark):
    blocks = spark.createDataFrame(
        [(1, 1, 0, "raw", None, None), (1, 1, 1, "standard", "x", 0.5), (1, 1, 2, "inverted", "y", 0.9),
         (1, 1, 2, "inverted", "z", 0.9)],
        "doc_id long, page int, pass_no int, pass_name string, text string, confidence double",
    )
    assert rows(lines_of_best_pass(blocks).select("method", "text")) == [("standard", "x")]


def test_salted_examples_equal_broadcast_ones(spark, monkeypatch):
    docs = spark.range(40).select(
        F.col("id").alias("doc_id"), F.lit("BANKING").alias("category"), F.lit("t").alias("text")
    )
    verified = spark.createDataFrame(
        [("BANKING", 1, "in", "{}")], "document_type string, rank int, raw_text string, corrected_json string"
    )
    small = rows(prompts.build_prompts(docs, verified).select("doc_id", "prompt"), "doc_id")
    monkeypatch.setattr(prompts, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(prompts, "CATEGORY_SALTS", 8)
    assert rows(prompts.build_prompts(docs, verified).select("doc_id", "prompt"), "doc_id") == small
