"""Findings F8 to F16 of round 3: the shared plan evaluates each step once and moves lines once."""

from pyspark.sql import functions as F

from evraklab.functions.json_text import cut_json
from evraklab.functions.patterns import first_date, reference_number
from evraklab.operators.decide import flagged_fields
from evraklab.operators.doc_text import document_states
from evraklab.operators.extract import read_reply_fields
from evraklab.operators.replies import parse_replies
from evraklab.plans.documents import process_documents
from evraklab.schemas import EXTRACTION

LINES = "doc_id long, line_no int, page int, text string, confidence double"


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_are_gathered_in_one_step(spark):
    rows = [(1, 2, 1, "b", 0.5), (1, 1, 2, "a", None), (1, 2000, 1, None, 0.7), (1, 2, 1, "b", 0.5)]
    states = document_states(spark.createDataFrame(rows, LINES))
    assert plan_of(states).count("Aggregate [") == 1
    (row,) = states.select("raw_text", "n_lines", F.round("mean_confidence", 6).alias("m"), "pages.page").collect()
    assert (row["raw_text"], row["n_lines"], row["m"], row["page"]) == ("a b b ", 4, 0.425, [1, 1, 1, 2])


def test_patterns_are_searched_once(spark):
    df = spark.createDataFrame([("Ref: 1234567 05.11.2020",)], "text string").select(
        first_date(F.col("text")).alias("d"), reference_number(F.col("text")).alias("r")
    )
    plan = plan_of(df)
    assert plan.count("regexp_extract") == 7  # one date, six keywords
    assert tuple(df.first()) == ("2020-11-05", "1234567")


def test_reply_values_and_signals_take_no_lambda(spark):
    lines = spark.createDataFrame([(1, 1, 1, "HAVALE DEKONTU", 0.9)], LINES)
    replies = spark.createDataFrame([(1, "{}")], "doc_id long, reply string")
    rows = process_documents(lines, replies, with_evidence=False, with_metrics=False).results
    # What is left: the lines' confidences, account numbers (2), adjustments and their checks.
    assert plan_of(rows).count("filter(array(") == 0
    parsed = read_reply_fields(parse_replies(replies))
    assert "transform(array(" not in plan_of(parsed.select(*[F.col("reply_fields")[n] for n in ("sender", "type")]))


def test_reply_shapes(spark):
    full = '{"document_analysis":{%s},"financial_hierarchy":{%s},"engine_report":{}}'
    cases = {
        full % ('"sender":"A","type":null,"status":{"a":1},"currency":0,"description":[]', '"root_transaction":{"amount":"1.234,50"}'): False,
        full % ("", '"root_transaction":null'): True,
        full % ("", '"adjustments_and_fees":{}'): False,
        full % ("", '"adjustments_and_fees":"{}"'): False,
        full % ("", '"adjustments_and_fees":{"a":1}'): True,
        full % ("", '"adjustments_and_fees":null'): True,
        full % ("", '"adjustments_and_fees":[{"breakdown":[]}]'): True,
        full % ("", '"adjustments_and_fees":[1]'): True,
        full % ("", '"adjustments_and_fees":[{"group_name":"G","total_impact":-2,"breakdown":{"x":"1,5"}}]'): False,
    }
    df = spark.createDataFrame(list(enumerate(cases)), "doc_id long, reply string")
    got = read_reply_fields(parse_replies(df)).orderBy("doc_id").select("reply_fields").collect()
    assert [r[0]["malformed"] for r in got] == list(cases.values())
    f = got[0][0]
    assert [(f[n]["kind"], f[n]["raw"], f[n]["text"], f[n]["truthy"]) for n in ("sender", "type", "status", "currency", "description", "sender_iban")] == [
        ("STRING", "A", "A", True), ("VOID", None, None, False), ("OBJECT", '{"a":1}', '{"a":1}', True),
        ("BIGINT", "0", "0", False), ("ARRAY", "[]", "[]", False), ("MISSING", None, None, False),
    ]
    assert f["root_amount"] == 1234.5
    a = got[8][0]["adjustments"][0]
    assert (a["group"]["text"], a["total"]["amount"], a["breakdown"]) == ("G", 2.0, {"x": 1.5})


def test_cut_json_of_odd_braces(values):
    texts = ["a {x} b } c", "}{", "}{{{", " no ", " x { ", None, "```json {1} ``` }", ""]
    assert values(cut_json, texts) == ["{x} b }", "", "", "no", "x {", None, "{1}", ""]


def test_flagged_fields_count_marks(spark):
    made = F.from_json(
        F.lit('{"document_analysis":{"sender":{"review_required":true},"type":{"review_required":false},"receiver":{"review_required":true}}}'),
        EXTRACTION,
    )
    df = spark.range(1).select(flagged_fields(made), flagged_fields(F.lit(None).cast(EXTRACTION)))
    assert tuple(df.first()) == (2, 0)
