import json

import pytest
from pyspark.sql import functions as F

from conftest import rows
from evraklab.operators.classify import RULES, Rule, classify, classify_by_table, rules_table, with_classification
from evraklab.plans import documents
from evraklab.plans.documents import process_documents
from evraklab.sinks.export import export_invoices, export_rows, write_csv, write_invoices
from evraklab.sinks.store import to_store_rows
from test_fuzzy import lines_df


def reply(analysis=None, hierarchy=None, report=None, **extra):
    return json.dumps(
        {
            "document_analysis": analysis or {},
            "financial_hierarchy": hierarchy if hierarchy is not None else {},
            "engine_report": {"trust_score": 0.9} if report is None else report,
            **extra,
        },
        ensure_ascii=False,
    )


BANK = ["HAVALE DEKONTU", "Masraf: 2,14", "BSMV: 0,11", "Toplam Masraf: 2,25"]


def test_classification(spark):
    docs = {
        1: BANK,
        2: ["T. Garanti Bankası ... HAVALE ... TUTAR : - 250,00 TL"],
        3: ["fiş ve FİŞ", "KDV"],
        4: ["HESAP", "NUMARASI"],
        5: ["nothing"],
        6: ["EFT", "FATURA"],
        7: ["DEKONT"],
    }
    got = {r["doc_id"]: r for r in classify(lines_df(spark, docs)).collect()}
    one = got[1]
    assert (one["domain"], one["document_family"], one["document_type"], one["transaction_type"]) == (
        "BANKING", "RECEIPT", "BANK_TRANSFER_RECEIPT", "HAVALE",
    )
    assert one["classification_signals"] == ["DEKONT", "HAVALE", "BSMV"] and one["confidence"] == 0.6
    assert got[2]["classification_signals"] == ["HAVALE", "TUTAR", "BANKASI"]
    assert got[3]["domain"] == "RETAIL" and got[3]["classification_signals"] == ["FİŞ", "KDV"]
    assert got[4]["classification_signals"] == ["HESAP NUMARASI"]
    assert got[5]["domain"] == "UNKNOWN" and got[5]["confidence"] == 0.0
    assert got[6]["domain"] == "BANKING" and got[6]["transaction_type"] == "EFT"
    assert got[7]["document_type"] == "BANK_RECEIPT" and got[7]["transaction_type"] == "UNKNOWN"


def test_plan_takes_a_rule_table_of_any_size(spark, monkeypatch):
    docs = {1: ["Kira sözleşmesi", "Toplam: 5"], 2: ["dekont havale"], 3: ["nothing"]}
    own = [*RULES, Rule("LEGAL", "CONTRACT", ("SÖZLEŞME", "KİRA"))]
    answers = spark.createDataFrame([(1, reply({"sender": "A", "receiver": "B"}, {"root_transaction": {"amount": 5}}))], "doc_id long, reply string")
    lines = lines_df(spark, docs)

    def run(rules):
        got = process_documents(lines, answers, rules=rules, with_evidence=False).results
        return rows(got.select("doc_id", "classification", "status", "reply_status", "page_count"), "doc_id")

    expected = run(own)
    assert [r[1]["domain"] for r in expected] == ["LEGAL", "BANKING", "UNKNOWN"]
    assert [r[3] for r in expected] == ["SUCCESS", "ERROR", "ERROR"]  # no reply row: an error, not a lost document
    table = rules_table(spark, own)
    assert run(table) == expected
    monkeypatch.setattr(documents, "small_rules", lambda table: None)  # as for a large table
    assert run(table) == expected


def test_engine_report_keeps_any_key(spark):
    report = {"trust_score": 0.9, "steps": [{"n": 1}, "x"], "note": None}
    answers = spark.createDataFrame([(1, reply({"sender": "A"}, {}, report))], "doc_id long, reply string")
    results = process_documents(lines_df(spark, {1: ["Tutar: 5"]}), answers, with_evidence=False).results
    row = to_store_rows(results).first()
    assert json.loads(row["extracted_json"])["data"]["engine_report"] == report
    assert row["id"] == to_store_rows(results).first()["id"] > 0


def test_rules_of_a_table(spark):
    texts = ["DEKONT HAVALE bsmv", "fatura kdv", "nothing", "", None, "eft fatura tax", "İBAN tutar"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, raw_text string")
    expected = with_classification(df).select("doc_id", "classification.*")
    assert rows(classify_by_table(df, rules_table(spark)), "doc_id") == rows(expected, "doc_id")
    many = [Rule(f"D{i}", "F", (f"SIGNAL{i}X",)) for i in range(5000)]
    got = rows(classify_by_table(df.limit(0).union(spark.createDataFrame([(1, "a signal4711x b")], df.schema)), rules_table(spark, many)))
    assert got[0][1] == "D4711"
    short = [Rule("ONE", "A", ("Q", "ÖZ")), Rule("TWO", "B", ("XYZ", "LONGER THAN FOUR"))]
    df = spark.createDataFrame(list(enumerate(["q", "söz xyz", "longer than fou", "a longer than four xyz", "w"])), "doc_id long, raw_text string")
    expected = with_classification(df, rules=short, subtypes=()).select("doc_id", "classification.*")
    assert rows(classify_by_table(df, rules_table(spark, short), subtypes=()), "doc_id") == rows(expected, "doc_id")
    own = (Rule("LEGAL", "CONTRACT", ("SÖZLEŞME",)),)
    got = classify(lines_df(spark, {1: ["sözleşme"]}), own, ()).first()
    assert got["domain"] == "LEGAL" and got["document_family"] == "CONTRACT"


@pytest.fixture(scope="module")
def outcome(spark):
    docs = {i: BANK + [f"Gönderen: C{i}"] for i in range(1, 13)}
    adj = {"group_name": "MASRAF", "total_impact": 2.25, "breakdown": {"fee": 2.14, "tax": "0,11"}}
    ok = {"root_transaction": {"amount": "250,00 TL"}, "adjustments_and_fees": [adj]}
    parties = {"sender": "C1", "receiver": "Ayşe"}
    replies = {
        1: reply(parties, ok),
        2: reply({"sender": "C2"}, ok),
        3: reply({}, ok),
        4: reply(parties, {"root_transaction": {"amount": 150000.0}}),
        5: reply(parties, {"root_transaction": {"amount": 10}, "adjustments_and_fees": [dict(adj, total_impact=9)]}),
        6: reply(parties, {"root_transaction": None}),
        7: "no json",
        9: reply(parties, {"root_transaction": {"amount": 5}, "adjustments_and_fees": ["x"]}),
        10: reply({"sender": "IBAN 12", "type": None, "status": 7}, {"root_transaction": {"amount": -5, "label": None}}),
        11: reply(parties, {"root_transaction": {"amount": 0}}),
        12: reply({"transaction_id": 0, "sender": "C12", "receiver": "R"}, {"root_transaction": {"amount": 1e3}}),
    }
    manifest = [(i, f"t{i}", f"f{i}.pdf") for i in [*docs, 99]]
    return process_documents(
        lines_df(spark, docs),
        spark.createDataFrame(list(replies.items()), "doc_id long, reply string"),
        spark.createDataFrame(manifest, "doc_id long, task_id string, filename string"),
    )


@pytest.fixture(scope="module")
def results(outcome):
    return {r["doc_id"]: r.asDict(True) for r in outcome.results.collect()}


def action(r):
    return r["decision_engine"]["recommended_action"], r["status"]


def test_actions(results):
    assert action(results[1]) == ("AUTO_BOOK", "SUCCESS")
    assert results[1]["decision_engine"]["risk_score"] == 0.0
    assert action(results[2]) == ("AUTO_BOOK", "SUCCESS") or results[2]["data"]["document_analysis"]["receiver"]["value"] is None
    assert action(results[2]) == ("AUTO_APPROVE", "SUCCESS")
    assert action(results[3]) == ("ESCALATE", "REVIEW_REQUIRED")
    assert results[4]["decision_engine"]["decision_reason"] == ["Transaction amount (150000.0) exceeds escalation threshold"]
    assert action(results[5]) == ("ESCALATE", "REVIEW_REQUIRED")
    for i in (6, 7, 8, 9, 11):
        assert action(results[i]) == ("REJECT", "FAILED"), i
    assert action(results[10]) == ("REVIEW_REQUIRED", "REVIEW_REQUIRED")
    assert results[10]["decision_engine"]["decision_reason"][0] == "Validation report status is WARNING"


def test_extraction_details(results):
    data = results[1]["data"]
    a, h = data["document_analysis"], data["financial_hierarchy"]
    assert a["type"]["value"] == "BANKING" and a["currency"]["value"] == "TRY" and a["status"]["value"] == "VERIFIED"
    assert a["sender"]["evidence_text"] == "Gönderen: C1" and a["receiver"]["evidence_text"] is None
    assert h["root_transaction"]["amount"]["value"] == 250.0
    one = h["adjustments_and_fees"][0]
    assert one["breakdown"] == {"fee": 2.14, "tax": 0.11} and one["math_status"] == "MATCH"
    assert results[5]["data"]["financial_hierarchy"]["adjustments_and_fees"][0]["math_status"] == "MISMATCH"
    assert results[5]["validation_report"]["status"] == "ERROR"
    ten = results[10]["data"]
    assert ten["document_analysis"]["type"]["value"] is None and ten["document_analysis"]["status"]["value"] == "7"
    assert ten["financial_hierarchy"]["root_transaction"]["label"]["value"] is None
    assert ten["financial_hierarchy"]["root_transaction"]["amount"]["value"] == 5.0
    assert results[12]["data"]["financial_hierarchy"]["root_transaction"]["amount"]["value"] == 1000.0


def test_failed_replies_get_the_skeleton(results):
    for i in (7, 8):
        r = results[i]
        assert r["data"]["engine_report"].toPython()["logic_applied"] == "SkeletonFallback"
        assert r["stages"]["llm_extraction"]["status"] == "FAILED" and r["validation_report"] is None
        assert r["trust_score"] == pytest.approx(0.7)
    assert results[8]["stages"]["llm_extraction"]["details"] == "no reply"
    assert results[6]["stages"]["llm_extraction"]["status"] == "SUCCESS"
    assert results[6]["data"]["document_analysis"]["status"]["value"] == "FAILED"


def test_rejects_and_metrics(outcome, results):
    assert [r["task_id"] for r in outcome.rejects.collect()] == ["t99"]
    assert outcome.rejects.first()["stages"]["ocr"]["status"] == "FAILED"
    assert results[1]["total_blocks"] == 5 and results[1]["page_count"] == 1 and results[1]["block_variance"] == 0.0
    assert results[1]["filename"] == "f1.pdf"


def test_filters_on_results_keep_the_plan_small(outcome):
    plan = outcome.results.where("status = 'FAILED'")._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 400_000
    pushed = outcome.results.where("doc_id = 1")._jdf.queryExecution().optimizedPlan().toString()
    assert "(doc_id" in pushed


def test_ibans_fill_missing_sides(spark):
    a, b = "TR120001000200030004000500", "TR990001000200030004000511"
    docs = {i: [f"x {a} y", f"z {b} w"] for i in (1, 2, 3, 4)} | {5: [f"only {a} ."]}
    given = {1: {}, 2: {"receiver_iban": "R"}, 3: {"sender_iban": a}, 4: {"sender_iban": "S", "receiver_iban": ""}, 5: {}}
    replies = [(i, reply(g, {"root_transaction": {"amount": 1}})) for i, g in given.items()]
    out = process_documents(
        lines_df(spark, docs), spark.createDataFrame(replies, "doc_id long, reply string"),
        with_evidence=False, with_metrics=False,
    ).results
    f = F.col("data.document_analysis")
    got = rows(
        out.select("doc_id", f["sender_iban"]["value"], f["sender_iban"]["source"], f["receiver_iban"]["value"], f["receiver_iban"]["source"]),
        "doc_id",
    )
    own, text = "llm", "deterministic_fallback"
    assert got == [
        (1, a, text, b, text),
        (2, a, text, "R", own),
        (3, a, own, None, own),
        (4, "S", own, a, text),
        (5, None, own, a, text),
    ]


def test_exports(outcome, tmp_path, spark):
    flat = export_rows(outcome.results.where(F.col("doc_id").isin(1, 4)))
    got = {r["Filename"]: r.asDict() for r in flat.collect()}
    assert got["f1.pdf"]["Breakdown"] == '{"fee": 2.14, "tax": 0.11}' and got["f4.pdf"]["Adjustment_Group"] is None
    write_csv(flat, str(tmp_path / "csv"), bom=True)
    text = next((tmp_path / "csv").glob("*.csv")).read_bytes()
    assert text.startswith(b"\xef\xbb\xbfFilename,Total_Amount")
    from datetime import date
    from xml.etree import ElementTree

    invoices = export_invoices(outcome.results.where("doc_id = 1"), date(2024, 1, 31))
    xml = invoices.first()["xml"]
    tree = ElementTree.fromstring(xml.split("\n", 1)[1])
    amount = [e for e in tree.iter() if e.tag.endswith("PayableAmount")][0]
    assert amount.text == "250.0" and amount.get("currencyID") == "TRY"
    write_invoices(invoices, str(tmp_path / "xml"))
    assert spark.read.text(str(tmp_path / "xml")).count() == 1
