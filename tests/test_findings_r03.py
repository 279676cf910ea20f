"""One test for each finding of round 3 on the document operators."""

from evraklab.operators.classify import Rule, near_signals, rules_table


def plan_of(df, capsys):
    capsys.readouterr()
    df.explain()
    return capsys.readouterr().out


def test_grams_of_texts_are_never_broadcast(spark, capsys, monkeypatch):
    from evraklab.operators import classify

    # Texts of known, small size: the planner would send their grams, not the rules of unknown size.
    texts = spark.range(1, 4).selectExpr(
        "id AS doc_id", "CASE id WHEN 1 THEN 'a dekont b' WHEN 3 THEN 'x signal7x' END AS raw_text"
    )
    rules = rules_table(spark, [Rule("A", "F", ("DEKONT", "SIGNAL7X", "NOT THERE"))])
    met = []
    for limit in (1 << 20, 0):
        monkeypatch.setattr(classify, "BROADCAST_BYTES", limit, raising=False)
        near = near_signals(texts, rules)
        assert "BuildLeft" not in plan_of(near, capsys)
        met.append({r["doc_id"]: sorted(x["signal"] for x in r["near"]) for r in near.collect()})
    assert met[0] == met[1] == {1: ["DEKONT"], 3: ["SIGNAL7X"]}


def test_payloads_are_parsed_once(spark, capsys):
    """one scan serves page counts and lines; repeated and null pages keep their old places."""
    from evraklab.sources.ocr import blocks_of_json, lines_of_blocks

    one = '[[[[1,2]],["%s",0.5]]]'
    rows = [
        (1, 2, "raw", one % "c"), (1, 1, "raw", one % "a"), (2, None, "raw", one % "n"), (2, 1, "raw", one % "x"),
        (None, 1, "raw", one % "y"), (3, 1, "raw", one % "p"), (3, 1, "raw", one % "p"), (3, 2, "raw", "no json"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, page int, method string, payload string")
    lines = lines_of_blocks(blocks_of_json(df).drop("payload"))
    assert plan_of(lines, capsys).count("ExistingRDD") == 1
    got = sorted((r["doc_id"], r["line_no"], r["text"]) for r in lines.collect())
    assert got == [(1, 1, "a"), (1, 2, "c"), (2, 2, "x"), (3, 1, "p"), (3, 1, "p"), (3, 2, "p"), (3, 2, "p")]


GOOD = '{"document_analysis":{"sender":"A"},"financial_hierarchy":{},"engine_report":{}}'


def landed_documents(spark):
    from evraklab.schemas import OCR_DOCUMENT

    line = lambda n, page, text, c: (n, page, text, c, None, "raw")
    rows = [
        (1, "T1", "a.pdf", 7, None, [line(2, 1, "b", 0.5), line(1, 2, "a", None)], GOOD),
        (2, None, None, None, None, [line(1, 1, None, None)], None),
        (3, "T3", "c.pdf", 7, None, [], GOOD),
        (4, "T4", "d.pdf", 7, None, None, GOOD),
        (None, "T5", "e.pdf", 7, None, [line(1, 1, "x", 0.5)], GOOD),
    ]
    return spark.createDataFrame(rows, OCR_DOCUMENT)


def test_landed_documents_never_leave_their_row(spark, capsys):
    from evraklab.streaming.documents import process_landed

    stored = process_landed(landed_documents(spark), with_evidence=False)
    plan = plan_of(stored, capsys)
    assert "MergeJoin" not in plan and "HashJoin" not in plan and plan.count("Exchange") == 1
    found = {r["task_id"]: (r["filename"], r["api_key_id"]) for r in stored.collect()}
    assert found == {"T1": ("a.pdf", 7), "2": (None, None)}


def test_nested_lines_tell_what_gathered_ones_do(spark):
    from evraklab.operators.doc_text import document_states, nested_states
    from evraklab.streaming.documents import lines_of

    landed = landed_documents(spark)
    told = ("doc_id", "raw_text", "n_lines", "mean_confidence", "lines", "pages")
    nested = {r["doc_id"]: r for r in nested_states(landed).select(*told).collect()}
    assert nested == {r["doc_id"]: r for r in document_states(lines_of(landed)).select(*told).collect()}
