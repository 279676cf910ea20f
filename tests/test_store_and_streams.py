import random
from concurrent.futures import ThreadPoolExecutor
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import rows
from evraklab.operators import analytics, throttle
from evraklab.operators.prompts import build_prompts
from evraklab.operators.throttle import throttle_flags
from evraklab.schemas import OCR_DOCUMENT
from evraklab.sinks import store
from evraklab.sources.ocr import blocks_of_json, blocks_of_pairs, blocks_of_parallel_lists, lines_of_blocks
from evraklab.sources.uploads import accepted, rejected, scan_uploads
from evraklab.streaming.documents import ingest
from evraklab.streaming.jobs import track_stages
from evraklab.streaming.throttle import throttle_stream
from test_documents import BANK, reply


def store_rows(spark, n, day=1):
    return spark.range(n).select(
        F.lit(None).cast("long").alias("id"),
        F.concat(F.lit("t"), F.col("id")).alias("task_id"),
        F.lit("f").alias("filename"),
        F.lit("BANKING").alias("document_type"),
        (F.col("id") / 100).alias("trust_score"),
        F.lit("{}").alias("extracted_json"),
        F.lit("SUCCESS").alias("status"),
        F.lit(0).alias("is_verified"),
        F.lit(None).cast("string").alias("corrected_json"),
        F.lit(1.0).alias("processing_time"),
        F.lit("text").alias("raw_text"),
        (F.lit(datetime(2024, 1, day)) + F.make_dt_interval(F.col("id").cast("int") % 3)).alias("created_at"),
    )


def corrections_of(spark, *more):
    at = datetime(2024, 2, 1)
    rows_ = [("t1", '{"a":1}', "u", "[]", at), ("t1", '{"a":2}', "v", "[]", at + timedelta(hours=1)), ("tx", "{}", "u", "[]", at), *more]
    return spark.createDataFrame(
        rows_, "task_id string, corrected_json string, approved_by string, corrected_fields string, corrected_at timestamp"
    )


def test_append_is_idempotent_and_corrections_rewrite_nothing(spark, tmp_path):
    path = str(tmp_path / "store")
    assert store.read_store(spark, path).count() == 0
    first = store.evolve(store_rows(spark, 6))
    store.append_results(first.unionAll(first), path)
    store.append_results(store.evolve(store_rows(spark, 8)), path)
    store.append_results(store.evolve(store_rows(spark, 8)), path)
    assert rows(store.read_store(spark, path).select("task_id"), "task_id") == [(f"t{i}",) for i in range(8)]
    files = lambda: {f for f in (tmp_path / "store" / "results").rglob("*.parquet")}
    before = files()
    store.append_corrections(corrections_of(spark), path)
    store.append_corrections(corrections_of(spark), path)
    assert files() == before
    after = {r["task_id"]: r for r in store.read_store(spark, path).collect()}
    assert len(after) == 8 and after["t1"]["status"] == "APPROVED" and after["t1"]["corrected_json"] == '{"a":2}'
    assert after["t1"]["is_verified"] == 1 and after["t0"]["is_verified"] == 0
    assert after["t1"]["approved_at"] == datetime(2024, 2, 1, 1)
    assert [r["task_id"] for r in store.unmatched_corrections(spark, path).collect()] == ["tx"]
    store.append_results(store.evolve(store_rows(spark, 1).withColumn("task_id", F.lit("tx"))), path)
    assert store.unmatched_corrections(spark, path).count() == 0  # a correction may come before its row
    assert store.read_store(spark, path).where("task_id = 'tx'").first()["status"] == "APPROVED"


def test_an_append_beside_corrections_loses_nothing(spark, tmp_path):
    """Results and corrections written at the same time, by several writers."""
    path = str(tmp_path / "store")
    store.append_results(store.evolve(store_rows(spark, 4)), path)
    with ThreadPoolExecutor(4) as pool:
        done = [
            pool.submit(store.append_results, store.evolve(store_rows(spark, 40).where(F.col("task_id").isin([f"t{i}" for i in range(10 * k, 10 * k + 10)]))), path)
            for k in range(1, 4)
        ] + [pool.submit(store.append_corrections, corrections_of(spark, (f"t{k}", "{}", "w", "[]", datetime(2024, 3, 1))), path) for k in (0, 12, 25)]
        for job in done:
            job.result()
    after = {r["task_id"]: r["status"] for r in store.read_store(spark, path).collect()}
    assert set(after) == {f"t{i}" for i in [*range(4), *range(10, 40)]}
    assert {t for t, status in after.items() if status == "APPROVED"} == {"t0", "t1", "t12", "t25"}


def test_a_batch_reads_the_keys_of_its_own_partitions(spark, tmp_path):
    path = str(tmp_path / "store")
    store.append_results(store.evolve(store_rows(spark, 300)), path)
    one = store_rows(spark, 300).where("task_id = 't7'").select(store.prefix_of(F.col("task_id"))).first()[0]
    keys = store.stored_keys(spark, path, [one])
    assert {f.split(f"{store.PREFIX}=")[1].split("/")[0] for f in keys.inputFiles()} >= {str(one)}
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "prefix" in plan.split("PartitionFilters")[1].split("]")[0]
    assert "ReadSchema: struct<task_id:string>" in plan
    assert keys.where("task_id = 't7'").count() == 1 and keys.count() < 300


def test_store_of_two_ages(spark, tmp_path):
    """Defaults go by the version of the row; a correction leaves all other values alone."""
    path = str(tmp_path / "store")
    old = store_rows(spark, 3).drop("raw_text", "status", "is_verified")
    store.append_results(old, path, version=1)
    newer = store_rows(spark, 6).where("task_id >= 't3'").withColumn("status", F.when(F.col("task_id") != "t4", "FAILED"))
    store.append_results(store.evolve(newer), path)
    before = {r["task_id"]: r for r in store.read_store(spark, path).collect()}
    assert [before[f"t{i}"]["status"] for i in range(6)] == ["SUCCESS"] * 3 + ["FAILED", None, "FAILED"]
    assert [before[f"t{i}"]["is_verified"] for i in range(6)] == [0] * 6
    store.append_corrections(corrections_of(spark, ("t3", '{"a":1}', "u", "[]", datetime(2024, 2, 1))), path)
    after = {r["task_id"]: r for r in store.read_store(spark, path).collect()}
    changed = {"corrected_json", "is_verified", "approved_by", "approved_at", "corrected_fields", "status"}
    for task, row in before.items():
        for name in row.asDict():
            if task in ("t1", "t3") and name in changed:
                continue
            assert after[task][name] == row[name], (task, name)
    assert after["t1"]["status"] == after["t3"]["status"] == "APPROVED"


def test_least_row_of_a_key_and_minted_keys(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), ("b", 3), (None, 4)], "task_id string, x int")
    known = df.where("task_id = 'b'")
    assert rows(store.not_stored(df, known), "x") == [("a", 1), (None, 4)]
    users = spark.createDataFrame([], "id long, name string")
    requests = spark.createDataFrame([(1, "u", None)], "request_id long, user_name string, label string")
    _, keys = store.create_api_keys(users, requests)
    minted = keys.first()["id"]
    row = store.evolve(spark.createDataFrame([("t", minted)], "task_id string, api_key_id long")).first()
    assert row["api_key_id"] == minted


def test_empty_store_statistics(spark):
    empty = store.evolve(store_rows(spark, 0))
    stats = analytics.dashboard_stats(empty).first()
    assert (stats["success_rate"], stats["avg_processing_time"], stats["total_documents"]) == (0.0, 0.0, 1)
    assert analytics.platform_insights(empty, date(2024, 1, 31)).first()["accuracy_score"] == 0.0
    with pytest.raises(ValueError):
        analytics.pending_reviews(empty, 51)


def test_uploads(spark, tmp_path):
    for name in ("a.PDF", "b.jpeg", "c.txt", ".png", "d.tar.png"):
        (tmp_path / name).write_bytes(b"x")
    files = scan_uploads(spark, str(tmp_path))
    assert {r["filename"] for r in accepted(files).collect()} == {"a.PDF", "b.jpeg", "d.tar.png"}
    assert "c.txt" in {r["filename"] for r in rejected(files).collect()}


def test_payload_shapes(spark):
    box = [[1.0, 2.0], [3.0, 2.0], [3.0, 4.0], [1.0, 4.0]]
    lists = spark.createDataFrame(
        [(1, 1, "raw", [box], ["  a ", " ", "c"], [0.5, 0.6])],
        "doc_id long, page int, method string, dt_polys array<array<array<double>>>, rec_texts array<string>, rec_scores array<double>",
    )
    got = rows(lines_of_blocks(blocks_of_parallel_lists(lists)).select("line_no", "text", "confidence", "bbox"), "line_no")
    assert got == [(1, "a", 0.5, box), (2, "c", 0.0, None)]
    pairs = spark.createDataFrame(
        [(1, 2, "raw", [(box, " x ", 0.7)]), (1, 1, "raw", [(box, "y", 0.8), (box, "", 0.1)])],
        "doc_id long, page int, method string, pairs array<struct<box:array<array<double>>,text:string,conf:double>>",
    )
    got = rows(lines_of_blocks(blocks_of_pairs(pairs)).select("line_no", "page", "text"), "line_no")
    assert got == [(1, 1, "y"), (2, 1, ""), (3, 2, " x ")]
    texts = ["null", "{}", "bad", "[]", '[[[[1,2]], ["one", 0.5]]]', '[[[[[1,2]], ["one", 0.5]], [[[3,4]], ["two", 0.25]]]]', '[{"rec_texts": ["z"]}]']
    df = spark.createDataFrame(list(enumerate(texts)), "i int, payload string")
    got = rows(blocks_of_json(df).select("i", "blocks.text"), "i")
    assert [t for _, t in got] == [[], [], [], [], ["one"], ["one", "two"], ["z"]]


def test_payload_items_are_read_by_their_own_shape(spark):
    cases = [
        ('[{"rec_texts": ["a", "b", "c"], "rec_scores": ["0.9", " 1 ", "x"]}]', [("a", 0.9), ("b", 1.0), ("c", 0.0)]),
        ('[7, null, "[s", true, {"rec_texts": ["a"]}, {}]', [("a", 0.0)]),
        ('[[[[1,2]], ["two", 0.5], 3]]', []),
        ('[[[[[1,2]], ["two", 0.5], 3], [[[1,2]], ["no", "0.5"]]]]', []),
        ('[[[[[[1,2]], ["two", 0.5], 3], [[[1,2]], ["kept", "0.5"]], [[1,2]]]]]', [("kept", 0.5)]),
        ('[ {"rec_texts": [" [x] ", "{", "q\\"[z"]} , [[null, ["p", 1]]] ]', [("[x]", 0.0), ("{", 0.0), ('q"[z', 0.0), ("p", 1.0)]),
        ('[[[[[1,2],[3,4]], ["[n]", 0.5]], [null, ["  ", 0.1]]]]', [("[n]", 0.5), ("  ", 0.1)]),
        ('[{"dt_polys": [[[1,2]], "bad"], "rec_texts": ["a", "b"]}] x', []),
        (None, []),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, payload string")
    got = [[(b["text"], b["confidence"]) for b in r.blocks] for r in blocks_of_json(df).orderBy("i").collect()]
    assert got == [c[1] for c in cases]
    box = blocks_of_json(spark.createDataFrame([('[{"dt_polys": [[[1,2]], "bad"], "rec_texts": ["a", "b"]}]',)], "payload string"))
    assert [b["bbox"] for b in box.first().blocks] == [[[1.0, 2.0]], None]


def fold_by_definition(events, limit, gap):
    state, out = {}, {}
    for key, t, event in sorted(events, key=lambda e: (e[0], e[1], e[2])):
        n, last = state.get(key, (0, None))
        if last is None or t - last >= timedelta(seconds=gap):
            n = 0
        out[event] = n >= limit
        state[key] = (n, last) if n >= limit else (n + 1, t)
    return out


def throttle_events(n=1500):
    rnd, t0 = random.Random(3), datetime(2024, 1, 1)
    # One key has most of the events.
    return [
        ("hot" if i % 3 else f"k{i % 7}", t0 + timedelta(seconds=rnd.randint(0, 20000)), i) for i in range(n)
    ]


@pytest.mark.parametrize(
    ("n", "span", "limit", "gap"), [(3000, 3000, 4, 10), (3000, 60000, 2, 15), (2000, 400, 3, 5), (800, 100, 1, 7), (500, 5000, 3, 0)]
)
def test_throttle_of_busy_keys_over_many_blocks(spark, monkeypatch, n, span, limit, gap):
    """A key that never pauses is judged block by block, whatever a task looks at together."""
    monkeypatch.setattr(throttle, "ROWS_TOGETHER", 97)
    rnd, t0 = random.Random(n), datetime(2024, 1, 1)
    events = [("hot" if i % 3 else f"k{i % 7}", t0 + timedelta(seconds=rnd.randint(0, span)), i) for i in range(n)]
    df = spark.createDataFrame(events, "key string, ts timestamp, event_id long")
    got = throttle_flags(df, "key", "ts", "event_id", limit, gap, 1).collect()
    assert len(got) == n and {r["event_id"]: r["denied"] for r in got} == fold_by_definition(events, limit, gap)


def test_throttle_matches_the_definition(spark):
    events = throttle_events()
    df = spark.createDataFrame(events, "key string, ts timestamp, event_id long")
    for limit, gap, bucket in ((5, 60, 60), (20, 60, 3600), (3, 10, 7)):
        got = throttle_flags(df, "key", "ts", "event_id", limit, gap, bucket).collect()
        assert {r["event_id"]: r["denied"] for r in got} == fold_by_definition(events, limit, gap)


def test_throttle_stream_equals_batch(spark, tmp_path):
    events = throttle_events(300)
    df = spark.createDataFrame(events, "key string, ts timestamp, event_id long")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = throttle_stream(source, "key", "ts", "event_id", limit=5)
    query = (
        out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp"))
        .trigger(availableNow=True).start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    got = {r["event_id"]: r["denied"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == fold_by_definition(events, 5, 60)


def test_throttle_keeps_every_event(spark, tmp_path):
    """Events without key or time come back undecided, late ones flagged."""
    t0 = datetime(2024, 1, 1)
    schema = "key string, ts timestamp, event_id long"
    events = [("a", t0, 1), (None, t0, 2), ("a", None, 3), (None, None, 4)]
    got = throttle_flags(spark.createDataFrame(events, schema), "key", "ts", "event_id").collect()
    assert {r["event_id"]: r["denied"] for r in got} == {1: False, 2: None, 3: None, 4: None}
    spark.createDataFrame(events, schema).coalesce(1).write.parquet(str(tmp_path / "in"))

    def run():
        source = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        throttle_stream(source, "key", "ts", "event_id").writeStream.format("parquet").option(
            "checkpointLocation", str(tmp_path / "cp")
        ).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination()

    run()
    late = [("a", t0 - timedelta(days=2), 5), ("a", t0 + timedelta(seconds=1), 6)]
    spark.createDataFrame(late, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    got = {r["event_id"]: (r["denied"], r["late"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: (False, False), 2: (None, None), 3: (None, None), 4: (None, None), 5: (False, True), 6: (False, False)}


def test_stage_stream(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    events = [(1, "OCR", t0), (1, "FILE_PREP", t0), (2, "FINISHED", t0), (2, "OCR", t0 - timedelta(seconds=5))]
    df = spark.createDataFrame(events, "job_id long, stage string, ts timestamp")
    df.write.parquet(str(tmp_path / "in"))
    seen = {}

    def sink(batch, _):
        seen.update({r["job_id"]: (r["current_stage"], r["progress"]) for r in batch.collect()})

    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    track_stages(source, str(tmp_path / "cp"), sink).awaitTermination()
    assert seen == {1: ("OCR", 25), 2: ("FINISHED", 100)}


def test_ingest_stream_and_restart(spark, tmp_path):
    def land(ids, name):
        lines = [(i, 1, t, 1.0, None, "raw") for i, t in enumerate(BANK, 1)]
        data = [
            (i, f"t{i}", f"f{i}.pdf", None, datetime(2024, 1, 1), lines if i != 3 else [],
             reply({"sender": "A", "receiver": "B"}, {"root_transaction": {"amount": 10 * i}}))
            for i in ids
        ]
        spark.createDataFrame(data, OCR_DOCUMENT).coalesce(1).write.mode("append").parquet(str(tmp_path / name))

    args = dict(with_evidence=False, with_metrics=False)
    paths = [str(tmp_path / p) for p in ("land", "store", "cp")]
    land([1, 2, 3], "land")
    ingest(spark, *paths, **args).awaitTermination()
    land([2, 4], "land")
    ingest(spark, *paths, **args).awaitTermination()
    got = store.read_store(spark, paths[1])
    assert rows(got.select("task_id", "status", "document_type", "filename"), "task_id") == [
        (f"t{i}", "SUCCESS", "BANKING", f"f{i}.pdf") for i in (1, 2, 4)
    ]
    amount = F.get_json_object("extracted_json", "$.data.financial_hierarchy.root_transaction.amount.value")
    assert [float(r[0]) for r in rows(got.orderBy("task_id").select(amount))] == [10.0, 20.0, 40.0]


def test_prompts_mask_and_examples(spark):
    docs = spark.createDataFrame(
        [(1, "BANKING", "IBAN TR120001000200030004000500", "tel 0532 123 45 67"), (2, "UNKNOWN", "x", None)],
        "doc_id long, category string, text string, tables string",
    )
    verified = spark.createDataFrame(
        [("UNKNOWN", 1, None, "not json"), ("UNKNOWN", 2, "in", "{}"), ("BANKING", 1, None, '{"a": 1}')],
        "document_type string, rank int, raw_text string, corrected_json string",
    )
    got = {r["doc_id"]: r for r in build_prompts(docs, verified, mask_pii=True).collect()}
    one = got[1]["prompt"]
    assert "FULL OCR TEXT:\nIBAN [IBAN_0]\n\n" in one and "tel [T_PHONE_0]" in one
    assert one.index("Para Transferi") < one.index("INPUT: SAMPLE_DOC_TEXT\nOUTPUT: {\"a\": 1}\n---\n")
    assert [e["original"] for e in got[1]["entries"]] == ["TR120001000200030004000500"]
    assert "EXAMPLES" not in got[2]["prompt"] and "TABLE DATA" not in got[2]["prompt"]
