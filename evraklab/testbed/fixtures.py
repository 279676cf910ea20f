"""Document-shaped tables derived from the driver's parquet tables.

Every fixture has a Spark and a DuckDB form with the same recipe (FIXTURES.md).
All of them cover their whole base table.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = date(2024, 1, 31)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame, *more: str) -> DataFrame:
    """A driver table is one small file, read by one task; a landing zone has many."""
    return df.repartition("doc_id", *more)


# -- store ---------------------------------------------------------------------------


def fx_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    return e.select(
        key.alias("id"),
        key.cast("string").alias("task_id"),
        F.concat(F.lit("doc_"), key.cast("string"), F.lit(".pdf")).alias("filename"),
        F.when(F.col("event_type") == "purchase", "BANKING")
        .when(F.col("event_type").isin("click", "view"), "RETAIL")
        .otherwise("UNKNOWN")
        .alias("document_type"),
        (((key * 37) % 101).cast("double") / 100).alias("trust_score"),
        F.col("props").alias("extracted_json"),
        F.when(key % 5 == 0, "REVIEW_REQUIRED")
        .when(key % 11 == 0, "FAILED")
        .otherwise("SUCCESS")
        .alias("status"),
        (key % 7 == 0).cast("int").alias("is_verified"),
        F.when(key % 7 == 0, F.col("props")).alias("corrected_json"),
        F.col("value").alias("processing_time"),
        (F.col("user_id") % 50).cast("int").alias("api_key_id"),
        F.col("props").alias("raw_text"),
        F.lit(None).cast("string").alias("approved_by"),
        F.lit(None).cast("timestamp_ntz").alias("approved_at"),
        F.lit(None).cast("string").alias("corrected_fields"),
        F.col("ts").alias("created_at"),
    )


SQL_EXTRACTIONS = """
ex AS (
  SELECT event_id AS id, CAST(event_id AS varchar) AS task_id,
    'doc_' || event_id || '.pdf' AS filename,
    CASE WHEN event_type = 'purchase' THEN 'BANKING'
         WHEN event_type IN ('click', 'view') THEN 'RETAIL' ELSE 'UNKNOWN' END AS document_type,
    CAST((event_id * 37) % 101 AS double) / 100 AS trust_score,
    props AS extracted_json,
    CASE WHEN event_id % 5 = 0 THEN 'REVIEW_REQUIRED'
         WHEN event_id % 11 = 0 THEN 'FAILED' ELSE 'SUCCESS' END AS status,
    CAST(event_id % 7 = 0 AS integer) AS is_verified,
    CASE WHEN event_id % 7 = 0 THEN props END AS corrected_json,
    value AS processing_time, CAST(user_id % 50 AS integer) AS api_key_id,
    props AS raw_text, CAST(NULL AS varchar) AS approved_by,
    CAST(NULL AS varchar) AS corrected_fields, ts AS created_at
  FROM events)"""


def fx_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two rounds of corrections, some for tasks nobody knows."""
    e = table(spark, sf_dir, "events")
    key = F.col("event_id")
    common = (
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("approved_by"),
    )
    first = e.where(key % 13 == 0).select(
        F.when(key % 97 == 0, key + 1000000000).otherwise(key).cast("string").alias("task_id"),
        F.col("props").alias("corrected_json"),
        *common,
        F.col("ts").alias("corrected_at"),
    )
    second = e.where(key % 26 == 0).select(
        key.cast("string").alias("task_id"),
        F.lit('{"k": -1}').alias("corrected_json"),
        *common,
        (F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("corrected_at"),
    )
    return first.unionByName(second)


SQL_CORRECTIONS = """
co AS (
  SELECT CAST(CASE WHEN event_id % 97 = 0 THEN event_id + 1000000000 ELSE event_id END AS varchar) AS task_id,
    props AS corrected_json, 'u' || user_id AS approved_by, ts AS corrected_at
  FROM events WHERE event_id % 13 = 0
  UNION ALL
  SELECT CAST(event_id AS varchar), '{"k": -1}', 'u' || user_id, ts + INTERVAL 1 DAY
  FROM events WHERE event_id % 26 = 0),
cl AS (
  SELECT * FROM co QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY corrected_at DESC, corrected_json DESC) = 1)"""


# -- recognised lines ----------------------------------------------------------------


def _money(price: Column) -> Column:
    return price.cast("decimal(12,2)").cast("string")


def fx_ocr_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")

    def line(i: int, text: Column) -> Column:
        return F.struct(
            F.lit(i + 1).alias("line_no"),
            F.lit(i // 3 + 1).alias("page"),
            text.alias("text"),
            (((key * 7 + i) % 41 + 60).cast("double") / 100).alias("confidence"),
        )

    texts = (
        F.when(key % 3 == 0, "HAVALE DEKONTU").when(key % 3 == 1, "SATIŞ FATURA KDV").otherwise("MEMO"),
        F.when(key % 4 != 0, F.concat(F.lit("Dekont No: "), F.lpad(key.cast("string"), 10, "0"))),
        F.concat(F.lit("Tarih: "), F.date_format("o_orderdate", "dd.MM.yyyy")),
        F.when(
            key % 6 != 5,
            F.concat(
                F.lit("IBAN TR"),
                F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"),
                F.lpad(key.cast("string"), 22, "0"),
            ),
        ),
        F.concat(
            F.lit("Toplam: "), F.replace(_money(F.col("o_totalprice")), F.lit("."), F.lit(",")), F.lit(" TL")
        ),
    )
    all_lines = F.filter(
        F.array(*[line(i, t) for i, t in enumerate(texts)]), lambda x: x["text"].isNotNull()
    )
    return o.select(key.alias("doc_id"), F.inline(all_lines)).select(
        "*",
        F.lit(None).cast("array<array<double>>").alias("bbox"),
        F.lit("raw").alias("method"),
    )


SQL_OCR_LINES = """
ol0 AS (
  SELECT o_orderkey AS doc_id, i + 1 AS line_no, i // 3 + 1 AS page,
    CAST((o_orderkey * 7 + i) % 41 + 60 AS double) / 100 AS confidence,
    CASE i
      WHEN 0 THEN CASE o_orderkey % 3 WHEN 0 THEN 'HAVALE DEKONTU' WHEN 1 THEN 'SATIŞ FATURA KDV' ELSE 'MEMO' END
      WHEN 1 THEN CASE WHEN o_orderkey % 4 <> 0 THEN 'Dekont No: ' || lpad(CAST(o_orderkey AS varchar), 10, '0') END
      WHEN 2 THEN 'Tarih: ' || strftime(o_orderdate, '%d.%m.%Y')
      WHEN 3 THEN CASE WHEN o_orderkey % 6 <> 5 THEN 'IBAN TR' || lpad(CAST(o_custkey % 100 AS varchar), 2, '0')
                       || lpad(CAST(o_orderkey AS varchar), 22, '0') END
      ELSE 'Toplam: ' || replace(CAST(CAST(o_totalprice AS decimal(12,2)) AS varchar), '.', ',') || ' TL' END AS text
  FROM orders, (SELECT unnest([0, 1, 2, 3, 4]) AS i)),
ol AS (SELECT * FROM ol0 WHERE text IS NOT NULL),
dt AS (
  SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS raw_text,
    sum(confidence ORDER BY line_no) / count(*) AS mean_confidence
  FROM ol GROUP BY doc_id)"""

SIGNALS_SQL = """
cs AS (
  SELECT *, upper(raw_text) AS up,
    [s FOR s IN ['DEKONT', 'HAVALE', 'EFT', 'IBAN', 'HESAP NUMARASI', 'MÜŞTERİ NUMARASI',
      'MASRAF TUTARI', 'BSMV', 'TUTAR', 'BANKASI'] IF contains(upper(raw_text), s)] AS sb,
    [s FOR s IN ['FATURA', 'FİŞ', 'BELGE NO', 'KDV', 'TAX', 'PERAKENDE', 'SATIŞ']
      IF contains(upper(raw_text), s)] AS sr
  FROM dt),
cl AS (
  SELECT *, CASE WHEN len(sb) = 0 AND len(sr) = 0 THEN 'UNKNOWN'
                 WHEN len(sb) >= len(sr) THEN 'BANKING' ELSE 'RETAIL' END AS category
  FROM cs),
cf AS (
  SELECT doc_id, raw_text, mean_confidence, category,
    CASE category WHEN 'BANKING' THEN 'RECEIPT' WHEN 'RETAIL' THEN 'INVOICE' ELSE 'UNKNOWN' END AS document_family,
    CASE WHEN category <> 'BANKING' THEN 'UNKNOWN'
         WHEN contains(up, 'HAVALE') OR contains(up, 'EFT') THEN 'BANK_TRANSFER_RECEIPT'
         WHEN contains(up, 'DEKONT') THEN 'BANK_RECEIPT' ELSE 'UNKNOWN' END AS document_type,
    CASE WHEN category <> 'BANKING' THEN 'UNKNOWN' WHEN contains(up, 'HAVALE') THEN 'HAVALE'
         WHEN contains(up, 'EFT') THEN 'EFT' ELSE 'UNKNOWN' END AS transaction_type,
    CASE category WHEN 'BANKING' THEN sb WHEN 'RETAIL' THEN sr ELSE [] END AS signals
  FROM cl)"""


# -- boxes ---------------------------------------------------------------------------

LABEL = "TOPLAM"


def fx_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line table with boxes: a label per order, a number per line item.

    An order has a handful of items, so numbering them is a small window.
    """
    from pyspark.sql import Window as W

    def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
        corners = ((x0, y0), (x1, y0), (x1, y1), (x0, y1))
        return F.array(*[F.array(x.cast("double"), y.cast("double")) for x, y in corners])

    labels = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("doc_id"),
        F.lit(1).alias("line_no"),
        F.lit(LABEL).alias("text"),
        box(F.lit(10), F.lit(30), F.lit(110), F.lit(50)).alias("bbox"),
    )
    x0 = F.col("l_partkey") % 500 + 60
    y0 = F.col("l_suppkey") % 100
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    numbers = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"),
        (F.row_number().over(order) + 1).alias("line_no"),
        F.col("l_partkey").cast("string").alias("text"),
        box(x0, y0, x0 + 60, y0 + 20).alias("bbox"),
    )
    return labels.unionByName(numbers)


# -- adjustments and replies ------------------------------------------------------------


def fx_adjustments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    with_parts = li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.round(net, 2).alias("fee"),
        F.round(net * F.col("l_tax"), 2).alias("tax"),
    )
    extra = F.when(F.col("l_linenumber") % 5 == 0, 0.5).otherwise(0.0)
    return with_parts.select(
        F.col("l_orderkey").alias("doc_id"),
        "l_linenumber",
        "l_partkey",
        (F.col("fee") + F.col("tax") + extra).alias("total_impact"),
        F.create_map(F.lit("fee"), F.col("fee"), F.lit("tax"), F.col("tax")).alias("breakdown"),
    )


def fx_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    sender = F.when(key % 10 == 0, F.lit("null")).otherwise(
        F.concat(F.lit('"C'), F.col("o_custkey").cast("string"), F.lit('"'))
    )
    receiver = F.when(key % 15 == 0, F.lit('""')).otherwise(
        F.concat(F.lit('"S'), (F.col("o_custkey") % 97).cast("string"), F.lit('"'))
    )
    txid = F.when(
        key % 2 == 1, F.concat(F.lit(',"transaction_id":"'), key.cast("string"), F.lit('"'))
    ).otherwise(F.lit(""))
    report = F.when(key % 19 == 0, F.lit("")).otherwise(
        F.lit(',"engine_report":{"trust_score":0.9}')
    )
    full = F.concat(
        F.lit('{"document_analysis":{"sender":'), sender, F.lit(',"receiver":'), receiver, txid,
        F.lit('},"financial_hierarchy":{"root_transaction":{"amount":'),
        _money(F.col("o_totalprice")),
        F.lit('},"adjustments_and_fees":[]}'), report, F.lit("}"),
    )
    body = F.when(key % 17 == 0, F.lit('{"document_analysis": {')).otherwise(full)
    fenced = F.concat(F.lit("```json "), body, F.lit(" ```"))
    prose = F.concat(F.lit("Here: "), body, F.lit(" done"))
    return _spread(
        o.select(key.alias("doc_id"), F.when(key % 3 == 0, fenced).otherwise(prose).alias("reply"))
    )


SQL_REPLIES = """
rp AS (
  SELECT o_orderkey AS doc_id, o_orderkey % 17 = 0 AS broken, o_orderkey % 19 = 0 AS no_report,
    CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'C' || o_custkey END AS sender,
    CASE WHEN o_orderkey % 15 = 0 THEN '' ELSE 'S' || (o_custkey % 97) END AS receiver,
    CASE WHEN o_orderkey % 2 = 1 THEN CAST(o_orderkey AS varchar) END AS transaction_id,
    CAST(CAST(o_totalprice AS decimal(12,2)) AS varchar) AS amount_text
  FROM orders),
rb AS (
  SELECT *, CASE WHEN doc_id % 3 = 0 THEN '```json ' ELSE 'Here: ' END ||
    CASE WHEN broken THEN '{"document_analysis": {' ELSE
      '{"document_analysis":{"sender":' || coalesce('"' || sender || '"', 'null') ||
      ',"receiver":"' || receiver || '"' || coalesce(',"transaction_id":"' || transaction_id || '"', '') ||
      '},"financial_hierarchy":{"root_transaction":{"amount":' || amount_text ||
      '},"adjustments_and_fees":[]}' ||
      CASE WHEN no_report THEN '' ELSE ',"engine_report":{"trust_score":0.9}' END || '}' END ||
    CASE WHEN doc_id % 3 = 0 THEN ' ```' ELSE ' done' END AS reply
  FROM rp)"""


def fx_fee_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with one adjustment, whose parts are exact quarters and eighths.

    Totals are off by a half for every fifth order; some senders look like
    account numbers, well-formed or not.
    """
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    k = key.cast("string")
    fee, tax = (key % 100) / F.lit(4.0), (key % 10) / F.lit(8.0)
    total = fee + tax + F.when(key % 5 == 0, 0.5).otherwise(0.0)
    sender = (
        F.when(key % 4 == 0, F.concat(F.lit("IBAN TR12"), F.lpad(k, 22, "0")))
        .when(key % 4 == 1, F.concat(F.lit("IBAN "), k))
        .when(key % 4 == 2, F.concat(F.lit("C"), k))
    )
    group = F.when(key % 3 == 0, F.lit('"group_name":"MASRAF",')).otherwise(F.lit(""))
    parts = F.when(key % 7 == 0, F.lit("{}")).otherwise(
        F.concat(
            F.lit('{"fee":'), fee.cast("string"),
            F.lit(',"tax":"'), F.replace(tax.cast("string"), F.lit("."), F.lit(",")), F.lit('"}'),
        )
    )
    reply = F.concat(
        F.lit('{"document_analysis":{"type":"T'), (key % 5).cast("string"), F.lit('","sender":'),
        F.coalesce(F.concat(F.lit('"'), sender, F.lit('"')), F.lit("null")),
        F.lit('},"financial_hierarchy":{"root_transaction":{"amount":"'),
        F.replace(_money(F.col("o_totalprice")), F.lit("."), F.lit(",")),
        F.lit(' TL","label":"L'), (key % 9).cast("string"),
        F.lit('"},"adjustments_and_fees":['),
        F.when(
            key % 11 != 0,
            F.concat(
                F.lit("{"), group, F.lit('"total_impact":'), total.cast("string"),
                F.lit(',"breakdown":'), parts, F.lit("}"),
            ),
        ).otherwise(F.lit("")),
        F.lit(']},"engine_report":{"trust_score":0.75,"steps":["a",{"n":'), (key % 4).cast("string"),
        F.lit('}],"note":null}}'),
    )
    return _spread(o.select(key.alias("doc_id"), reply.alias("reply")))


SQL_FEE_REPLIES = """
fr AS (
  SELECT o_orderkey AS doc_id, (o_orderkey % 100) / 4.0::double AS fee, (o_orderkey % 10) / 8.0::double AS tax,
    (o_orderkey % 100) / 4.0::double + (o_orderkey % 10) / 8.0::double
      + CASE WHEN o_orderkey % 5 = 0 THEN 0.5::double ELSE 0.0::double END AS total,
    CASE o_orderkey % 4 WHEN 0 THEN 'IBAN TR12' || lpad(CAST(o_orderkey AS varchar), 22, '0')
      WHEN 1 THEN 'IBAN ' || o_orderkey WHEN 2 THEN 'C' || o_orderkey END AS sender,
    CASE WHEN o_orderkey % 3 = 0 THEN 'MASRAF' ELSE 'FEE' END AS group_name,
    o_orderkey % 11 <> 0 AS has_adjustment, o_orderkey % 7 <> 0 AS has_parts,
    'T' || (o_orderkey % 5) AS doc_kind, 'L' || (o_orderkey % 9) AS label,
    CAST(CAST(o_totalprice AS decimal(12,2)) AS double) AS amount
  FROM orders)"""


def fx_account_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines with a second account number in every third document."""
    lines = fx_ocr_lines(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    more = o.where(key % 3 == 0).select(
        key.alias("doc_id"),
        F.lit(6).alias("line_no"),
        F.lit(2).alias("page"),
        F.concat(F.lit("Hesap TR98"), F.lpad(key.cast("string"), 22, "0")).alias("text"),
        F.lit(0.9).alias("confidence"),
        F.lit(None).cast("array<array<double>>").alias("bbox"),
        F.lit("raw").alias("method"),
    )
    return lines.unionByName(more)


def fx_account_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies with no account number, a foreign one, or the document's first one."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    own = F.concat(
        F.lit("TR"), F.lpad((F.col("o_custkey") % 100).cast("string"), 2, "0"), F.lpad(key.cast("string"), 22, "0")
    )
    given = (
        F.when(key % 4 == 1, F.lit('"sender_iban":"XX1"'))
        .when(key % 4 == 2, F.concat(F.lit('"receiver_iban":"'), own, F.lit('"')))
        .when(key % 4 == 3, F.concat(F.lit('"sender_iban":"'), own, F.lit('"')))
        .otherwise("")
    )
    reply = F.concat(F.lit('{"document_analysis":{'), given, F.lit('},"financial_hierarchy":{},"engine_report":{}}'))
    return _spread(o.select(key.alias("doc_id"), reply.alias("reply")))


SQL_ACCOUNTS = """
ac0 AS (
  SELECT o_orderkey AS doc_id, 'TR' || lpad(CAST(o_custkey % 100 AS varchar), 2, '0') || lpad(CAST(o_orderkey AS varchar), 22, '0') AS own,
    'TR98' || lpad(CAST(o_orderkey AS varchar), 22, '0') AS other FROM orders),
ac AS (
  SELECT doc_id, [x FOR x IN list_distinct([CASE WHEN doc_id % 6 <> 5 THEN own END, CASE WHEN doc_id % 3 = 0 AND own <> other THEN other END])
      IF x IS NOT NULL] AS unordered,
    CASE WHEN doc_id % 6 <> 5 THEN own WHEN doc_id % 3 = 0 THEN other END AS one,
    CASE WHEN doc_id % 6 <> 5 AND doc_id % 3 = 0 AND own <> other THEN other END AS two,
    CASE doc_id % 4 WHEN 1 THEN 'XX1' WHEN 3 THEN own END AS s, CASE WHEN doc_id % 4 = 2 THEN own END AS r
  FROM ac0)"""


def fx_landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they land; every tenth comes again an hour later under another name."""
    line = F.struct("line_no", "page", "text", "confidence", "bbox", "method")
    lines = fx_ocr_lines(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(line).alias("lines"))
    key = F.col("doc_id")
    text = key.cast("string")
    docs = lines.join(fx_fee_replies(spark, sf_dir), "doc_id").select(
        "doc_id",
        F.when(key % 4 != 0, F.concat(F.lit("T"), text)).alias("task_id"),
        F.concat(text, F.lit(".pdf")).alias("filename"),
        (key % 50).alias("key_id"),
        F.lit("2024-01-30 10:00:00").cast("timestamp").alias("received_at"),
        "lines",
        "reply",
    )
    again = docs.where(key % 10 == 0).withColumns(
        {
            "filename": F.concat(text, F.lit("-2.pdf")),
            "received_at": F.lit("2024-01-30 11:00:00").cast("timestamp"),
        }
    )
    return docs.unionByName(again)


# -- payloads, passes, regions, uploads ---------------------------------------------------


def fx_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw recogniser JSON, three pages per order.

    Parallel lists on page 1, pairs on page 2, and on page 3 a list of mixed items: scalars,
    parallel lists with scores as text, pairs with a score as text, and a pair with a third
    member, which is none.
    """
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey").cast("string")
    lists = F.concat(
        F.lit('[{"dt_polys":[[[1,2],[3,2],[3,4],[1,4]]],"rec_texts":["  Dekont No: '), k,
        F.lit(' ","","Toplam"],"rec_scores":[0.9,0.8]}]'),
    )
    pairs = F.concat(
        F.lit("[[[[[1,2],[3,2],[3,4],[1,4]],[\" page two "), k,
        F.lit('",0.7]],[[[1,6],[3,6],[3,8],[1,8]],["son",0.5]]]]'),
    )
    mixed = F.concat(
        F.lit('[5,"[x",{"dt_polys":[[[2,1]],"?"],"rec_texts":["m '), k,
        F.lit('","[n] "],"rec_scores":["0.25"," 0.5 ",1]},[[[[7,8]],["{p} '), k,
        F.lit('","0.75"]],[[[1,2]],["three",0.5],7],null,"s"]]'),
    )
    page = F.explode(
        F.array(
            F.struct(F.lit(1).alias("page"), lists.alias("payload")),
            F.struct(F.lit(2).alias("page"), pairs.alias("payload")),
            F.struct(F.lit(3).alias("page"), mixed.alias("payload")),
        )
    )
    pages = o.select(F.col("o_orderkey").alias("doc_id"), page.alias("p")).select(
        "doc_id", "p.page", F.lit("raw").alias("method"), "p.payload"
    )
    return _spread(pages, "page")


SQL_PAYLOAD_LINES = """
pl AS (
  SELECT o_orderkey AS doc_id, i AS line_no, [1, 1, 2, 2, 3, 3, 3][i] AS page,
    CASE i WHEN 1 THEN 'Dekont No: ' || o_orderkey WHEN 2 THEN 'Toplam'
      WHEN 3 THEN ' page two ' || o_orderkey WHEN 4 THEN 'son'
      WHEN 5 THEN 'm ' || o_orderkey WHEN 6 THEN '[n]' ELSE '{p} ' || o_orderkey END AS text,
    [0.9, 0, 0.7, 0.5, 0.25, 0.5, 0.75][i]::double AS confidence,
    [1, NULL, 1, 1, 2, NULL, 7][i]::double AS x0
  FROM orders, (SELECT unnest(range(1, 8)) AS i))"""


def fx_stored_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrected outputs as stored: keys in any order, spaces, special characters, floats; some broken."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    text = k.cast("string")
    stored = F.concat(
        F.lit('{ "sender":"Ö<b> \'q\' & \\"'), text, F.lit('\\" 😀\\n", "amount" :'),
        F.when(k % 3 == 0, F.concat(text, F.lit(".50"))).when(k % 3 == 1, F.concat(text, F.lit(".0"))).otherwise(text),
        F.lit(',"list":[1e2, {"z":null,"Z":[true,{}]} ,[]],"a:b,c":"x'),
        F.when(k % 7 == 0, F.lit("")).otherwise(F.lit('"}')),
    )
    return o.select(k.alias("doc_id"), stored.alias("stored"))


def fx_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three recognition passes per order and page; some find nothing."""
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    tries = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("pass_no"), F.lit(n).alias("pass_name"))
                for i, n in enumerate(("raw", "standard", "inverted"))
            ]
        )
    )
    base = o.select(key.alias("doc_id"), tries.alias("t")).select("doc_id", "t.*")
    n = (F.col("doc_id") + F.col("pass_no") * 3) % 4
    count = F.when(F.col("doc_id") % 10 == 0, F.lit(0)).otherwise(n)
    block = F.transform(
        F.when(count > 0, F.sequence(F.lit(1), count.cast("int"))).otherwise(
            F.array().cast("array<int>")
        ),
        lambda b: F.struct(
            F.concat(F.lit("b"), b.cast("string")).alias("text"),
            (((F.col("doc_id") + b * 7) % 41 + 60).cast("double") / 100).alias("confidence"),
            F.lit(None).cast("array<array<double>>").alias("bbox"),
        ),
    )
    return base.select("doc_id", F.lit(1).alias("page"), "pass_no", "pass_name", block.alias("blocks"))


SQL_PASSES = """
pn AS (
  SELECT o_orderkey AS doc_id, 1 AS page, i AS pass_no, ['raw', 'standard', 'inverted'][i + 1] AS pass_name,
    CASE WHEN o_orderkey % 10 = 0 THEN 0 ELSE (o_orderkey + i * 3) % 4 END AS blocks
  FROM orders, (SELECT unnest([0, 1, 2]) AS i)),
pb AS (
  SELECT pn.*, b, CAST((doc_id + b * 7) % 41 + 60 AS double) / 100 AS c
  FROM pn JOIN (SELECT unnest([1, 2, 3]) AS b) ON b <= blocks),
ps AS (
  SELECT pn.doc_id, pn.page, pn.pass_no, pn.pass_name, pn.blocks,
    coalesce(round(avg(c), 4), 0.0) AS confidence
  FROM pn LEFT JOIN pb USING (doc_id, page, pass_no) GROUP BY ALL)"""


def fx_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Layout regions out of the web pages: every third is a figure, every seventh empty."""
    p = table(spark, sf_dir, "pages")
    key = F.col("page_id")
    return p.select(
        (key % 100).alias("doc_id"),
        key.alias("page"),
        F.lit(1).alias("region_no"),
        F.when(key % 3 == 0, "figure").otherwise("table").alias("type"),
        F.when(key % 7 == 0, "").otherwise(F.col("html")).alias("html"),
    )


def fx_uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File listing: one upload per document, of accepted and other types."""
    d = table(spark, sf_dir, "documents")
    ext = F.element_at(
        F.array(*[F.lit(e) for e in (".pdf", ".PNG", ".jpeg", ".txt", ".jpg", "")]),
        (F.col("doc_id") % 6 + 1).cast("int"),
    )
    return d.select(
        F.concat(F.lit("/landing/in.d/scan_"), F.col("doc_id").cast("string"), ext).alias("path"),
        F.lit(None).cast("timestamp").alias("modificationTime"),
        F.col("n_chars").alias("length"),
    )


def fx_stage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage events of one job per user."""
    names = ("FILE_PREP", "OCR", "CLASSIFICATION", "EXTRACTION", "FINISHED")
    stage = F.element_at(
        F.array(*[F.lit(n) for n in names]), (F.col("event_id") % 5 + 1).cast("int")
    )
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("job_id"), stage.alias("stage"), "ts", "event_id"
    )


SQL_STAGE_EVENTS = """
se AS (
  SELECT user_id AS job_id, ts, event_id,
    ['FILE_PREP', 'OCR', 'CLASSIFICATION', 'EXTRACTION', 'FINISHED'][event_id % 5 + 1] AS stage,
    [10, 25, 50, 75, 100][event_id % 5 + 1] AS progress
  FROM events)"""
