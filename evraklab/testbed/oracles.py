"""The same questions in DuckDB's SQL, over the same tables."""

from __future__ import annotations

from evraklab.operators.prompts import GOALS_TEXT, ROLE_TEXT, SAMPLE_INPUT, STATIC_EXAMPLES
from evraklab.sinks.export import AGGREGATE_NS, BASIC_NS, INVOICE_NS
from evraklab.testbed.fixtures import (
    SIGNALS_SQL,
    SQL_CORRECTIONS,
    SQL_EXTRACTIONS,
    SQL_ACCOUNTS,
    SQL_FEE_REPLIES,
    SQL_OCR_LINES,
    SQL_PASSES,
    SQL_PAYLOAD_LINES,
    SQL_REPLIES,
    SQL_STAGE_EVENTS,
)

PHONE = r"\+1 \(\d{3}\) 555-\d{4}"


def _with(*tables: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",".join(tables) + "\n"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _half_up(expr: str, digits: int) -> str:
    """Round the shortest decimal text of a double, as Spark does."""
    return f"CAST(round(CAST(CAST({expr} AS varchar) AS decimal(30,18)), {digits}) AS double)"


EX = _with(SQL_EXTRACTIONS)
OL = _with(SQL_OCR_LINES)
STAMP = "strftime(created_at, '%Y-%m-%d %H:%M:%S') AS created_at"
IBAN_HITS = (
    "[replace(m, ' ', '') FOR m IN regexp_extract_all(raw_text, 'TR\\d{{2}}[\\s\\d]{{22,{n}}}')"
    " IF length(replace(m, ' ', '')) = 26]"
)
FIRST_DATE = "regexp_extract(raw_text, '\\d{2}[./]\\d{2}[./]\\d{4}')"
DATE_TEXT = (
    f"CASE WHEN {FIRST_DATE} <> '' THEN substr({FIRST_DATE}, 7, 4) || '-' || "
    f"substr({FIRST_DATE}, 4, 2) || '-' || substr({FIRST_DATE}, 1, 2) END"
)
TXID = "coalesce(" + ", ".join(
    f"nullif(regexp_extract(raw_text, '(?i){w}[\\s:]*(\\d{{6,20}})', 1), '')"
    for w in ("REF", "[İiIı]ŞLEM NO", "DEKONT NO", "SORGULAMA", "F[Iiİı]S NO", "F[Iiİı]Ş NO")
) + ")"
CLASSES = _with(SQL_OCR_LINES, SIGNALS_SQL)

# Trust, checks and decision of fee replies; every reply parses.
FEE_DECISION = """
jd AS (
  SELECT cf.*, fr.* EXCLUDE (doc_id, label), fr.label AS label,
    mean_confidence * 0.7 + 1.0 * 0.3 AS trust,
    has_adjustment AND has_parts AS summed, fee + tax AS parts
  FROM cf JOIN fr USING (doc_id)),
vr AS (
  SELECT *,
    CASE WHEN summed THEN 'math_check_' || group_name || '/' ||
      CASE WHEN abs(parts - total) < 0.01 THEN 'PASS/Math matches for ' || group_name || ': ' || parts || ' == ' || total
           ELSE 'FAIL/Math MISMATCH for ' || group_name || ': ' || parts || ' vs ' || total END END AS c1,
    CASE WHEN contains(coalesce(sender, 'None'), 'IBAN') OR length(coalesce(sender, 'None')) > 20 THEN
      CASE WHEN regexp_matches(sender, 'TR\\d{2}\\s?\\d{4}\\s?\\d{4}\\s?\\d{4}\\s?\\d{4}\\s?\\d{4}\\s?\\d{2}')
           THEN 'iban_format_sender/PASS/Valid TR IBAN found for sender'
           ELSE 'iban_format_sender/WARNING/Possible IBAN detected for sender but format is non-standard' END END AS c2
  FROM jd),
rs AS (
  SELECT *, concat_ws('; ', c1, c2) AS checks,
    CASE WHEN contains(coalesce(c1, ''), '/FAIL/') THEN 'ERROR'
         WHEN contains(coalesce(c2, ''), '/WARNING/') THEN 'WARNING' ELSE 'SUCCESS' END AS report_status
  FROM vr)"""


def _decision(source: str) -> str:
    """Decision over columns amount, sender, receiver, report_status, trust, reply_ok."""
    t4 = _half_up("trust", 4)
    return f"""
dc0 AS (
  SELECT *, {t4} AS t4, coalesce(sender, '') <> '' AS has_s, coalesce(receiver, '') <> '' AS has_r
  FROM {source}),
dc1 AS (
  SELECT *,
    concat_ws('; ',
      CASE WHEN amount >= 100000 THEN 'Transaction amount (' || amount || ') exceeds escalation threshold' END,
      CASE WHEN report_status = 'ERROR' THEN 'Severe mathematical or logical mismatch detected in validation' END,
      CASE WHEN NOT has_s AND NOT has_r THEN 'Both sender and receiver are missing from extraction' END) AS ups,
    concat_ws('; ',
      CASE WHEN t4 < 0.9 THEN 'Trust score (' ||
        printf('%.2f', round(CAST(CAST(t4 AS varchar) AS decimal(30,18)), 2)::double) ||
        ') is below auto-approval threshold' END,
      CASE WHEN report_status IS DISTINCT FROM 'SUCCESS' THEN 'Validation report status is ' || coalesce(report_status, 'None') END) AS doubts
  FROM dc0),
dc2 AS (
  SELECT *,
    CASE WHEN coalesce(amount, 0) <= 0 THEN 'REJECT' WHEN ups <> '' THEN 'ESCALATE'
         WHEN doubts = '' THEN CASE WHEN has_s AND has_r THEN 'AUTO_BOOK' ELSE 'AUTO_APPROVE' END
         ELSE 'REVIEW_REQUIRED' END AS action,
    CASE WHEN trust < 0.6 OR report_status IN ('WARNING', 'ERROR') THEN 'REVIEW_REQUIRED'
         WHEN NOT reply_ok THEN 'PARTIAL_FAILURE' ELSE 'SUCCESS' END AS provisional
  FROM dc1),
dc AS (
  SELECT *,
    CASE action WHEN 'REJECT' THEN 0.95 WHEN 'ESCALATE' THEN 0.85
      WHEN 'REVIEW_REQUIRED' THEN {_half_up("0.4::double + (1.0::double - t4) * 0.4::double", 4)}
      ELSE {_half_up("1.0::double - t4", 4)} END AS risk_score,
    CASE WHEN action LIKE 'AUTO%' THEN 0 ELSE 1 END AS human_review,
    CASE action WHEN 'REJECT' THEN 'Root transaction amount is missing or invalid'
      WHEN 'ESCALATE' THEN ups WHEN 'REVIEW_REQUIRED' THEN doubts ||
        '; Document requires manual verification due to warnings or moderate confidence'
      ELSE 'High trust score and clean validation check' END AS reasons,
    CASE action WHEN 'REJECT' THEN 'FAILED' WHEN 'ESCALATE' THEN 'REVIEW_REQUIRED'
      WHEN 'REVIEW_REQUIRED' THEN provisional ELSE 'SUCCESS' END AS status
  FROM dc2)"""


UPDATED = """
  SELECT task_id,
    CASE WHEN c.task_id IS NULL THEN e.status ELSE 'APPROVED' END AS status,
    CASE WHEN c.task_id IS NULL THEN e.is_verified ELSE 1 END AS is_verified,
    c.approved_by AS approved_by,
    CASE WHEN c.task_id IS NULL THEN e.corrected_json ELSE c.corrected_json END AS corrected_json,
    CASE WHEN c.task_id IS NULL THEN NULL ELSE '{fields}' END AS corrected_fields,
    strftime(c.corrected_at, '%Y-%m-%d %H:%M:%S') AS approved_at
  FROM ex e LEFT JOIN {source} c USING (task_id)"""

APPROVALS = """
nw AS (SELECT task_id, extracted_json FROM ex ORDER BY created_at DESC, id DESC, task_id DESC LIMIT 100),
rq AS (SELECT CAST(event_id AS varchar) AS task_id, 'Admin' AS approved_by, ts AS corrected_at
       FROM events WHERE event_id % 3 = 0),
ap AS (SELECT rq.*, nw.extracted_json AS corrected_json FROM rq JOIN nw USING (task_id))"""

EXAMPLES = (
    SQL_EXTRACTIONS
    + """,
vx AS (
  SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY created_at DESC, id DESC, task_id DESC) AS rank
  FROM ex WHERE is_verified = 1 QUALIFY rank <= 3),
eg AS (
  SELECT document_type AS category, CAST(rank AS integer) + 1000 AS ordinal,
    CASE WHEN coalesce(raw_text, '') <> '' THEN raw_text ELSE """
    + _text(SAMPLE_INPUT)
    + """ END AS input, corrected_json AS output FROM vx
  UNION ALL SELECT * FROM (VALUES """
    + ", ".join(
        f"({_text(c)}, {i}, {_text(a)}, {_text(b)})" for i, (c, a, b) in enumerate(STATIC_EXAMPLES)
    )
    + "))"
)

TABLES_SQL = """
tb AS (
  SELECT page_id % 100 AS doc_id, string_agg('Page ' || page_id || ' Table:' || chr(10) || 'HTML_TABLE:' || chr(10)
    || html || chr(10), chr(10) ORDER BY page_id) AS tables
  FROM pages WHERE page_id % 3 <> 0 AND page_id % 7 <> 0 AND coalesce(html, '') <> '' GROUP BY ALL)"""

PLAIN = "CAST(CAST(o_totalprice AS decimal(12,2)) AS varchar)"
NOISY = f"""
nz AS (
  SELECT o_orderkey, CASE o_orderkey % 11
    WHEN 0 THEN replace(p, '.', ',')
    WHEN 1 THEN '- ' || replace(p, '.', ',') || ' TL'
    WHEN 2 THEN 'E ' || p || ' €'
    WHEN 3 THEN replace(replace(p, '0', 'O'), '1', 'I')
    WHEN 4 THEN split_part(p, '.', 1) || '.000,' || split_part(p, '.', 2)
    WHEN 5 THEN split_part(p, '.', 1) || ',000.' || split_part(p, '.', 2)
    WHEN 6 THEN p || '.00,5'
    WHEN 7 THEN split_part(p, '.', 1) || ' , ' || split_part(p, '.', 2) || ' ~$'
    WHEN 8 THEN ''
    WHEN 9 THEN replace(replace(replace(p, '.', ','), '8', 'B'), '4', 'A')
    ELSE split_part(p, '.', 1) || ',1,2' END AS noisy
  FROM (SELECT o_orderkey, {PLAIN} AS p FROM orders)),
nc AS (
  SELECT o_orderkey, regexp_replace(translate(replace(replace(replace(replace(
      regexp_replace(noisy, '^[eE]\\s*', ''), 'TL', ''), '$', ''), '€', '6'), '~', ''),
      'EOoBIil|LGgZA', '6008111116924'), '[^\\d.,]', '', 'g') AS clean
  FROM nz),
nn AS (
  SELECT *, length(clean) - length(replace(clean, '.', '')) AS dots,
    length(clean) - length(replace(clean, ',', '')) AS commas FROM nc)"""

INVOICE = f"""
SELECT CAST(doc_id AS varchar) AS task_id,
  '<?xml version=''1.0'' encoding=''UTF-8''?>' || chr(10) ||
  '<Invoice xmlns="{INVOICE_NS}" xmlns:cac="{AGGREGATE_NS}" xmlns:cbc="{BASIC_NS}">' || chr(10) ||
  '  <cbc:UBLVersionID>2.1</cbc:UBLVersionID>' || chr(10) ||
  '  <cbc:ID>' || upper(substr(sha256(CAST(doc_id AS varchar)), 1, 16)) || '</cbc:ID>' || chr(10) ||
  '  <cbc:IssueDate>2024-01-31</cbc:IssueDate>' || chr(10) ||
  '  <cac:LegalMonetaryTotal>' || chr(10) ||
  '    <cbc:PayableAmount currencyID="TRY">' || amount || '</cbc:PayableAmount>' || chr(10) ||
  '  </cac:LegalMonetaryTotal>' || chr(10) || '</Invoice>' || chr(10) AS xml
FROM fr"""

ORACLES: dict[str, str] = {
    "platform_insights": EX + """
SELECT round(count(*) FILTER (trust_score > 0.85) * 5 / 60.0, 1)::double AS hours_saved,
  round(count(*) FILTER (trust_score > 0.85) / greatest(count(*), 1) * 100, 1)::double AS automation_rate,
  round(coalesce(avg(trust_score) FILTER (created_at >= DATE '2024-01-24'), 0.0) * 100, 1)::double AS accuracy_score,
  count(*) FILTER (is_verified = 1) AS knowledge_base_size,
  count(*) FILTER (trust_score < 0.5 OR processing_time > 30) AS active_anomalies
FROM ex""",
    "dashboard_stats": EX + """
SELECT (SELECT '[' || string_agg('{"document_type":"' || document_type || '","n":' || n || '}', ',' ORDER BY document_type) || ']'
        FROM (SELECT document_type, count(*) AS n FROM ex GROUP BY 1)) AS doc_types,
  count(*) FILTER (trust_score >= 0.90) / greatest(count(*), 1) * 100 AS success_rate,
  round(coalesce(avg(processing_time), 0.0), 2) AS avg_processing_time,
  greatest(count(*), 1) AS total_documents
FROM ex""",
    "docs_by_type": EX + "SELECT document_type, count(*) AS n FROM ex GROUP BY 1",
    "recent_by_day": EX + """
SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, round(avg(trust_score), 6) AS mean_trust
FROM ex WHERE created_at >= DATE '2024-01-24' GROUP BY 1""",
    "history_top": EX + f"""
SELECT task_id, filename, status, trust_score, {STAMP} FROM (
  SELECT * FROM ex ORDER BY ex.created_at DESC, id DESC, task_id DESC LIMIT 10)""",
    "pending_reviews": EX + f"""
SELECT task_id, filename, status, trust_score, {STAMP} FROM (
  SELECT * FROM ex WHERE status = 'REVIEW_REQUIRED' ORDER BY ex.created_at DESC, id DESC, task_id DESC LIMIT 20)""",
    "anomalies_top": EX + f"""
SELECT filename, document_type, trust_score, processing_time, {STAMP} FROM (
  SELECT * FROM ex WHERE trust_score < 0.6 OR processing_time > 40
  ORDER BY ex.created_at DESC, id DESC, task_id DESC LIMIT 5)""",
    "verified_examples": EX + f"""
SELECT document_type, CAST(rank AS integer) AS rank, task_id, raw_text, corrected_json, {STAMP} FROM (
  SELECT *, row_number() OVER (PARTITION BY document_type ORDER BY created_at DESC, id DESC, task_id DESC) AS rank
  FROM ex WHERE is_verified = 1) WHERE rank <= 3""",
    "active_only": EX + """
SELECT api_key_id, count(*) AS n, min(id) AS first_id FROM ex
WHERE api_key_id IN (SELECT DISTINCT api_key_id FROM ex WHERE api_key_id % 3 <> 0) GROUP BY 1""",
    "amount_parse": _with(NOISY) + """
SELECT o_orderkey, clean,
  CASE WHEN clean = '' OR dots + commas > 2 THEN 0.0::double ELSE coalesce(abs(try_cast(
    CASE WHEN commas = 1 AND dots = 0 THEN replace(clean, ',', '.')
         WHEN commas > 0 AND dots > 0 AND instr(clean, '.') > instr(clean, ',') THEN replace(clean, ',', '')
         WHEN commas > 0 AND dots > 0 THEN replace(replace(clean, '.', ''), ',', '.')
         ELSE clean END AS double)), 0.0::double) END AS amount
FROM nn""",
    "iban_scan": OL + f"""
SELECT doc_id, ({IBAN_HITS.format(n=28)})[1] AS first_iban,
  array_to_string({IBAN_HITS.format(n=32)}, '|') AS ibans FROM dt""",
    "date_scan": OL + f"SELECT doc_id, {DATE_TEXT} AS found_date FROM dt",
    "txid_scan": OL + f"SELECT doc_id, {TXID} AS transaction_id FROM dt",
    "document_text": OL + """
SELECT doc_id, raw_text, (SELECT count(*) FROM ol WHERE ol.doc_id = dt.doc_id) AS n_lines,
  round(mean_confidence, 6) AS mean_confidence FROM dt""",
    "classify_docs": CLASSES + """
SELECT doc_id, category AS domain, document_family, document_type, transaction_type,
  least(round(len(signals) / 5, 2), 1.0::double) AS confidence,
  array_to_string(signals, '|') AS classification_signals FROM cf""",
    "classify_by_rule_table": CLASSES + """
SELECT doc_id, category AS domain, document_family, document_type, transaction_type,
  least(round(len(signals) / 5, 2), 1.0::double) AS confidence,
  array_to_string(signals, '|') AS classification_signals FROM cf""",
    "mask_text": f"""
SELECT doc_id, md5(regexp_replace(text, '{PHONE}', '[PHONE]', 'g')) AS masked_md5,
  len(list_distinct(regexp_extract_all(text, '{PHONE}'))) AS n_entries FROM documents""",
    "mask_entries": f"""
WITH hits AS (
  SELECT doc_id, unnest(h) AS original, unnest(range(1, len(h) + 1)) AS pos
  FROM (SELECT doc_id, regexp_extract_all(text, '{PHONE}') AS h FROM documents)),
firsts AS (SELECT doc_id, original, min(pos) AS pos FROM hits GROUP BY ALL)
SELECT doc_id, '[PHONE_' || (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1) || ']' AS placeholder,
  original FROM firsts""",
    "mask_iban": OL + r"""
SELECT doc_id, regexp_replace(text, '\bTR\d{2}\s?(?:\d{4}\s?){5}\d{2}\b', '[IBAN_0]') AS masked
FROM ol""",
    "unmask_roundtrip": "SELECT doc_id, md5(text) AS text_md5 FROM documents",
    "normalise_ocr": _with(SQL_PAYLOAD_LINES) + "SELECT doc_id, line_no, page, text, confidence, x0 FROM pl",
    "table_regions": _with(TABLES_SQL)
    + "SELECT doc_id, md5(tables) AS tables_md5, length(tables) AS n_chars FROM tb",
    "page_metrics": OL + """
SELECT doc_id, page, count(*) AS blocks, CAST(sum(length(text)) AS bigint) AS chars,
  round(avg(confidence), 6) AS mean_confidence, 'SUCCESS' AS status FROM ol GROUP BY 1, 2""",
    "doc_metrics": OL + """,
pm AS (SELECT doc_id, page, count(*) AS b, sum(length(text)) AS c, avg(confidence) AS m FROM ol GROUP BY 1, 2)
""".replace(",\npm", ", pm", 1) + """
SELECT doc_id, CAST(sum(b) AS bigint) AS total_blocks, CAST(sum(c) AS bigint) AS total_chars,
  count(*) AS page_count, round(var_pop(b), 6) AS block_variance, round(var_pop(m), 6) AS confidence_variance
FROM pm GROUP BY 1""",
    "pass_metrics": _with(SQL_PASSES) + "SELECT * FROM ps",
    "mean_passes": _with(SQL_PASSES) + """
SELECT doc_id, avg(n) AS avg_passes FROM (SELECT doc_id, page, count(*) AS n FROM ps GROUP BY 1, 2) GROUP BY 1""",
    "best_pass": _with(SQL_PASSES) + """
SELECT doc_id, page, pass_no, pass_name, blocks, confidence FROM ps
QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY blocks > 0 DESC,
  CASE WHEN blocks > 0 THEN pass_no END, blocks DESC, pass_no) = 1""",
    "parse_reply": _with(SQL_REPLIES) + """,
cu AS (
  SELECT doc_id, CASE WHEN regexp_matches(reply, '(?s)```json\\s*(.*?)\\s*```')
      THEN trim(regexp_extract(reply, '(?s)```json\\s*(.*?)\\s*```', 1))
      ELSE substr(reply, instr(reply, '{'), length(reply) - instr(reverse(reply), '}') + 2 - instr(reply, '{')) END AS body
  FROM rb),
ok AS (
  SELECT *, json_valid(body) AND coalesce(CASE WHEN json_valid(body) THEN
      json_type(body, '$.document_analysis') = 'OBJECT' AND json_type(body, '$.financial_hierarchy') = 'OBJECT'
      AND json_type(body, '$.engine_report') = 'OBJECT' END, false) AS good FROM cu)
SELECT doc_id, CASE WHEN good THEN 'SUCCESS' ELSE 'ERROR' END AS status,
  CASE WHEN good THEN coalesce(CAST(json_extract_string(body, '$.engine_report.trust_score') AS double), 0.0) END AS reply_confidence,
  CASE WHEN good THEN json_extract_string(body, '$.document_analysis.sender') END AS sender,
  CASE WHEN good THEN CAST(json_extract_string(body, '$.financial_hierarchy.root_transaction.amount') AS double) END AS amount
FROM ok""",
    "fill_fallbacks": _with(SQL_OCR_LINES, SIGNALS_SQL, SQL_REPLIES) + f""",
jn AS (
  SELECT cf.doc_id, raw_text, category, transaction_id, {TXID} AS found_id, {DATE_TEXT} AS found_date,
    ({IBAN_HITS.format(n=32)})[1] AS iban
  FROM cf JOIN rp USING (doc_id) WHERE NOT broken AND NOT no_report),
fb AS (
  SELECT doc_id, category AS type, 'TRY' AS currency,
    coalesce(transaction_id, found_id) AS transaction_id, found_date AS transaction_date,
    CAST(NULL AS varchar) AS sender_iban, iban AS receiver_iban,
    CASE WHEN transaction_id IS NULL AND found_id IS NOT NULL THEN 'deterministic_fallback' ELSE 'llm' END AS transaction_id_source,
    CASE WHEN found_date IS NOT NULL THEN 'deterministic_fallback' ELSE 'llm' END AS transaction_date_source,
    'llm' AS sender_iban_source,
    CASE WHEN iban IS NOT NULL THEN 'deterministic_fallback' ELSE 'llm' END AS receiver_iban_source
  FROM jn)
SELECT * FROM (SELECT doc_id FROM cf) LEFT JOIN fb USING (doc_id)""",
    "math_check_items": """
WITH p AS (
  SELECT l_orderkey AS doc_id, l_linenumber, l_partkey, round(l_extendedprice * (1 - l_discount), 2) AS fee,
    round(l_extendedprice * (1 - l_discount) * l_tax, 2) AS tax FROM lineitem),
q AS (SELECT *, fee + tax + CASE WHEN l_linenumber % 5 = 0 THEN 0.5::double ELSE 0.0::double END AS total FROM p)
SELECT doc_id, l_linenumber, l_partkey,
  CASE WHEN abs(fee + tax - total) < 0.05 THEN 'MATCH' ELSE 'MISMATCH' END AS math_status,
  CASE WHEN abs(fee + tax - total) < 0.01 THEN 'PASS' ELSE 'FAIL' END AS "check" FROM q""",
    "validate_docs": _with(SQL_OCR_LINES, SIGNALS_SQL, SQL_FEE_REPLIES, FEE_DECISION) + """
SELECT doc_id, report_status AS status, checks,
  CASE WHEN has_adjustment THEN
    CASE WHEN amount <> 0 AND NOT abs(CASE WHEN has_parts THEN parts ELSE 0 END - total) < 0.05
         THEN 'MISMATCH' ELSE 'MATCH' END END AS math_status
FROM rs""",
    "decide_docs": _with(SQL_OCR_LINES, SIGNALS_SQL, SQL_FEE_REPLIES, FEE_DECISION)
    + ", rd AS (SELECT *, true AS reply_ok, CAST(NULL AS varchar) AS receiver FROM rs),"
    + _decision("rd")
    + "SELECT doc_id, status, action, risk_score::double AS risk_score, human_review, reasons FROM dc",
    "document_outcomes": _with(SQL_OCR_LINES, SIGNALS_SQL, SQL_REPLIES) + """,
jo AS (
  SELECT cf.doc_id, category, NOT broken AND NOT no_report AS reply_ok, mean_confidence,
    CASE WHEN NOT broken AND NOT no_report THEN sender END AS sender,
    CASE WHEN NOT broken AND NOT no_report THEN receiver END AS receiver,
    CASE WHEN NOT broken AND NOT no_report THEN CAST(amount_text AS double) ELSE 0.0::double END AS amount,
    CASE WHEN NOT broken AND NOT no_report THEN 'SUCCESS' END AS report_status,
    mean_confidence * 0.7 + CASE WHEN NOT broken AND NOT no_report THEN 1.0::double ELSE 0.0::double END * 0.3 AS trust
  FROM cf JOIN rp USING (doc_id)),""" + _decision("jo") + """,
mt AS (SELECT doc_id, count(*) AS total_blocks, count(DISTINCT page) AS page_count FROM ol GROUP BY 1)
SELECT doc_id, category AS domain, t4 AS trust, status, action, risk_score::double AS risk_score, human_review, reasons,
  CASE WHEN reply_ok THEN 'SUCCESS' ELSE 'FAILED' END AS reply_stage,
  CASE WHEN category = 'UNKNOWN' THEN 'PARTIAL_SUCCESS' ELSE 'SUCCESS' END AS class_stage,
  total_blocks, page_count, CASE WHEN NOT reply_ok THEN 'SkeletonFallback' END AS logic_applied
FROM dc JOIN mt USING (doc_id)""",
    "early_rejected": """
SELECT event_id * 2 AS doc_id, 'FAILED' AS status, 0.0::double AS overall_trust_score, 'FAILED' AS ocr_status
FROM events WHERE event_id * 2 NOT IN (SELECT o_orderkey FROM orders)""",
    "evidence_exact": OL + """,
tg AS (
  SELECT o_orderkey AS doc_id, s AS slot,
    CASE s WHEN 0 THEN CAST(o_orderkey AS varchar) WHEN 1 THEN 'DEKONT' ELSE upper('tarıh 2') END AS target
  FROM orders, (SELECT unnest([0, 1, 2]) AS s))
SELECT doc_id, slot, arg_min(text, line_no) AS evidence_text, 100.0::double AS score
FROM tg JOIN ol USING (doc_id)
WHERE contains(upper(text), target) OR contains(target, upper(text)) GROUP BY 1, 2""",
    # A partial ratio folds, for every window of the longer string (also those hanging over
    # its ends), the bits of the shorter one's positions that a common subsequence leaves.
    "evidence_fuzzy": OL + """,
tg AS (
  SELECT o_orderkey AS doc_id, s AS slot, upper(CASE s
    WHEN 0 THEN CASE WHEN contains(CAST(o_totalprice AS varchar), '.') THEN CAST(o_totalprice AS varchar) ELSE o_totalprice || '.0' END
    WHEN 1 THEN 'Havale Dekonfu' ELSE 'SATIS FATURA' END) AS target
  FROM orders, (SELECT unnest([0, 1, 2]) AS s)),
pr AS (SELECT DISTINCT target, upper(text) AS line FROM tg JOIN ol USING (doc_id)),
rl AS (
  SELECT target, line, CASE WHEN length(target) <= length(line) THEN target ELSE line END AS s,
    CASE WHEN length(target) <= length(line) THEN line ELSE target END AS l FROM pr
  UNION
  SELECT target, line, line, target FROM pr WHERE length(target) = length(line)),
mk AS (
  SELECT target, line, length(s) AS m, length(l) AS n, contains(l, s) AS inside,
    [list_sum([CASE WHEN s[k] = l[i] THEN 1::hugeint << (k - 1) ELSE 0::hugeint END FOR k IN range(1, length(s) + 1)])::hugeint
     FOR i IN range(1, length(l) + 1)] AS masks
  FROM rl),
wd AS (SELECT *, unnest(range(2 - m, n + 1)) AS start FROM mk WHERE NOT inside),
sc AS (
  SELECT target, line, m, least(start + m - 1, n) - greatest(start, 1) + 1 AS seen,
    list_reduce(masks[greatest(start, 1):least(start + m - 1, n)],
      lambda v, h: ((v + (v & h)) | (v & (((1::hugeint << m) - 1) - h))) & ((1::hugeint << m) - 1), (1::hugeint << m) - 1) AS left_over
  FROM wd),
best AS (
  SELECT target, line, max(200.0 * (m - bit_count(left_over)) / (m + seen)) AS score FROM sc GROUP BY ALL
  UNION ALL SELECT DISTINCT target, line, 100.0 FROM mk WHERE inside),
hit AS (
  SELECT doc_id, slot, line_no, text, CAST(round_even(max(score), 0) AS double) AS score
  FROM tg JOIN ol USING (doc_id) JOIN best ON best.target = tg.target AND best.line = upper(text)
  GROUP BY ALL)
SELECT doc_id, slot, arg_max(text, {'s': score, 'l': -line_no}) AS evidence_text, max(score) AS score
FROM hit WHERE score > 80 GROUP BY doc_id, slot""",
    "proximity_nearest": """
WITH cd AS (
  SELECT l_orderkey AS doc_id, CAST(l_partkey AS varchar) AS text, l_partkey % 500 + 60 AS x0, l_suppkey % 100 AS y0,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS line_no FROM lineitem
  WHERE l_orderkey IN (SELECT o_orderkey FROM orders)),
nr AS (
  SELECT *, CAST(x0 - 110 AS double) AS distance, 'right' AS side FROM cd
  WHERE x0 - 110 > 0 AND x0 - 110 < 400 AND abs(y0 + 10 - 40) < 60
  UNION ALL
  SELECT *, CAST(y0 - 50 AS double), 'below' FROM cd
  WHERE y0 - 50 > 0 AND y0 - 50 < 150 AND abs(x0 + 30 - 60) < 60)
SELECT doc_id, 0 AS keyword_no, text, distance, side FROM nr
QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY distance, line_no, side DESC) = 1""",
    "apply_corrections": _with(SQL_EXTRACTIONS, SQL_CORRECTIONS)
    + UPDATED.format(fields='["manual_override"]', source="cl"),
    "unmatched_corrections": _with(SQL_EXTRACTIONS, SQL_CORRECTIONS) + """
SELECT task_id, corrected_json, approved_by FROM cl WHERE task_id NOT IN (SELECT task_id FROM ex)""",
    "stored_corrected": _with(SQL_EXTRACTIONS, SQL_CORRECTIONS) + """,
exv AS (
  SELECT task_id, CASE WHEN id % 3 = 0 THEN 'SUCCESS' WHEN id % 10 <> 1 THEN status END AS status,
    CASE WHEN id % 3 = 0 THEN 0 ELSE is_verified END AS is_verified,
    CASE WHEN id % 3 <> 0 THEN corrected_json END AS corrected_json FROM ex)"""
    + UPDATED.format(fields='["a"]', source="cl").replace("FROM ex e", "FROM exv e"),
    "store_rows": _with(SQL_OCR_LINES, SIGNALS_SQL, SQL_FEE_REPLIES, FEE_DECISION)
    + ", rd AS (SELECT *, true AS reply_ok, CAST(NULL AS varchar) AS receiver FROM rs),"
    + _decision("rd") + """
SELECT CAST('0x' || substr(md5(CAST(doc_id AS varchar)), 1, 15) AS bigint) AS id, CAST(doc_id AS varchar) AS task_id,
  CAST(NULL AS varchar) AS filename, category AS document_type, t4 AS trust_score, status, 0 AS is_verified,
  CAST(NULL AS varchar) AS corrected_json, 0.0::double AS processing_time, CAST(NULL AS varchar) AS error_type,
  CAST(NULL AS bigint) AS api_key_id, md5(raw_text) AS raw_text, CAST(NULL AS varchar) AS approved_by,
  CAST(NULL AS varchar) AS approved_at, CAST(NULL AS varchar) AS corrected_fields, '2024-01-31 00:00:00' AS created_at,
  report_status, status AS result_status, sender, true AS keeps_nulls,
  '{"note":null,"steps":["a",{"n":' || (doc_id % 4) || '}],"trust_score":0.75}' AS engine_report FROM dc""",
    "outcomes_user_rules": _with(SQL_OCR_LINES) + """,
ru AS (
  SELECT n_nationkey % 5 AS p, n_nationkey AS i,
    CASE n_nationkey WHEN 3 THEN 'Y' ELSE lpad(CAST(n_nationkey + 1 AS varchar), 2, '0') || '.' END AS s
  FROM nation WHERE n_nationkey <> 9),
hi AS (
  SELECT doc_id, p, count(*) AS n, string_agg(s, '|' ORDER BY i) AS signals
  FROM dt JOIN ru ON contains(upper(raw_text), s) GROUP BY 1, 2),
be AS (SELECT * FROM hi QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, p) = 1)
SELECT doc_id, coalesce('D' || p, 'UNKNOWN') AS domain, coalesce('F' || p, 'UNKNOWN') AS family,
  CASE WHEN n IS NULL THEN 0 ELSE least(round(n / 5, 2), 1.0) END::double AS confidence, coalesce(signals, '') AS signals, 'T' || (doc_id % 5) AS type
FROM dt LEFT JOIN be USING (doc_id)""",
    "approve_latest": _with(SQL_EXTRACTIONS, APPROVALS) + UPDATED.format(fields="[]", source="ap"),
    "approve_not_found": _with(SQL_EXTRACTIONS, APPROVALS)
    + "SELECT task_id FROM rq WHERE task_id NOT IN (SELECT task_id FROM nw)",
    "approve_any": _with(SQL_EXTRACTIONS, APPROVALS.replace(" ORDER BY created_at DESC, id DESC, task_id DESC LIMIT 100", ""))
    + UPDATED.format(fields="[]", source="ap"),
    "append_new_results": EX + "SELECT task_id, document_type, trust_score FROM ex WHERE id % 3 <> 0",
    "insert_if_absent": """
SELECT DISTINCT 'U' || (c_custkey % 1000) AS name FROM customer
WHERE 'U' || (c_custkey % 1000) NOT IN (SELECT 'U' || s_suppkey FROM supplier)""",
    "create_keys": """
WITH k AS (
  SELECT 'sk_' || substr(sha256(c_custkey || '|U' || (c_custkey % 1000)), 1, 12) AS key_hash, c_custkey % 1000 AS u
  FROM customer)
SELECT 'Default' AS label, 1 AS is_active, count(*) AS n, min(key_hash) AS first_key, max(key_hash) AS last_key,
  count(DISTINCT u) AS users FROM k""",
    "evolve_store": EX + """
SELECT task_id, document_type, CASE WHEN id % 2 = 0 THEN 'SUCCESS' ELSE status END AS status,
  CASE WHEN id % 2 = 0 THEN 0 ELSE is_verified END AS is_verified,
  CASE WHEN id % 2 = 0 THEN NULL ELSE raw_text END AS raw_text,
  CASE WHEN id % 2 = 0 THEN NULL ELSE processing_time END AS processing_time FROM ex""",
    "retention_split": """
SELECT event_id, CASE WHEN ts < TIMESTAMP '2024-01-15 00:00:00' THEN 1 ELSE 0 END AS expired FROM events""",
    "upload_manifest": """
WITH u AS (
  SELECT doc_id, ['.pdf', '.PNG', '.jpeg', '.txt', '.jpg', ''][doc_id % 6 + 1] AS e, n_chars FROM documents)
SELECT '/landing/in.d/scan_' || doc_id || e AS path, 'scan_' || doc_id || e AS filename, 'scan_' || doc_id AS stem,
  lower(e) AS ext, CAST(e = '.pdf' AS integer) AS is_pdf, n_chars AS length,
  CAST(lower(e) IN ('.png', '.jpg', '.jpeg', '.pdf') AS integer) AS accepted FROM u""",
    "export_rows": _with(SQL_FEE_REPLIES) + """
SELECT 'scan_' || doc_id || '.pdf' AS "Filename", amount AS "Total_Amount", label AS "Label",
  'N/A' AS "Text_Confirmation", doc_kind AS "Document_Type",
  CASE WHEN has_adjustment THEN group_name END AS "Adjustment_Group",
  CASE WHEN has_adjustment THEN total END AS "Group_Total",
  CASE WHEN has_adjustment THEN CASE WHEN amount <> 0 AND NOT
    abs(CASE WHEN has_parts THEN fee + tax ELSE 0 END - total) < 0.05 THEN 'MISMATCH' ELSE 'MATCH' END END AS "Math_Status",
  CASE WHEN has_adjustment THEN CASE WHEN has_parts THEN '{"fee": ' || fee || ', "tax": ' || tax || '}' ELSE '{}' END END AS "Breakdown"
FROM fr""",
    "invoice_xml": _with(SQL_FEE_REPLIES) + INVOICE,
    "example_set": _with(EXAMPLES) + "SELECT * FROM eg",
    "prompts": _with(SQL_OCR_LINES, SIGNALS_SQL, EXAMPLES, TABLES_SQL) + f""",
es AS (
  SELECT category, string_agg(chr(10) || 'INPUT: ' || input || chr(10) || 'OUTPUT: ' || output || chr(10) || '---' || chr(10), ''
    ORDER BY ordinal) AS shots FROM eg GROUP BY 1),
tx AS (SELECT doc_id, string_agg(text, chr(10) ORDER BY line_no) AS text FROM ol GROUP BY 1),
pr AS (
  SELECT doc_id, cf.category, chr(10) || {_text(ROLE_TEXT)} || repeat(chr(10), 3) || 'CONTEXT:' || chr(10) || 'Document Type: '
    || cf.category || chr(10)
    || coalesce(chr(10) || 'TABLE DATA (Detected via Layout Engine):' || chr(10) || tables || chr(10), '')
    || repeat(chr(10), 2) || 'FULL OCR TEXT:' || chr(10) || text || repeat(chr(10), 2)
    || coalesce(chr(10) || 'EXAMPLES:' || chr(10) || shots || chr(10), '')
    || repeat(chr(10), 2) || {_text(GOALS_TEXT)} AS prompt
  FROM cf JOIN tx USING (doc_id) LEFT JOIN tb USING (doc_id) LEFT JOIN es ON es.category = cf.category)
SELECT doc_id, category, length(prompt) AS n_chars, md5(prompt) AS prompt_md5 FROM pr""",
    "canonical_outputs": r"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 <> 0 THEN
  '{"a:b,c": "x", "amount": ' || o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.5' WHEN 1 THEN '.0' ELSE '' END
  || ', "list": [100.0, {"Z": [true, {}], "z": null}, []], "sender": "\u00d6\u003cb\u003e \u0027q\u0027 \u0026 \"'
  || o_orderkey || '\" \ud83d\ude00\n"}' END AS shown
FROM orders""",
    "two_accounts": _with(SQL_ACCOUNTS) + """,
f AS (
  SELECT doc_id, s, r,
    CASE WHEN s IS NULL AND r IS NULL AND two IS NOT NULL THEN one WHEN s IS NULL AND r IS NOT NULL AND one <> r THEN one ELSE s END AS sender_iban,
    CASE WHEN s IS NULL AND r IS NULL THEN coalesce(two, one) WHEN r IS NULL AND s IS NOT NULL AND one <> s THEN one ELSE r END AS receiver_iban
  FROM ac)
SELECT doc_id, sender_iban, receiver_iban,
  CASE WHEN s IS NULL AND sender_iban IS NOT NULL THEN 'deterministic_fallback' ELSE 'llm' END AS sender_iban_source,
  CASE WHEN r IS NULL AND receiver_iban IS NOT NULL THEN 'deterministic_fallback' ELSE 'llm' END AS receiver_iban_source FROM f""",
    "party_checks": """
WITH c AS (
  SELECT o_orderkey AS doc_id, p, (o_orderkey + i) % 3 AS kind FROM orders, (VALUES (0, 'sender'), (1, 'receiver')) v(i, p)),
k AS (
  SELECT doc_id, string_agg(CASE kind WHEN 0 THEN 'iban_format_' || p || '/PASS/Valid TR IBAN found for ' || p
      ELSE 'iban_format_' || p || '/WARNING/Possible IBAN detected for ' || p || ' but format is non-standard' END, '; '
      ORDER BY p DESC) FILTER (kind < 2) AS parties, max(CAST(kind = 1 AS int)) AS odd FROM c GROUP BY 1)
SELECT doc_id, CASE WHEN odd = 1 OR doc_id % 11 < 6 THEN 'WARNING' ELSE 'SUCCESS' END AS status,
  concat_ws('; ', parties, CASE WHEN doc_id % 11 < 6 THEN
    'low_confidence_warning/WARNING/Primary amount has low OCR confidence (0.' || (doc_id % 11) || '0)' END) AS checks,
  CAST(doc_id % 2 = 0 AS int) + CAST(doc_id % 5 = 0 AS int) AS flagged FROM k""",
    "masked_replies": """
WITH a AS (
  SELECT o_orderkey AS doc_id, '1' || lpad(CAST(o_orderkey AS varchar), 9, '0') || '2' AS person,
    'TR12 0001 0002 0003 ' || lpad(CAST(o_orderkey % 10000 AS varchar), 4, '0') || ' 0005 06' AS account FROM orders)
SELECT doc_id, 'x [TC_KIMLIK_0] y [IBAN_0] tel [PHONE_0], [TC_KIMLIK_0] or [PHONE_1].' AS text,
  '[TC_KIMLIK_0]=' || person || ';[IBAN_0]=' || account || ';[PHONE_0]=0532 123 45 67;[PHONE_1]=0555 765 43 21' AS entries,
  account || '/0555 765 43 21' AS sender FROM a""",
    "failed_pages": OL + """,
pm AS (SELECT doc_id, page, count(*) AS b, sum(length(text)) AS c, avg(confidence) AS m FROM ol GROUP BY 1, 2),
al AS (SELECT o_orderkey AS doc_id, page FROM orders, (SELECT unnest([1, 2, 3]) AS page))
SELECT doc_id, CAST(sum(coalesce(b, 0)) AS bigint) AS total_blocks, CAST(sum(coalesce(c, 0)) AS bigint) AS total_chars,
  count(*) AS page_count, round(coalesce(var_pop(b), 0), 6) AS block_variance, round(coalesce(var_pop(m), 0), 6) AS confidence_variance
FROM al LEFT JOIN pm USING (doc_id, page) GROUP BY 1""",
    "reference_keywords": """
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 3 = 0 THEN '3' WHEN o_orderkey % 2 = 0 THEN '5' ELSE '9' END
  || lpad(CAST(o_orderkey AS varchar), 8, '0') AS transaction_id FROM orders""",
    "partial_replies": _with(SQL_REPLIES) + """
SELECT doc_id, CASE WHEN doc_id % 2 = 0 AND NOT broken AND NOT no_report THEN 'SUCCESS' ELSE 'ERROR' END AS reply_status,
  CASE WHEN doc_id % 2 = 0 AND NOT broken AND NOT no_report THEN 'SUCCESS' ELSE 'FAILED' END AS stage,
  CASE WHEN doc_id % 2 = 1 THEN 'no reply' WHEN broken THEN 'reply is not valid JSON'
    WHEN no_report THEN 'not an object in reply: engine_report' END AS details FROM rp""",
    "broken_examples": _with(EXAMPLES) + "SELECT * FROM eg WHERE category <> 'RETAIL' OR ordinal < 1000",
    "verified_key": "SELECT c_custkey AS id FROM customer WHERE c_custkey IN (4, 11)",
    "reply_bodies": r"""
SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 5 <> 0 THEN 'a "' || o_orderkey || '"' || chr(10) || 'b' END AS reply FROM orders""",
    "landed_rows": _with(SQL_OCR_LINES, SIGNALS_SQL, SQL_FEE_REPLIES, FEE_DECISION)
    + ", rd AS (SELECT *, true AS reply_ok, CAST(NULL AS varchar) AS receiver FROM rs),"
    + _decision("rd") + """
SELECT CASE WHEN doc_id % 4 <> 0 THEN 'T' ELSE '' END || doc_id AS task_id,
  doc_id || CASE WHEN doc_id % 10 = 0 THEN '-2.pdf' ELSE '.pdf' END AS filename, category AS document_type, status,
  CAST(doc_id % 50 AS bigint) AS api_key_id, CASE WHEN doc_id % 10 = 0 THEN '2024-01-30 11:00:00' ELSE '2024-01-30 10:00:00' END AS created_at
FROM dc""",
    "throttled_events": """
WITH RECURSIVE o AS (
  SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i
  FROM events),
f AS (
  SELECT event_id, user_id, i, 0 AS denied, 1 AS n, us AS last FROM o WHERE i = 1
  UNION ALL
  SELECT o.event_id, o.user_id, o.i,
    CASE WHEN o.us - f.last < 43200000000 AND f.n >= 3 THEN 1 ELSE 0 END,
    CASE WHEN o.us - f.last >= 43200000000 THEN 1 WHEN f.n >= 3 THEN f.n ELSE f.n + 1 END,
    CASE WHEN o.us - f.last < 43200000000 AND f.n >= 3 THEN f.last ELSE o.us END
  FROM f JOIN o ON o.user_id = f.user_id AND o.i = f.i + 1)
SELECT event_id, user_id, denied FROM f""",
    "throttled_one_key": """
WITH o AS (SELECT list(event_id ORDER BY ts, event_id) AS ids, list(epoch_us(ts) ORDER BY ts, event_id) AS us FROM events),
f AS (
  SELECT ids, list_reduce(us, lambda s, t: {
      'n': CASE WHEN t - s.last >= 3600000000 THEN 1 WHEN s.n >= 5 THEN s.n ELSE s.n + 1 END,
      'last': CASE WHEN t - s.last < 3600000000 AND s.n >= 5 THEN s.last ELSE t END,
      'denied': list_append(s.denied, CASE WHEN t - s.last < 3600000000 AND s.n >= 5 THEN 1 ELSE 0 END)},
    {'n': 0, 'last': -4000000000000000000::bigint, 'denied': []::integer[]}).denied AS denied FROM o)
SELECT unnest(ids) AS event_id, unnest(denied) AS denied FROM f""",
    "latest_stages": _with(SQL_STAGE_EVENTS) + """
SELECT job_id, stage AS current_stage, progress, strftime(ts, '%Y-%m-%d %H:%M:%S') AS updated_at FROM se
QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, progress DESC, event_id DESC) = 1""",
}
