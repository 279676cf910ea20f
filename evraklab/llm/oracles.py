"""SQL twins of the operators that SQL can express.

Trained models, token merges, hashes that SQL lacks, guess costs and markup have none;
tests hold those against brute force.
"""

from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
WORDS = rf"[x FOR x IN string_split_regex(coalesce({{}}, ''), '{SPACE}') IF x <> '']"

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, {WORDS.format("text")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
low AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM win JOIN low USING (k) WHERE least < doc_id),
word AS (SELECT doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (
  SELECT doc_id, string_agg(x, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id),
n AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS bigint) AS n_words, coalesce(n_removed, 0) AS n_removed,
  sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN kept USING (doc_id)"""

QUALITY = rf"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, {WORDS.format("text")} AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1),
rep AS (
  SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
line AS (
  SELECT doc_id, source, text, l, {WORDS.format("l")} AS lw
  FROM (SELECT doc_id, source, text, unnest(string_split(text, chr(10))) AS l FROM d)),
norm AS (
  SELECT doc_id, source, text, l, len(lw) AS size,
    translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM line WHERE len(lw) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM norm GROUP BY doc_id),
host AS (SELECT source, count(DISTINCT text) AS docs FROM d GROUP BY source),
often AS (
  SELECT source, k, count(DISTINCT text) AS n FROM norm GROUP BY source, k),
bad AS (SELECT source, k FROM often JOIN host USING (source) WHERE n > 20 OR (n >= 3 AND n > 0.5 * docs)),
gone AS (SELECT doc_id, sum(size) AS n FROM norm JOIN bad USING (source, k) GROUP BY doc_id),
s AS (
  SELECT d.doc_id, CAST(len(w) AS bigint) AS n_words,
    CAST(length(regexp_replace(text, '{SPACE}', '', 'g')) AS bigint) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS bigint) AS n_symbols,
    coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words,
    CAST(coalesce(gone.n, 0) AS bigint) AS n_line_words
  FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)),
j AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
    n_line_words > 0 AND (n_words - n_line_words < 20 OR n_words - n_line_words < 0.2 * n_words) AS depleted
  FROM s)
SELECT *, NOT base_failed AND NOT depleted AS kept FROM j"""

# crc32 of a list of bytes: the table of the reflected polynomial, then one look-up a byte.
CRC_TABLE = """SELECT list_transform(range(256), lambda i: list_reduce(range(8),
    lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS tab"""
CRC = "xor(list_reduce({}, lambda c, b: xor(c // 256, tab[1 + xor(c, b) % 256]), 4294967295), 4294967295)"

FOUND = "[A-Za-zÀ-ÿ]+"
SPELLING = rf"""
WITH crc AS ({CRC_TABLE}),
low AS (
  SELECT doc_id, translate(unnest(regexp_extract_all(coalesce(text, ''), '{FOUND}')),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
runs AS (
  SELECT w, count(*) AS n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS varchar), '') || ':' || w, ''),
    lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::bigint]
      ELSE [(192 + ord(c) // 64)::bigint, (128 + ord(c) % 64)::bigint] END)) AS bytes
  FROM low GROUP BY doc_id, w),
hashed AS (SELECT w, n, {CRC.format("bytes")} AS h FROM runs, crc),
words AS (
  SELECT CASE WHEN h % 199 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, CAST(sum(n) AS bigint) AS n
  FROM hashed GROUP BY 1 HAVING length(word) >= 6 AND sum(n) >= 5),
cell AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
hole AS (SELECT word, n, i, word[:i - 1] || '*' || word[i + 1:] AS k, word[:i - 1] || word[i + 1:] AS short FROM cell),
near AS (
  SELECT a.word, b.word AS other FROM hole a JOIN hole b USING (k) WHERE a.word <> b.word
  UNION SELECT a.word, b.word FROM hole a JOIN words b ON a.short = b.word
  UNION SELECT b.word, a.word FROM hole a JOIN words b ON a.short = b.word),
ranked AS (
  SELECT near.word, other, words.n AS other_n, count(*) OVER (PARTITION BY near.word) AS n_near,
    row_number() OVER (PARTITION BY near.word ORDER BY words.n DESC, other) AS k
  FROM near JOIN words ON other = words.word),
formed AS (
  SELECT words.word, n, coalesce(n_near, 0) AS n_near,
    CASE WHEN other_n >= 5 * n THEN other END AS form, CASE WHEN other_n >= 5 * n THEN other_n END AS form_n
  FROM words LEFT JOIN ranked ON words.word = ranked.word AND k = 1),
chain AS (
  WITH RECURSIVE up(word, top, step) AS (
    SELECT word, word, 0 FROM formed
    UNION ALL SELECT up.word, form, step + 1 FROM up JOIN formed ON top = formed.word WHERE form IS NOT NULL)
  SELECT word, arg_max(top, step) AS root FROM up GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN chain USING (word)"""

# The grammar as a machine of four places (nothing, after s, after u, after a) instead of
# an alignment: the cheapest and then least audit that ends in each place, turn by turn.
NEXT = "{{'c': {0}.c + {1}, 'a': {0}.a || '{2}'}}"


def _insert(paths: str) -> str:
    step = lambda p: NEXT.format(p, 3, "I")
    u = f"list_min([{paths}[3], {step(f'{paths}[1]')}, {step(f'{paths}[2]')}, {step(f'{paths}[4]')}])"
    a = f"list_min([{paths}[4], {step(f'({u})')}])"
    return f"[{paths}[1], {paths}[2], {u}, {a}]"


def _turn() -> str:
    gone = [NEXT.format(f"p[{i}]", 4, "D") for i in (1, 2, 3, 4)]
    move = lambda i, role: (
        f"{{'c': CASE WHEN r.forced THEN 1000000000 ELSE p[{i}].c + r.late + CASE WHEN r.i = '{role}' THEN 0 ELSE 3 END END,"
        f" 'a': p[{i}].a || CASE WHEN r.i = '{role}' THEN 'K' ELSE 'R' END}}"
    )
    keep_s = "{'c': CASE WHEN r.forced OR r.i <> 's' THEN 1000000000 ELSE p[1].c + r.late END, 'a': p[1].a || 'K'}"
    return (
        f"[{gone[0]}, list_min([{gone[1]}, {keep_s}]),"
        f" list_min([{gone[2]}, {move(1, 'u')}, {move(2, 'u')}, {move(4, 'u')}]), list_min([{gone[3]}, {move(3, 'a')}])]"
    )


START = "[{'c': 0::bigint, 'a': ''}, {'c': 1000000000::bigint, 'a': ''}, {'c': 1000000000::bigint, 'a': ''}, {'c': 1000000000::bigint, 'a': ''}]"
CONVERSATIONS = rf"""
WITH crc AS ({CRC_TABLE}),
known AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS varchar), ' ') || ':' || coalesce(CAST(turn AS varchar), ' ') AS k FROM conversations),
fated AS (
  SELECT conv_id, turn, role, text,
    {CRC.format("list_transform(string_split(k, ''), lambda c: ord(c)::bigint)")} % 20 AS h FROM known, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy
  FROM fated WHERE h <> 0),
judged AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
    WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) > 1 THEN 'duplicate'
    WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated'
    ELSE '' END AS fault, row_number() OVER o AS pos,
    left(lag(role) OVER o, 1) || left(role, 1) AS pair
  FROM damaged WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
conv AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated,
    count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal,
    list({{'i': left(role, 1), 'forced': fault IN ('blank', 'duplicate'),
      'late': CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END, 'role': role, 'text': text}} ORDER BY pos) AS rows
  FROM judged GROUP BY conv_id),
inserted AS (SELECT *, list_reduce(rows, lambda p, r: list_transform([{_turn()}], lambda p: {_insert("p")})[1],
    list_transform([{START}], lambda p: {_insert("p")})[1]) AS ends FROM conv),
best AS (SELECT *, list_min([ends[1], ends[4]]) AS best FROM inserted),
walked AS (
  SELECT *, list_reduce(string_split(best.a, ''), lambda s, e: list_transform([
      CASE WHEN e = 'D' OR e = '' THEN s.at WHEN e = 'K' AND s.at = 0 AND rows[s.k].i = 's' THEN 1
        WHEN s.at = 2 THEN 3 ELSE 2 END], lambda here: {{'at': here, 'k': s.k + CASE WHEN e IN ('I', '') THEN 0 ELSE 1 END,
      't': s.t || CASE WHEN e IN ('D', '') THEN '' ELSE CASE WHEN s.at = 0 THEN '' ELSE chr(10) END ||
        CASE WHEN e = 'K' THEN rows[s.k].role WHEN here = 3 THEN 'assistant' ELSE 'user' END || ':' ||
        CASE WHEN e = 'I' THEN '' ELSE rows[s.k].text END END}})[1],
    {{'at': 0, 'k': 1::bigint, 't': ''}}) AS walk FROM best)
SELECT a.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0) AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(walk.t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) a LEFT JOIN walked w ON a.conv_id IS NOT DISTINCT FROM w.conv_id"""

ORACLES: dict[str, str] = {
    "op6_substrings": SUBSTRINGS,
    "op9_quality": QUALITY,
    "op11_conversations": CONVERSATIONS,
    "op12_spelling": SPELLING,
}
