"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

from .chat import BEGIN, CONTROL, END

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i, any_value(a.n) AS na, any_value(b.n) AS nb FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p WHERE 100 * i >= 85 * (na + nb - i)),
d AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, v) AS (SELECT DISTINCT a, a FROM d UNION SELECT r.id, d.b FROM r JOIN d ON r.v = d.a),
c AS (SELECT id, min(v) AS m FROM r GROUP BY id)
SELECT s.doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, coalesce(m, s.doc_id) AS component_id, s.doc_id = coalesce(m, s.doc_id) AS kept FROM s LEFT JOIN c ON c.id = s.doc_id"""

OP3 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, h, unnest(range(0, len(h) // 2)) AS p FROM d),
w AS (SELECT doc_id, p, substr(h, 2 * p + 1, 2) AS byte, CASE WHEN 2 * p + 200 <= len(h) THEN substr(h, 2 * p + 1, 200) END AS win FROM b),
f AS (SELECT doc_id, p, byte, win IS NOT NULL AND row_number() OVER (PARTITION BY win ORDER BY doc_id, p) > 1 AS later FROM w),
g AS (SELECT doc_id, p, byte, bool_or(later) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS gone FROM f),
k AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM g),
o AS (SELECT doc_id, count(*) FILTER (gone) AS n_removed, count(*) FILTER (opens) AS n_spans, string_agg(byte, '' ORDER BY p) FILTER (NOT gone) AS kept FROM k GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(from_hex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN o USING (doc_id)"""

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = f"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all({_LOWER.format("text")}, '{_WORD}'), []) AS ws FROM documents),
t AS (SELECT item_id, regexp_extract_all({_LOWER.format("text")}, '{_WORD}') AS ws FROM benchmark),
i AS (SELECT item_id, ws, least(10, len(ws)) AS n FROM t WHERE len(ws) > 0),
iw AS (SELECT DISTINCT item_id, n, array_to_string(ws[s + 1:s + n], ' ') AS w FROM (SELECT item_id, ws, n, unnest(range(0, len(ws) - n + 1)) AS s FROM i)),
dw AS (SELECT doc_id, s, n, array_to_string(ws[s + 1:s + n], ' ') AS w FROM (SELECT doc_id, ws, n, unnest(range(0, greatest(0, len(ws) - n + 1))) AS s FROM d, (SELECT DISTINCT n FROM i))),
h AS (SELECT doc_id, s, n, item_id FROM dw JOIN iw USING (n, w)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM h) GROUP BY doc_id),
own AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(k, ',' ORDER BY k)) AS digest FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM h) GROUP BY doc_id),
tok AS (SELECT doc_id, ws[p] AS term, p FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d)),
cnt AS (SELECT term, count(*) AS n FROM tok GROUP BY term),
rare AS (SELECT item_id, term FROM (SELECT item_id, term, row_number() OVER (PARTITION BY item_id ORDER BY coalesce(n, 0), encode(term)) AS r FROM (SELECT DISTINCT item_id, unnest(ws) AS term FROM t) LEFT JOIN cnt USING (term)) WHERE r <= 4),
need AS (SELECT item_id, count(*) AS need FROM rare GROUP BY item_id),
occ AS (SELECT doc_id, item_id, p, term FROM tok JOIN rare USING (term)),
closeby AS (SELECT a.doc_id, a.item_id, a.p, count(DISTINCT b.term) AS got FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND a.item_id = b.item_id AND b.p BETWEEN a.p - 19 AND a.p GROUP BY 1, 2, 3),
nearby AS (SELECT doc_id, count(DISTINCT item_id) AS n_near FROM closeby JOIN need USING (item_id) WHERE got >= need GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, coalesce(digest, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN nearby USING (doc_id)"""

_MARKS = "|".join("".join(f"\\{c}" if not c.isalnum() and c not in "_ " else c for c in mark) for mark in sorted(CONTROL, key=len, reverse=True))
OP9 = f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')) v),
t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k, {len(BEGIN) + len(END) + 2} + length(role) + length(text) + len(regexp_extract_all(text, '{_MARKS}')) AS size FROM c),
x AS (SELECT *, sum(size) OVER (PARTITION BY conv_id ORDER BY k) AS so_far, k = max(k) OVER (PARTITION BY conv_id) AS last FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(sum(so_far) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars FROM x GROUP BY conv_id"""

ORACLES = {"op1_minhash": OP1, "op3_suffixes": OP3, "op8_decontaminate": OP8, "op9_chat": OP9}
