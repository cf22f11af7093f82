"""Queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from .classifier import op2_quality_classifier
from .decontaminate import op3_benchmark_decontamination
from .html import op7_html_extraction
from .licenses import op6_license_scan
from .jaccard import op5_ngram_jaccard
from .lm import op8_lm_scoring
from .mixing import OP10_SQL, op10_mixing
from .pii import op4_pii
from .quality import CHANCE, DUP_SHARE, LINE_SHARE, TOP_SHARE, op1_quality_rules
from .substring import op9_substring_dedup

QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_benchmark_decontamination, op4_pii, op5_ngram_jaccard, op6_license_scan, op7_html_extraction, op8_lm_scoring, op9_substring_dedup, op10_mixing)}

SQL = {"op10_mixing": OP10_SQL}

A_TO_Z = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op3_benchmark_decontamination"] = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({A_TO_Z}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({A_TO_Z}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(ws), 13) AS n, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(2, len(ws) - 11))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS k FROM (SELECT doc_id, ws, n, unnest(range(1, greatest(1, len(ws) - n + 2))) AS i FROM w, sizes)),
hit AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.k = bw.k AND dw.n = bw.n),
mark AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM hit) GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN mark USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL["op5_ngram_jaccard"] = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({A_TO_Z}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, a.n AS na, b.n AS nb, count(*) AS k FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY ALL),
l AS (SELECT a, b FROM p WHERE 100 * k >= 90 * (na + nb - k)),
r(a, b) AS (SELECT a, b FROM l UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce((SELECT min(b) FROM r WHERE r.a = doc_id), doc_id)) AS component_id FROM s
"""

SQL["op9_substring_dedup"] = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS k FROM (SELECT *, unnest(range(1, greatest(1, len(ws) - 11))) AS i FROM w)),
f AS (SELECT k, min(doc_id) AS least FROM win GROUP BY k),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS pos FROM win JOIN f USING (k) WHERE f.least < doc_id),
words AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS pos FROM w),
kept AS (SELECT words.doc_id, count(gone.pos) AS n_removed, string_agg(word, ' ' ORDER BY words.pos) FILTER (gone.pos IS NULL) AS body FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.pos = words.pos GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

_SHARES = [*[(k, f"top_{k}gram_share", m) for k, m in TOP_SHARE.items()], *[(k, f"dup_{k}gram_share", m) for k, m in DUP_SHARE.items()]]
_TOO_MUCH = " OR ".join(f"{name} > {most}::DOUBLE + {CHANCE * k} / greatest(n_words, 1)::DOUBLE" for k, name, most in _SHARES)
_TOO_MANY_LINES = " OR ".join(f"{name} > {LINE_SHARE[k]}::DOUBLE + {CHANCE} / greatest(lines, 1)::DOUBLE" for k, name in (("lines", "dup_line_share"), ("chars", "dup_line_char_share")))
SQL["op1_quality_rules"] = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (SELECT doc_id, length(word) AS n, i FROM (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS i FROM d)),
size AS (SELECT doc_id, sum(n)::BIGINT AS chars FROM w GROUP BY 1),
g AS (SELECT doc_id, k, i, hash(array_to_string(ws[i:i + k - 1], ' ')) AS gram FROM (SELECT doc_id, ws, k, unnest(range(1, greatest(1, len(ws) - k + 2))) AS i FROM d, range(2, 11) r(k))),
o AS (SELECT doc_id, k, i, gram FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, k, gram) AS m FROM g) WHERE m > 1),
top AS (SELECT doc_id, k, max(s) AS s, 0::BIGINT AS words FROM (SELECT doc_id, k, gram, sum(n) AS s FROM (SELECT DISTINCT doc_id, k, gram, unnest(range(i, i + k)) AS i FROM o WHERE k < 5) JOIN w USING (doc_id, i) GROUP BY 1, 2, 3) GROUP BY 1, 2),
dup AS (SELECT doc_id, k, sum(n) AS s, count(*) AS words FROM (SELECT DISTINCT doc_id, k, unnest(range(i, i + k)) AS i FROM o WHERE k >= 5) JOIN w USING (doc_id, i) GROUP BY 1, 2),
share AS (SELECT doc_id, {", ".join(f"max(CASE WHEN k = {k} THEN s END) AS c{k}" for k, _, _ in _SHARES)}, max(CASE WHEN k = 8 THEN words END) AS again FROM (SELECT * FROM top UNION ALL SELECT * FROM dup) GROUP BY 1),
l AS (SELECT doc_id, line, strlen(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS b, row_number() OVER (PARTITION BY doc_id, line ORDER BY p) > 1 AS later FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, unnest(range(0, len(string_split(t, chr(10))))) AS p FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
ls AS (SELECT doc_id, count(*) AS lines, count_if(later)::BIGINT AS again_lines, sum(b) AS bytes, coalesce(sum(b) FILTER (later), 0) AS again_bytes FROM l GROUP BY 1),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, coalesce(chars, 0) AS word_chars, CAST(length(t) - length(translate(t, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, coalesce(again_lines, 0) AS n_dup_lines, coalesce(again, 0) AS n_repeat_words, coalesce(lines, 0) AS lines,
  coalesce(again_lines / lines::DOUBLE, 0) AS dup_line_share, coalesce(again_bytes / bytes::DOUBLE, 0) AS dup_line_char_share, {", ".join(f"coalesce(c{k} / chars::DOUBLE, 0) AS {name}" for k, name, _ in _SHARES)}
  FROM d LEFT JOIN size USING (doc_id) LEFT JOIN share USING (doc_id) LEFT JOIN ls USING (doc_id)),
f AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT * EXCLUDE (lines), NOT base_failed AND NOT ({_TOO_MUCH} OR {_TOO_MANY_LINES}) AS kept FROM f
"""

CRC = """xor(list_reduce(list_concat([4294967295::UBIGINT], flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: list_concat([ascii(c)::UBIGINT], [256::UBIGINT, 256, 256, 256, 256, 256, 256, 256])))),
  lambda a, x: CASE WHEN x < 256 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384::UBIGINT ELSE 0::UBIGINT END) END), 4294967295::UBIGINT)"""


def _discounts(name: str, source: str, column: str) -> str:
    n = ", ".join(f"count_if({column} = {i})::DOUBLE AS n{i}" for i in (1, 2, 3, 4))
    return f"""{name}0 AS (SELECT {n}, count(*) AS types FROM {source}), {name}1 AS (SELECT *, CASE WHEN n1 + n2 > 0 THEN n1 / (n1 + 2 * n2) ELSE 0.5::DOUBLE END AS y FROM {name}0),
{name} AS (SELECT *, least(0.95::DOUBLE, greatest(0.05::DOUBLE, CASE WHEN n1 > 0 THEN 1 - 2 * y * n2 / n1 ELSE 0.5::DOUBLE END)) AS d1, least(1.9::DOUBLE, greatest(0.05::DOUBLE, CASE WHEN n2 > 0 THEN 2 - 3 * y * n3 / n2 ELSE 1::DOUBLE END)) AS d2, least(2.85::DOUBLE, greatest(0.05::DOUBLE, CASE WHEN n3 > 0 THEN 3 - 4 * y * n4 / n3 ELSE 1.5::DOUBLE END)) AS d3 FROM {name}1)"""


SQL["op8_lm_scoring"] = rf"""
WITH d AS (SELECT doc_id, {CRC} % 7 = 2 AS held_out, list_concat(regexp_extract_all({A_TO_Z}, '[^\x20\x09-\x0D]+'), [chr(10)]) AS ws FROM documents),
t AS (SELECT doc_id, held_out, unnest(ws) AS w, unnest(list_concat([''], ws[:len(ws) - 1])) AS u FROM d),
c AS (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY 1), nv AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c),
p AS (SELECT u, w, count(*) AS k FROM t WHERE NOT held_out GROUP BY 1, 2), q AS (SELECT w, count(*) AS k FROM p GROUP BY 1),
{_discounts("hi", "p", "k")}, {_discounts("lo", "q", "k")},
types AS (SELECT (SELECT count(*) FROM p)::DOUBLE AS pairs), rest AS (SELECT (d1 * n1 + d2 * n2 + d3 * (types - n1 - n2)) / pairs AS r FROM lo, types),
uni AS (SELECT w, greatest(k - CASE WHEN k = 1 THEN d1 WHEN k = 2 THEN d2 ELSE d3 END, 0) / pairs AS p FROM q, lo, types),
st AS (SELECT u, sum(k)::DOUBLE AS total, (count_if(k = 1) * any_value(d1) + count_if(k = 2) * any_value(d2) + count_if(k > 2) * any_value(d3)) AS back FROM p, hi GROUP BY 1),
e AS (SELECT t.doc_id, t.held_out, c.c AS c, coalesce(greatest(p.k - CASE WHEN p.k = 1 THEN d1 WHEN p.k = 2 THEN d2 ELSE d3 END, 0) / st.total, 0) + coalesce(st.back / st.total, 1) * (r / (v + 1) + coalesce(uni.p, 0)) AS prob, n, v
  FROM t LEFT JOIN c ON c.w = t.w LEFT JOIN uni ON uni.w = t.w LEFT JOIN st ON st.u = t.u LEFT JOIN p ON p.u = t.u AND p.w = t.w, hi, rest, nv)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + 1 * (v + 1))::DOUBLE)), 6) AS base_score, round(sum(log10(prob)), 4) AS score, round(pow(10::DOUBLE, -round(sum(log10(prob)), 4) / count(*)), 4) AS perplexity FROM e GROUP BY 1
"""
