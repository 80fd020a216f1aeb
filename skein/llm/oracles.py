"""DuckDB SQL for the operators whose whole result SQL can state."""

from __future__ import annotations

#: Words are what spaces and tabs to carriage returns leave.
_WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base 32 of a SHA-1: each 5 of its 40 hexadecimal digits are 4 letters.
WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS s, min(page_id) OVER (PARTITION BY h) AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * (i // 4)::INTEGER, 5))::INTEGER >> (15 - 5 * (i % 4))::INTEGER) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to, TRUE AS ok
FROM d
"""

NEARDUP = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(text=_LOWER)} AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT u, v FROM c JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT u, v FROM l UNION SELECT v, u FROM l),
r AS (SELECT u, v FROM e UNION SELECT r.u, e.v FROM r JOIN e ON r.v = e.u),
m AS (SELECT u, least(u, min(v)) AS m FROM r GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, coalesce(m.m, d.doc_id) AS component_id, coalesce(m.m, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN m ON m.u = d.doc_id
"""

#: Counts of a document and of its language stand side by side, by kind of histogram and bin.
QUALITY = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, {_WORDS.format(text="text")} AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
b AS (SELECT rid, doc_id, lang, length(text) AS n_chars, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  length(regexp_replace(text, '[^\p{{Lu}}]+', '', 'g')) AS upper, length(regexp_replace(text, '[^\p{{Ll}}]+', '', 'g')) AS lower,
  length(regexp_replace(text, '[^\p{{Nd}}]+', '', 'g')) AS digit, length(regexp_replace(text, '[^.,;:!?''"()\[\]-]+', '', 'g')) AS punct FROM w),
u AS (SELECT rid, lang, unnest(words) AS word, generate_subscripts(words, 1) AS pos FROM w),
v AS (SELECT rid, pos, word AS x, lead(word) OVER o AS y, lead(word, 2) OVER o AS z FROM u WINDOW o AS (PARTITION BY rid ORDER BY pos)),
r AS (SELECT rid, pos, count(*) OVER (PARTITION BY rid, x, y, z) AS n FROM v WHERE z IS NOT NULL),
c AS (SELECT rid, count(DISTINCT pos + k) AS n_repeat_words FROM r, (VALUES (0), (1), (2)) AS k(k) WHERE n > 1 GROUP BY rid),
top AS (SELECT lang, word, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS r FROM (SELECT lang, word, count(*) AS n FROM u GROUP BY lang, word) QUALIFY r <= 24),
h AS (SELECT rid, r, count(*) AS n FROM u JOIN top USING (lang, word) GROUP BY rid, r),
bins AS (SELECT rid, lang, 'c' AS kind, i AS bin, [upper, lower, digit, punct, n_symbols, n_chars - word_chars, word_chars - upper - lower - digit - punct - n_symbols][i] AS n FROM b, range(1, 8) AS k(i)
  UNION ALL SELECT b.rid, b.lang, 'w', i, coalesce(h.n, 0) FROM b CROSS JOIN range(1, 25) AS k(i) LEFT JOIN h ON h.rid = b.rid AND h.r = i
  UNION ALL SELECT rid, lang, 'w', 25, n_words - coalesce((SELECT sum(n) FROM h WHERE h.rid = b.rid), 0) FROM b),
ref AS (SELECT lang, kind, bin, sum(n) AS n FROM bins GROUP BY ALL),
q AS (SELECT *, n / nullif(sum(n) OVER (PARTITION BY lang, kind), 0) AS q FROM ref),
p AS (SELECT rid, lang, kind, bin, n / nullif(sum(n) OVER (PARTITION BY rid, kind), 0) AS p FROM bins
  UNION ALL SELECT NULL, lang, 'w', bin, (bin = 25)::INT::DOUBLE FROM ref WHERE kind = 'w'),
js AS (SELECT rid, lang, kind, sqrt(greatest(sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END) / 2, 0)) + 0 * sum(p) + 0 * sum(q) AS d FROM p JOIN q USING (lang, kind, bin) GROUP BY ALL),
a AS (SELECT b.*, coalesce(c.n_repeat_words, 0) AS n_repeat_words, x.d AS char_distance, y.d AS word_distance, 0.9 * z.d AS most FROM b LEFT JOIN c USING (rid)
  LEFT JOIN js x ON x.rid = b.rid AND x.kind = 'c' LEFT JOIN js y ON y.rid = b.rid AND y.kind = 'w' LEFT JOIN js z ON z.rid IS NULL AND z.lang = b.lang),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM a)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words, base_failed,
  round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance,
  NOT base_failed AND NOT coalesce((n_chars >= 200 AND char_distance > 0.25) OR word_distance > 0.5 OR (n_words >= 100 AND word_distance > most), FALSE) AS kept
FROM f
"""

ORACLES = {"op2_quality_rules": QUALITY, "op8_warc": WARC, "op9_minhash_neardup": NEARDUP}
