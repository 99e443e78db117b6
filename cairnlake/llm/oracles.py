"""DuckDB SQL that gives the rows of the queries of this package, written apart from them."""

PII = r"""
WITH kinds(rank, kind, pattern) AS (VALUES
  (0, 'email', '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+'),
  (1, 'ip', '[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)'),
  (2, 'card', '[0-9]([\x20-]?[0-9])+'),
  (3, 'phone', '\+[0-9][\x20().0-9-]+[0-9]')),
docs AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
proposed(rank, kind, pattern) AS (FROM kinds UNION ALL VALUES
  (4, 'iban', '\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b'),
  (5, 'ssn', '[0-9-]+'),
  (6, 'credential', 'AKIA[0-9A-Z]{16}|[0-9a-f]{16,128}')),
found AS (
  SELECT rid, text, rank, kind, m, g, i FROM (
    SELECT rid, text, rank, kind, regexp_extract_all(text, pattern) AS ms, string_split_regex(text, pattern) AS gs
    FROM docs, proposed WHERE regexp_matches(text, pattern)),
  LATERAL (SELECT unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, unnest(range(len(ms))) AS i)),
placed AS (
  SELECT *, CAST(sum(length(g) + length(m)) OVER (PARTITION BY rid, rank ORDER BY i) AS BIGINT) - length(m) AS s FROM found),
countries AS (SELECT x[1:2] AS country, CAST(x[3:4] AS BIGINT) AS n FROM (SELECT unnest(string_split('{ibans}', ' ')) AS x)),
shortened AS (
  SELECT rid, text, rank, kind, s, n, CASE WHEN kind = 'iban' AND contains(m, ' ') AND m[n + (n - 1) // 4 + 1:n + (n - 1) // 4 + 1] = ' ' THEN m[1:n + (n - 1) // 4] ELSE m END AS m
  FROM placed LEFT JOIN countries ON kind = 'iban' AND country = m[1:2]),
checked AS (
  SELECT *, s + length(m) AS e FROM shortened, LATERAL (SELECT regexp_replace(m, '[^0-9]', '', 'g') AS d, replace(m, ' ', '') AS p)
  WHERE kind = 'email'
     OR kind = 'ip' AND list_max([CAST(p AS HUGEINT) FOR p IN string_split(m, '.')]) <= 255
     OR kind = 'phone' AND length(d) BETWEEN 9 AND 15
     OR kind = 'card' AND length(d) BETWEEN 12 AND 19 AND list_sum([
          CASE WHEN (length(d) - k) % 2 = 0 THEN CAST(d[k] AS INT)
               WHEN CAST(d[k] AS INT) > 4 THEN 2 * CAST(d[k] AS INT) - 9 ELSE 2 * CAST(d[k] AS INT) END FOR k IN range(1, length(d) + 1)]) % 10 = 0
     OR kind = 'iban' AND length(p) BETWEEN 15 AND 34 AND coalesce(n, length(p)) = length(p)
        AND list_reduce(list_prepend(0, [CAST(ord(c) - CASE WHEN c < 'A' THEN 48 ELSE 55 END AS BIGINT) FOR c IN string_split(p[5:] || p[1:4], '')]),
          lambda a, v: (a * CASE WHEN v < 10 THEN 10 ELSE 100 END + v) % 97) = 1
     OR kind = 'ssn' AND regexp_full_match(m, '[0-9]{3}-[0-9]{2}-[0-9]{4}') AND NOT regexp_matches(m, '^(000|666|9)|-00-|0000$')
     OR kind = 'credential' AND (s = 0 OR NOT regexp_matches(text[s:s], '[A-Za-z0-9]')) AND (s + length(m) = length(text) OR NOT regexp_matches(text[s + length(m) + 1:s + length(m) + 1], '[A-Za-z0-9]'))),
scored AS (
  SELECT rid, rank, kind, s, e, least(100, CASE kind WHEN 'email' THEN 90 WHEN 'ip' THEN 60 WHEN 'card' THEN 70 WHEN 'phone' THEN 60 WHEN 'iban' THEN 80 WHEN 'ssn' THEN 30
      ELSE CASE WHEN m LIKE 'AKIA%' THEN 90 ELSE 20 END END
    + CASE WHEN kind = 'credential' AND regexp_matches(b, '(password|passwd|token|secret|api[_ -]?key)[^A-Za-z0-9_]{0,4}$') OR regexp_matches(b, c) OR regexp_matches(a, c) THEN 50 ELSE 0 END)
    - CASE WHEN regexp_matches(b, 'example|sample|dummy|placeholder') OR regexp_matches(a, 'example|sample|dummy|placeholder') THEN 30 ELSE 0 END AS score
  FROM checked, LATERAL (SELECT lower(text[greatest(s - 39, 1):s]) AS b, lower(text[e + 1:e + 40]) AS a, CASE kind WHEN 'email' THEN 'mail|contact'
    WHEN 'ip' THEN '(^|[^a-z0-9])ip([^a-z0-9]|$)|address|host|server' WHEN 'card' THEN 'card|visa|credit|payment|karte|carte|tarjeta' WHEN 'phone' THEN 'phone|tel|mobile|call|fax'
    WHEN 'iban' THEN 'iban|account|bank|konto' WHEN 'ssn' THEN '(^|[^a-z0-9])ssn([^a-z0-9]|$)|social security' ELSE 'a^' END AS c)),
summed AS (
  SELECT rid, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card,
    count(*) FILTER (kind = 'phone') AS n_phone, count(*) FILTER (kind = 'iban') AS n_iban, count(*) FILTER (kind = 'ssn') AS n_ssn, count(*) FILTER (kind = 'credential') AS n_credential,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) FILTER (rank < 4) AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, rank) AS spans, count(*) AS n_spans, string_agg(CAST(score AS VARCHAR), ',' ORDER BY s, rank) AS scores
  FROM scored WHERE rank < 4 OR score >= 60 GROUP BY rid)
SELECT doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_iban, 0) AS n_iban, coalesce(n_ssn, 0) AS n_ssn, coalesce(n_credential, 0) AS n_credential, coalesce(n_spans, 0) AS n_spans, coalesce(scores, '') AS scores
FROM docs LEFT JOIN summed USING (rid)
"""

CHAT = r"""
WITH m AS (
  SELECT conv_id, false AS extra, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, true, 0, 'user', '</s>[INST] ok [/INST]'), (-1, true, 1, 'assistant', '</s>[INST] ok [/INST]')),
e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS er,
    regexp_replace(text, '([<\[])(\\*)(\||/?s>|/?INST\])', '\1\\\2\3', 'g') AS et FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<|turn|>' || er || '<|text|>' || et || '<|end|>')) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id, extra
"""

QUALITY = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents),
win AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM d)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, CAST(sum(least(5, coalesce(nx - i, 5))) AS BIGINT) AS c FROM (SELECT rid, i, lead(i) OVER (PARTITION BY rid ORDER BY i) AS nx FROM rep) GROUP BY rid),
q AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
    coalesce(c, 0) AS n_repeat_words, greatest(len(l), 1) AS nl,
    len(list_filter(w, lambda x: regexp_full_match(x, '\p{Lu}[\p{Lu}\p{P}]+'))) AS shout,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \t\x0B\f\r]*(?:[-*•]|\d+[.)])[ \t\x0B\f\r]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(?:\.\.\.|…)[ \t\x0B\f\r]*$'))) AS dots,
    len(list_filter(w, lambda x: list_contains(string_split('{stop}', ' '), trim(lower(x), '{marks}')))) AS stops
  FROM d LEFT JOIN cov USING (rid)),
v AS (
  SELECT *, greatest(n_words, 1) AS n, [
    CASE WHEN n_words < 10 OR n_words > 1000000 THEN 'n_words' END,
    CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 'repeat_word_percent' END,
    CASE WHEN word_chars / n NOT BETWEEN 2 AND 15 THEN 'mean_word_length' END,
    CASE WHEN n_symbols / n > 0.1 THEN 'symbol_word_ratio' END,
    CASE WHEN shout / n > 0.3 THEN 'shout_word_ratio' END,
    CASE WHEN n_dup_lines / nl > 0.5 THEN 'dup_line_ratio' END,
    CASE WHEN bullets / nl > 0.9 THEN 'bullet_line_ratio' END,
    CASE WHEN dots / nl > 0.3 THEN 'ellipsis_line_ratio' END,
    CASE WHEN n_words >= 50 AND stops / n < 0.05 THEN 'stop_word_ratio' END] AS f FROM q)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  len(list_filter(f, lambda x: x IS NOT NULL)) = 0 AS kept,
  coalesce(array_to_string(list_filter(f, lambda x: x IS NOT NULL), ','), '') AS failed
FROM v
"""

LINE_DEDUP = r"""
WITH d AS (SELECT row_number() OVER (ORDER BY doc_id NULLS FIRST) AS k, doc_id, text FROM documents),
l AS (SELECT k, i, x FROM (SELECT k, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d)),
s AS (SELECT k, i, x, row_number() OVER w AS n, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]') WINDOW w AS (PARTITION BY k ORDER BY i)),
c AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY n) AS c FROM s),
spans AS (
  SELECT a.k, a.n AS s, b.n AS e FROM c a JOIN c b ON a.k = b.k AND b.c - b.w < a.c - a.w + {words} AND a.c - a.w + {words} <= b.c
  UNION
  SELECT b.k, a.n, b.n FROM c a JOIN c b ON a.k = b.k AND b.c - a.c < {words} AND b.c - a.c + a.w >= {words}),
said AS (SELECT spans.k, spans.s, e, string_agg(x, chr(10) ORDER BY n) AS t FROM spans JOIN s ON s.k = spans.k AND n BETWEEN spans.s AND e GROUP BY ALL),
late AS (SELECT k, s, e FROM said QUALIFY row_number() OVER (PARTITION BY t ORDER BY k, s) > 1),
gone AS (SELECT DISTINCT s.k, s.i FROM late JOIN s ON s.k = late.k AND n BETWEEN late.s AND e),
kept AS (SELECT k, string_agg(x, chr(10) ORDER BY i) AS t FROM l ANTI JOIN gone USING (k, i) GROUP BY 1)
SELECT doc_id, (SELECT count(*) FROM s WHERE s.k = d.k) AS n_lines, (SELECT count(*) FROM gone WHERE gone.k = d.k) AS n_deleted,
  CASE WHEN text IS NOT NULL THEN coalesce(t, '') END AS text
FROM d LEFT JOIN kept USING (k)
"""

NGRAM_JOIN = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
both_ AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM both_ JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT doc_id, least(doc_id, coalesce((SELECT min(b) FROM reach WHERE a = doc_id), doc_id)) AS class_id, (SELECT count(*) FROM links WHERE a = doc_id) AS n_links FROM d
"""


def _crc_table() -> list[int]:
    """The reflected CRC-32 of each octet, by the polynomial 0xEDB88320."""
    table = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        table.append(b)
    return table


SHARDING = f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
o AS (SELECT doc_id, list_transform(range(0, length(hx) // 2), lambda i: CAST('0x' || substr(hx, 2 * i + 1, 2) AS BIGINT)) AS octets FROM t),
s AS (SELECT doc_id, len(octets) + 1 AS size, CAST(xor(list_reduce(octets, lambda c, b: xor(CAST({_crc_table()} AS BIGINT[])[(xor(c, b) & 255) + 1], c >> 8), CAST(4294967295 AS BIGINT)), 4294967295) AS BIGINT) AS text_crc32 FROM o),
r AS (SELECT *, sum(size) OVER w - size / 2 AS middle, sum(size) OVER () AS total, row_number() OVER w AS r FROM s WINDOW w AS (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING)),
p AS (SELECT *, CAST(least(floor(middle * 8 / total), 7) AS INT) AS shard FROM r)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(r - min(r) OVER (PARTITION BY shard) AS BIGINT) AS slot, CAST(NULL AS INT) AS grown_shard FROM p
"""
