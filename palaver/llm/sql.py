"""DuckDB statements for the queries that SQL can express.

Cutting pages by wrappers, secret positions with false-discovery control, seeded draws,
packing and fitted language models have none; tests/llm checks those by brute force.
"""
from __future__ import annotations

SPACE = r"[\x20\x09-\x0D]+"
WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACE}'), lambda x: x <> '')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def quality(common_words: list[str], max_class: float = 0.3, max_common: float = 0.14, noise: float = 1.1,
            min_chars: int = 200, min_words: int = 50) -> str:
    listed = ", ".join("'" + w + "'" for w in common_words)
    return rf"""
WITH w AS (SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
p AS (SELECT *, array_to_string(ws, ' ') AS plain FROM w),
c AS (SELECT rid, doc_id, lang, ws, len(ws) AS n_words, length(regexp_replace(t, '{SPACE}', '', 'g')) AS word_chars, length(t) AS n_text,
  length(regexp_replace(plain, '[^A-Z]+', '', 'g')) AS upper, length(regexp_replace(plain, '[^0-9]+', '', 'g')) AS digit,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS symbol, length(regexp_replace(plain, '[^.,;:!?''"()-]+', '', 'g')) AS point,
  strlen(plain) - length(plain) AS wide,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM p),
grams AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM c)),
twice AS (SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
covered AS (SELECT rid, count(DISTINCT q) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS q FROM twice) GROUP BY rid),
hits AS (SELECT rid, word, count(*) AS n FROM (SELECT rid, unnest(ws) AS word FROM c) WHERE word IN ({listed}) GROUP BY rid, word),
bins AS (
  SELECT rid, 'w' AS kind, word AS bin, n FROM hits
  UNION ALL SELECT c.rid, 'w', ' other', n_words - coalesce(h.n, 0) FROM c LEFT JOIN (SELECT rid, sum(n) AS n FROM hits GROUP BY rid) h USING (rid)
  UNION ALL SELECT rid, 'c', u.k, u.n FROM (SELECT rid, unnest([
    {{'k': 'upper', 'n': upper}}, {{'k': 'digit', 'n': digit}}, {{'k': 'symbol', 'n': symbol}}, {{'k': 'point', 'n': point}}, {{'k': 'wide', 'n': wide}},
    {{'k': 'blank', 'n': n_text - word_chars}}, {{'k': 'rest', 'n': greatest(word_chars - upper - digit - symbol - point - wide, 0)}}]) AS u FROM c)),
ref AS (SELECT lang, kind, bin, sum(n) / sum(sum(n)) OVER (PARTITION BY lang, kind) AS q FROM bins JOIN c USING (rid) GROUP BY lang, kind, bin),
own AS (SELECT rid, kind, bin, n / sum(n) OVER (PARTITION BY rid, kind) AS p FROM bins QUALIFY sum(n) OVER (PARTITION BY rid, kind) > 0),
dist AS (SELECT rid, own.kind, sqrt(greatest(0.5 * sum(CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0 END ELSE 0 END)
   + 0.5 * (1 - sum(CASE WHEN p > 0 THEN q ELSE 0 END)), 0)) AS d
  FROM own JOIN c USING (rid) JOIN ref ON ref.lang IS NOT DISTINCT FROM c.lang AND ref.kind = own.kind AND ref.bin = own.bin GROUP BY rid, own.kind),
judged AS (SELECT c.*, coalesce(covered.n, 0) AS n_repeat_words, coalesce(k.d, 0) AS class_d, coalesce(o.d, 0) AS common_d
  FROM c LEFT JOIN covered USING (rid) LEFT JOIN (FROM dist WHERE kind = 'c') k USING (rid) LEFT JOIN (FROM dist WHERE kind = 'w') o USING (rid))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, symbol::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words::BIGINT AS n_repeat_words,
  (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT ((word_chars >= {min_chars} AND class_d > {max_class})
    OR (n_words >= {min_words} AND common_d > {max_common} + {noise} / sqrt(n_words))) AS kept
FROM judged"""


NEAR_DUPLICATES = f"""
WITH RECURSIVE w AS (SELECT doc_id, list_transform({WORDS}, lambda x: {LOWER.format('x')}) AS ws FROM documents),
grams AS (SELECT DISTINCT doc_id, g FROM (
  SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w)),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS MATERIALIZED (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * shared.n >= 85 * (x.n + y.n - shared.n)),
reach AS (SELECT doc_id, doc_id AS low FROM w UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.doc_id WHERE reach.low < links.b),
lowest AS (SELECT doc_id, min(low) AS component_id FROM reach GROUP BY doc_id)
SELECT w.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, component_id, w.doc_id = component_id AS kept
FROM w LEFT JOIN sizes USING (doc_id) JOIN lowest USING (doc_id)"""

ARCHIVE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT page_id, strlen(t) AS payload_bytes, sha1(t) AS hex, max(page_id) OVER (PARTITION BY t) AS first FROM p)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to
FROM h"""

TOP_K = """
WITH v AS (SELECT vec_id AS id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
SELECT q.id AS query_id, row_number() OVER (PARTITION BY q.id ORDER BY list_inner_product(q.v, c.v) DESC, c.id)::INTEGER AS rank,
  c.id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
FROM v q JOIN v c ON c.id <> q.id WHERE q.id % 50 = 0 QUALIFY rank <= 5"""


def urls(rules: list[tuple[str, str, str]], damping: float = 0.85, threshold: float = 0.5, rounds: int = 90) -> str:
    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    host = LOWER.format("regexp_extract(rest, '^[^/?#]*')")
    target = LOWER.format("x")
    return rf"""
WITH RECURSIVE rules AS (SELECT * FROM (VALUES {listed}) r(verdict, rhost, rpath)),
a AS (SELECT row_number() OVER () AS rid, page_id, html, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
s AS (SELECT rid, page_id, html, {host} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM a),
fit AS (SELECT rid, verdict, rhost || rpath AS rule FROM s JOIN rules ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY length(rhost || rpath) DESC, length(rhost) DESC) = 1),
f AS (SELECT s.*, verdict, rule FROM s LEFT JOIN fit USING (rid)),
links AS MATERIALIZED (SELECT src, dst, count(*)::DOUBLE AS n FROM (
  SELECT DISTINCT rid, host AS src, {target} AS dst FROM (SELECT rid, host, unnest(regexp_extract_all(html,
    '(?i)<a\s[^>]*?href\s*=\s*["'']?\s*(?:https?:)?//([^/?#"''\s>\\]+)', 1)) AS x FROM s)) WHERE src <> dst AND src <> '' GROUP BY src, dst),
seeds AS (SELECT host, count(*) FILTER (verdict = 'allow') / count(*) AS allow, count(*) FILTER (verdict = 'block') / count(*) AS block FROM f WHERE host <> '' GROUP BY host),
hosts AS MATERIALIZED (SELECT coalesce(seeds.host, l.dst) AS host, coalesce(allow, 0) AS allow, coalesce(block, 0) AS block
  FROM seeds FULL JOIN (SELECT DISTINCT dst FROM links) l ON l.dst = seeds.host),
steps AS MATERIALIZED (SELECT 't' AS kind, src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM links
  UNION ALL SELECT 'd', dst, src, n / sum(n) OVER (PARTITION BY dst) FROM links),
base AS MATERIALIZED (SELECT 't' AS kind, host, allow * (1 - {damping}) AS m FROM hosts UNION ALL SELECT 'd', host, block * (1 - {damping}) FROM hosts),
walk AS (SELECT 0 AS round, kind, host, m FROM base
  UNION ALL SELECT round + 1, walk.kind, dst, {damping} * sum(m * share) FROM walk JOIN steps ON steps.kind = walk.kind AND steps.src = walk.host
  WHERE round < {rounds} AND m > 0 GROUP BY round, walk.kind, dst),
mass AS (SELECT host, sum(m) FILTER (kind = 't') AS trust, sum(m) FILTER (kind = 'd') AS distrust FROM walk GROUP BY host)
SELECT page_id, f.host, path, rule,
  coalesce(verdict, CASE WHEN coalesce(distrust, 0) - coalesce(trust, 0) >= {threshold} * (1 - {damping}) THEN 'block' END, 'allow') AS verdict
FROM f LEFT JOIN mass ON mass.host = f.host"""


def _crc32(text: str) -> str:
    """Checksum of a text of code points below U+0100, bit by bit over its UTF-8 bytes."""
    data = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [194 + ord(c) // 192, 128 + ord(c) % 64] END))"
    step = "list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), xor(h, b::BIGINT))"
    return f"xor(list_reduce({data}, lambda h, b: {step}, 4294967295::BIGINT), 4294967295)"


SPELLING = f"""
WITH RECURSIVE runs AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, unnest(regexp_extract_all({LOWER.format('text')}, '[A-Za-zÀ-ÿ]+')) AS w FROM documents),
held AS (SELECT w, n, {_crc32("d || ':' || w")} AS h FROM (SELECT d, w, count(*) AS n FROM runs GROUP BY d, w)),
cut AS (SELECT CASE WHEN h % 97 = 0 THEN w[:h % length(w)] || w[h % length(w) + 2:] ELSE w END AS word, n FROM held),
v AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
less AS MATERIALIZED (SELECT word, i, word[:i - 1] || word[i + 1:] AS rest FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v)),
near AS MATERIALIZED (
  SELECT a.word, b.word AS other FROM less a JOIN less b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT less.word, v.word FROM less JOIN v ON v.word = rest
  UNION SELECT v.word, less.word FROM less JOIN v ON v.word = rest),
best AS (SELECT near.word, count(*) AS n_near, min({{'m': -v.n, 'w': v.word}}) AS b FROM near JOIN v ON v.word = near.other GROUP BY near.word),
formed AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -b.m >= 2 * v.n THEN b.w END AS form, CASE WHEN -b.m >= 2 * v.n THEN -b.m END AS form_n
  FROM v LEFT JOIN best USING (word)),
walk AS (SELECT word, word AS root, form AS ahead FROM formed UNION ALL SELECT walk.word, walk.ahead, f.form FROM walk JOIN formed f ON f.word = walk.ahead)
SELECT formed.word, form, root, n, n_near, form_n::BIGINT AS form_n FROM formed JOIN walk ON walk.word = formed.word AND walk.ahead IS NULL"""


REPAIR = rf"""
WITH RECURSIVE given AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {_crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS code FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS again FROM given WHERE code <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k FROM damaged),
marked AS MATERIALIZED (SELECT *, left(role, 1) AS i, left(role, 1) || lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS pair,
    CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 THEN 2
      WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') THEN 3 ELSE 0 END AS fault FROM placed),
step(p, i, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
more(p, q, c, a, t) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']),
    (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']), (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
edits AS (
  SELECT conv_id, k, p, p AS q, 4 AS c, 'D' AS a, []::VARCHAR[] AS t FROM marked, (SELECT unnest(range(4)) AS p)
  UNION ALL SELECT conv_id, k, p, q, CASE WHEN fault = 3 THEN 3 ELSE 0 END, 'K', [role || ':' || text] FROM marked JOIN step USING (i) WHERE fault IN (0, 3)
  UNION ALL SELECT conv_id, k, p, q, CASE WHEN fault = 3 THEN 6 ELSE 3 END, 'R', [CASE step.i WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text]
  FROM marked JOIN step ON step.i <> 's' WHERE fault IN (0, 3)),
moves AS MATERIALIZED (SELECT conv_id, k, e.p, m.q, e.c + m.c AS c, e.a || m.a AS a, e.t || m.t AS t FROM edits e JOIN more m ON e.q = m.p),
parse AS (
  SELECT conv_id, 0::BIGINT AS k, q, {{'c': c, 'a': a, 't': t}} AS b FROM (SELECT DISTINCT conv_id FROM conversations), more WHERE p = 0
  UNION ALL
  SELECT m.conv_id, m.k, m.q, min({{'c': b.c + m.c, 'a': b.a || m.a, 't': b.t || m.t}}) FROM parse JOIN moves m
    ON m.conv_id IS NOT DISTINCT FROM parse.conv_id AND m.k = parse.k + 1 AND m.p = parse.q GROUP BY m.conv_id, m.k, m.q),
least AS (SELECT conv_id, min(b) AS b FROM parse WHERE q IN (0, 3) GROUP BY conv_id, k QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY k DESC) = 1),
counted AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate,
    count(*) FILTER (fault = 3) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY conv_id)
SELECT least.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated,
  coalesce(illegal, 0)::BIGINT AS illegal, b.c::BIGINT AS cost, b.a AS audit, sha256(array_to_string(b.t, chr(10))) AS repaired_sha256
FROM least LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM least.conv_id"""


NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
sound AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, x FROM v WHERE x IS NOT NULL AND len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) = 0 AND list_inner_product(x, x) > 0),
links AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM sound a JOIN sound b ON a.rid <> b.rid AND len(a.x) = len(b.x)
  WHERE list_inner_product(a.x, b.x) / (sqrt(list_inner_product(a.x, a.x)) * sqrt(list_inner_product(b.x, b.x))) >= 0.95),
reach AS (SELECT rid, vec_id AS low FROM sound UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.rid),
found AS (SELECT sound.rid, vec_id, min(low) AS component_id FROM reach JOIN sound USING (rid) GROUP BY sound.rid, vec_id)
SELECT vec_id, (SELECT count(*) FROM links WHERE links.a = found.rid)::BIGINT AS n_links, component_id, vec_id = component_id AS kept FROM found
UNION ALL SELECT vec_id, 0, vec_id, true FROM v WHERE x IS NULL OR len(list_filter(x, lambda y: y IS NULL OR NOT isfinite(y))) > 0 OR coalesce(list_inner_product(x, x), 0) = 0"""
