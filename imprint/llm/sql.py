"""DuckDB SQL for the queries that SQL can express on the same tables."""

OP1 = r"""
WITH p AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS m, sha1(coalesce(html, '')) AS d,
         strlen(coalesce(html, '')) AS n,
         make_timestamp((1700000000 + page_id * 7919 % 2592000) * 1000000) AS day
  FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(trim(url), '#.*$', ''), '^(?i)https?://', '') AS bare FROM p),
k AS (
  SELECT *,
    regexp_replace(regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^www\.', ''), ':(80|443)$', '')
    || regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') AS stem,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' AND NOT regexp_matches(lower(x), '^(utm_[a-z]*|gclid|fbclid|sessionid|phpsessid)(=|$)'))), '&') AS q
  FROM c),
u AS (SELECT *, stem || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS key FROM k),
resp AS (
  SELECT key, day AS captured, max(page_id) AS page_id FROM u GROUP BY key, day),
rev AS (
  SELECT 2 * page_id + 1 AS record_id, page_id, key, m,
    CASE WHEN page_id % 11 = 0 THEN day - INTERVAL 1 HOUR ELSE day + INTERVAL 5 HOUR END AS captured,
    CASE WHEN page_id % 13 = 0 THEN 200 ELSE 304 END AS status,
    CASE WHEN page_id % 9 = 0 THEN '"changed"'
         WHEN page_id % 7 <> 0 AND page_id % 5 <> 0 THEN 'W/"' || substr(m, 1, 12) || '"' END AS etag,
    CASE WHEN page_id % 7 = 0 THEN '1999-01-01 00:00:00'
         WHEN page_id % 5 <> 0 THEN strftime(day, '%Y-%m-%d %H:%M:%S') END AS modified
  FROM u),
j AS (
  SELECT rev.*, r.page_id AS rpage FROM rev ASOF LEFT JOIN resp r
  ON rev.key = r.key AND rev.captured > r.captured),
v AS (
  SELECT j.*, s.d, s.n, '"' || substr(s.m, 1, 12) || '"' AS stag,
         strftime(s.day, '%Y-%m-%d %H:%M:%S') AS sday
  FROM j LEFT JOIN u s ON s.page_id = j.rpage),
o AS (
  SELECT *, coalesce(regexp_replace(etag, '^W/', '') = stag, modified = sday) AS same FROM v),
w AS (
  SELECT *, CASE WHEN rpage IS NULL THEN 'no_response' WHEN status <> 304 THEN 'not_304'
    WHEN same IS NULL THEN 'unverified' WHEN same THEN 'resolved' ELSE 'mismatch' END AS outcome FROM o)
SELECT record_id, key AS url_key, strftime(captured, '%Y-%m-%d %H:%M:%S') AS captured, outcome,
  2 * rpage AS response_id,
  CASE WHEN outcome = 'resolved' THEN
    'cache-control: max-age=60' || chr(10) || 'content-length: ' || n || chr(10) || 'content-type: text/html' || chr(10)
    || 'date: ' || strftime(captured, '%Y-%m-%d %H:%M:%S') || chr(10) || 'etag: ' || coalesce(etag, stag) || chr(10)
    || 'last-modified: ' || coalesce(modified, sday) END AS headers,
  CASE WHEN outcome = 'resolved' THEN d END AS digest,
  CASE WHEN outcome = 'resolved' THEN n END AS payload_length
FROM w
"""

OP8 = """
WITH g AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
q AS (SELECT *, row_number() OVER () AS number FROM g WHERE vec_id % 50 = 0),
s AS (
  SELECT q.number, q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM q JOIN g c ON q.vec_id <> c.vec_id),
r AS (
  SELECT *, row_number() OVER (PARTITION BY number ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def _op7() -> str:
    """Counts and verdict of operator 7, every n-gram spelled out."""
    blank = r"\x20\x09-\x0D"
    parts = [rf"""d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^{blank}]+') AS ws
  FROM documents)""", """
word AS (SELECT r, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM d)""", """
chars AS (SELECT r, count(*) AS n_words, sum(length(word)) AS word_chars FROM word GROUP BY r)""", rf"""
line AS (
  SELECT r, line, row_number() OVER (PARTITION BY r, line ORDER BY pos) AS copy
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS pos FROM d)
  WHERE regexp_matches(line, '[^{blank}]'))""", """
lines AS (
  SELECT r, count(*) AS n_lines, count(*) FILTER (copy > 1) AS n_dup_lines, sum(length(line)) AS chars,
         sum(length(line)) FILTER (copy > 1) AS dup_chars
  FROM line GROUP BY r)"""]  # fmt: skip
    leads = ", ".join(f"lead(word, {i}) OVER x AS w{i}" for i in range(10))
    parts.append(f"""
next AS (SELECT r, pos, {leads} FROM word WINDOW x AS (PARTITION BY r ORDER BY pos))""")
    shares = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
    for n in shares:
        words = ", ".join(f"w{i}" for i in range(n))
        parts.append(f"""
gram{n} AS (
  SELECT r, pos, row_number() OVER (PARTITION BY r, concat_ws(' ', {words}) ORDER BY pos) AS copy,
         count(*) OVER (PARTITION BY r, concat_ws(' ', {words})) AS c
  FROM next WHERE w{n - 1} IS NOT NULL),
dup{n} AS (
  SELECT r, count(*) AS words, sum(length(word)) FILTER (later) AS chars
  FROM (SELECT r, pos, bool_or(copy > 1) AS later
        FROM (SELECT r, copy, pos + unnest(range({n})) AS pos FROM gram{n} WHERE c > 1) GROUP BY r, pos)
  JOIN word USING (r, pos) GROUP BY r)""")
    joins = " ".join(f"LEFT JOIN dup{n} USING (r)" for n in shares)
    dups = ", ".join(f"CAST(coalesce(dup{n}.chars, 0) AS BIGINT) AS dup_chars_{n}" for n in shares)
    fine = " AND ".join(f"dup_chars_{n} <= {s}::DOUBLE * word_chars" for n, s in shares.items())
    return "WITH " + ",".join(parts) + f""",
m AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(dup5.words, 0) AS BIGINT) AS n_repeat_words,
    CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines,
    CAST(CASE WHEN n_dup_lines > 0 THEN lines.chars ELSE 0 END AS BIGINT) AS line_chars,
    CAST(coalesce(lines.dup_chars, 0) AS BIGINT) AS dup_line_chars, {dups}
  FROM d LEFT JOIN chars USING (r) LEFT JOIN lines USING (r) {joins}),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND n_symbols <= 0.1::DOUBLE * n_words AND n_dup_lines <= 0.3::DOUBLE * n_lines
  AND dup_line_chars <= 0.2::DOUBLE * greatest(line_chars, 1) AND {fine} AS kept
FROM b"""


OP7 = _op7()


OP12 = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
first AS (SELECT t, min(doc_id) AS least FROM d GROUP BY t),
said AS (
  SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS bad
  FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, false) AS good, coalesce(bad, false) AS bad,
    list_filter([
      CASE WHEN len(ws) < 200 THEN 'A' END,
      CASE WHEN 100 * len(list_distinct(ws)) < 50 * len(ws) THEN 'B' END,
      CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t) THEN 'C' END,
      CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' END,
      CASE WHEN d.doc_id > least THEN 'E' END], lambda x: x IS NOT NULL) AS fails
  FROM d JOIN first USING (t) LEFT JOIN said ON said.doc_id = d.doc_id),
c AS (SELECT part, fails, good, bad, count(*) AS n FROM m GROUP BY ALL),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order
  FROM f a, f b, f c, f d, f e
  WHERE a.f NOT IN (b.f, c.f, d.f, e.f) AND b.f NOT IN (c.f, d.f, e.f) AND c.f NOT IN (d.f, e.f) AND d.f <> e.f),
s AS (
  SELECT part, filter_order, n, good, bad, fails,
         list_min(list_transform(fails, lambda x: instr(filter_order, x))) AS gone
  FROM c, o),
k AS (
  SELECT p.part, filter_order, step, substr(filter_order, step, 1) AS letter
  FROM (SELECT DISTINCT part FROM c) p, o, range(1, 6) g(step)),
g AS (
  SELECT k.part, k.filter_order, CAST(k.step AS INTEGER) AS step, letter,
    CAST(coalesce(sum(n) FILTER (gone IS NULL OR gone > k.step), 0) AS BIGINT) AS kept,
    CAST(coalesce(sum(n) FILTER (gone = k.step), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (gone < k.step AND list_contains(fails, letter)), 0) AS BIGINT) AS redundant,
    CAST(coalesce(sum(n) FILTER (fails = [letter]), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (gone = k.step AND good), 0) AS BIGINT) AS good_lost,
    CAST(coalesce(sum(n) FILTER (gone = k.step AND bad), 0) AS BIGINT) AS toxic_lost
  FROM k JOIN s ON s.part = k.part AND s.filter_order = k.filter_order
  GROUP BY k.part, k.filter_order, k.step, letter)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley
FROM g
"""
