"""DuckDB SQL with the same results as the queries, written independently of how they work."""

OP1_EXACT_DEDUP = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""

OP2_LINE_DEDUP = """
WITH lines AS (
  SELECT doc_id, i AS pos, string_split(text, chr(10))[i] AS line FROM documents, LATERAL (SELECT unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i)
), hashed AS (SELECT *, ('0x' || substr(md5(line), 1, 8))::BIGINT AS h FROM lines),
rolled AS (SELECT *, h + 257 * coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY pos), 0) AS h2 FROM hashed),
marked AS (
  SELECT doc_id, pos, line, f, CASE f WHEN 1 THEN h % 2 = 0 WHEN 2 THEN h % 2 = 1 WHEN 3 THEN h2 % 2 = 0 WHEN 4 THEN h2 % 2 = 1 ELSE h % 3 = 0 END AS closes
  FROM rolled, (SELECT unnest(range(1, 6)) AS f)
), numbered AS (
  SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY doc_id, f ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM marked
), chunks AS (
  SELECT DISTINCT doc_id, start, n, body FROM (SELECT doc_id, min(pos) AS start, count(*) AS n, string_agg(line, chr(10) ORDER BY pos) AS body FROM numbered GROUP BY doc_id, f, chunk)
  WHERE n >= 2 AND trim(replace(replace(replace(body, chr(10), ' '), chr(9), ' '), chr(13), ' ')) <> ''
), judged AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, start) > 1 AS gone FROM chunks),
lost AS (SELECT DISTINCT doc_id, unnest(range(start, start + n)) AS pos, 1 AS gone FROM judged WHERE gone)
SELECT doc_id, count(*) AS n_lines, count(gone) AS n_removed, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE gone IS NULL), '')) AS kept_sha256
FROM lines LEFT JOIN lost USING (doc_id, pos) GROUP BY doc_id
"""

_WORDS = r"list_filter(regexp_split_to_array(translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

OP4_DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
wins AS (
  SELECT DISTINCT item_id, array_to_string(w[i : i + 9], ' ') AS win, len(w[i : i + 9]) AS n
  FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM wins),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS win
  FROM d, lens, LATERAL (SELECT unnest(range(1, len(w) - n + 2)) AS i)
), hits AS (SELECT DISTINCT doc_id, i, wins.n, item_id FROM places JOIN wins USING (win, n)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM hits, LATERAL (SELECT unnest(range(i, i + n)) AS p) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS k FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN found USING (doc_id)
"""

OP8_MIXING = """
WITH counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, 0.5) AS target FROM documents GROUP BY source),
rates AS (SELECT source, target / (SELECT sum(target) FROM counts) * (SELECT sum(n) FROM counts) * 1.0 / n AS rate FROM counts),
parts AS (SELECT *, ceil(rate / 64.0)::INT AS m FROM rates),
draws AS (
  SELECT doc_id, d.source, text, rate / m AS r, ('0x' || substr(md5('7|' || doc_id || '|' || j), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM documents d JOIN parts USING (source), LATERAL (SELECT unnest(range(1, m + 1)) AS j)
), terms AS (
  SELECT source, r, k, sum(p) OVER (PARTITION BY source ORDER BY k) AS cdf
  FROM (SELECT source, rate / m AS r, k, exp(-rate / m + k * ln(rate / m) - lgamma(k + 1)) AS p FROM parts, LATERAL (SELECT unnest(range(0, 200)) AS k))
), drawn AS (
  SELECT doc_id, d.source, text, (SELECT count(*) FROM terms t WHERE t.source = d.source AND t.cdf <= d.u) AS c FROM draws d
), totals AS (SELECT doc_id, source, text, sum(c) AS copies FROM drawn GROUP BY ALL)
SELECT doc_id, source, unnest(range(1, copies::BIGINT + 1))::INT AS copy_no, sha256(text) AS text_sha256 FROM totals
"""

_URL = """SELECT *, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM (SELECT *, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM {})"""
_RULE = """CASE WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END"""

_SAME = r"""CASE WHEN contains({0}, '://') THEN translate(regexp_extract({0}, '(?s)^(.*?://[^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || regexp_extract({0}, '(?s)^.*?://[^/?#]*([^#]*)', 1) END"""
_FOLDER = r"CASE WHEN regexp_matches(url, '(?s)^.*?://[^/?#]*/') THEN regexp_extract(url, '(?s)^(.*?://[^?#]*/)', 1) ELSE regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || '/' END"

OP9_URL_FILTER = rf"""
WITH RECURSIVE named AS (
  SELECT url, regexp_extract(t, '(?is)\bhref\s*=\s*["'']?\s*([^"''\s>]+)', 1) AS target
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<link\b[^>]*>')) AS t FROM pages) WHERE regexp_matches(t, '(?is)\brel\s*=\s*(["''][^"''>]*\bcanonical\b|canonical\b)')
  UNION ALL
  SELECT url, regexp_extract(t, '(?is)\burl\s*=\s*["'']?\s*([^"''\s>]+)', 1)
  FROM (SELECT url, unnest(regexp_extract_all(html, '(?is)<meta\b[^>]*>')) AS t FROM pages) WHERE regexp_matches(t, '(?is)\bhttp-equiv\s*=\s*["'']?\s*refresh\b')
), tags AS (SELECT url, replace(target, '&amp;', '&') AS target FROM named),
full_tags AS (
  SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target
    WHEN starts_with(target, '//') THEN regexp_extract(url, '(?s)^(.*?:)//', 1) || target
    WHEN starts_with(target, '/') THEN regexp_extract(url, '(?s)^(.*?://[^/?#]*)', 1) || target
    WHEN starts_with(target, '?') THEN regexp_extract(url, '(?s)^(.*?://[^?#]*)', 1) || target
    WHEN target <> '' AND NOT starts_with(target, '#') AND NOT regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_FOLDER} || target END AS target
  FROM tags WHERE contains(url, '://')
), ends AS (SELECT {_SAME.format("url")} AS a, {_SAME.format("target")} AS b FROM full_tags WHERE contains(target, '://')),
links AS (SELECT a, b FROM ends UNION SELECT b, a FROM ends),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
tainted AS (SELECT DISTINCT a FROM reach JOIN ({_URL.format("(SELECT DISTINCT b AS url FROM reach)")}) t ON t.url = reach.b WHERE {_RULE} IN ('net/', 'example.com/de/')),
judged AS (SELECT page_id, {_SAME.format("url")} AS same, coalesce(host, '') AS host, coalesce(path, '') AS path, {_RULE} AS rule FROM ({_URL.format("pages")}))
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' WHEN same IN (SELECT a FROM tainted) THEN 'block' ELSE 'allow' END AS verdict
FROM judged
"""
