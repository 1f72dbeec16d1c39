"""Check SQL of the corpus queries, for those that SQL expresses."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT cast(item_id AS varchar) AS item_id, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT item_id, w, n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i
             FROM (SELECT item_id, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT r, i, n, item_id FROM dw JOIN bw USING (n, win)),
words AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT r, item_id FROM hits WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, cast(len(w) AS bigint) AS n_words, cast(coalesce(n_hit, 0) AS bigint) AS n_hit,
       cast(coalesce(n_items, 0) AS bigint) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

URLS = r"""
WITH u AS (SELECT page_id, lower(coalesce(url, '')) AS low,
                  CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, low, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (SELECT page_id, low, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
r(verdict, rh, rp) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                              ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
j AS (SELECT p.*, (SELECT arg_max(struct_pack(rule := rh || rp, verdict := verdict), length(rh || rp)) FROM r
                   WHERE (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)) AS best FROM p),
m AS (SELECT *, CASE
        WHEN regexp_matches(low, '/ads/policy([^a-z0-9_.%-]|$)') THEN '/ads/policy^'
        WHEN contains(low, '://tracker.') THEN '://tracker.*' WHEN regexp_matches(low, '([^a-z0-9_.%-]|^)phpsessid=') THEN '^phpsessid='
        WHEN contains(low, '/wp-login.php') AND regexp_matches(low, '/wp-login\.php([^a-z0-9_.%-]|$)') THEN '/wp-login.php^'
        WHEN contains(low, '/wp-admin/') THEN '/wp-admin/' WHEN contains(low, '/cgi-bin/') THEN '/cgi-bin/'
        WHEN regexp_matches(low, '(?s)/banner.*\.gif([^a-z0-9_.%-]|$)') THEN '/banner*.gif^'
        WHEN regexp_matches(low, '/adserver([^a-z0-9_.%-]|$)') THEN '/adserver^' WHEN contains(low, '/ads/') THEN '/ads/'
        WHEN contains(low, 'casino-bonus') THEN '*casino-bonus*' END AS pattern FROM j)
SELECT page_id, host, path, best.rule AS rule,
       coalesce(best.verdict, CASE WHEN pattern IS NULL OR pattern = '/ads/policy^' THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN best IS NULL THEN pattern END AS pattern
FROM m
"""

TOP_PRODUCTS = """
WITH e AS (SELECT vec_id, [cast(floor(1024 * cast(x AS double)) AS bigint) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
p AS (SELECT q.vec_id AS query_id, e.vec_id,
             cast(list_sum([q.v[i] * e.v[i] FOR i IN range(1, len(e.v) + 1)]) AS bigint) AS score
      FROM e q JOIN e ON q.vec_id % 100 = 0 AND q.vec_id <> e.vec_id AND len(q.v) = len(e.v)),
r AS (SELECT query_id, cast(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS integer) AS rank, vec_id, score FROM p)
SELECT * FROM r WHERE rank <= 10
"""

REVISITS = r"""
WITH r AS (SELECT page_id AS id, regexp_replace(regexp_replace(regexp_replace(lower(coalesce(url, '')), '^[a-z]+://(www\.|m\.)?', ''), '(?s)[?#].*$', ''), '(\.html|/)$', '') AS place,
  length(coalesce(html, '')) AS size, md5(coalesce(html, '')) AS digest FROM pages WHERE page_id IS NOT NULL),
v AS (SELECT *, CASE WHEN id % 5 <> 0 THEN substr(md5(place), 1, 8) || (size % 2) END AS tag, CASE WHEN id % 2 = 0 THEN size % 3 END AS lm FROM r),
j AS (SELECT a.id, a.tag, a.lm, (SELECT max(b.id) FROM v b WHERE b.place = a.place AND b.id < a.id AND b.id % 3 <> 2) AS src FROM v a WHERE a.id % 3 = 2),
o AS (SELECT j.id, j.src, s.digest, CASE WHEN src IS NULL THEN 'orphan' WHEN coalesce(s.tag = j.tag, s.lm = j.lm, true) THEN 'resolved' ELSE 'mismatch' END AS outcome
      FROM j LEFT JOIN v s ON s.id = j.src)
SELECT id AS record_id, outcome, src AS source_id, CASE WHEN outcome = 'resolved' THEN digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || id || ';server=old' END AS headers FROM o
"""

CAPTURES = r"""
WITH c AS (SELECT page_id AS k, step, coalesce(url, '') AS url, md5(coalesce(html, '')) AS body, page_id % 10 = 0 AS hot,
             step IN (1, 3, 4, 5) OR (step = 0 AND page_id % 16 = 5) AS again, page_id * 10 + step * 37 AS captured
           FROM pages, (SELECT unnest(range(6)) AS step) WHERE page_id IS NOT NULL),
v AS (SELECT *, k * 6 + step AS id, CASE WHEN hot THEN cast(floor((captured - CASE WHEN again THEN 25 ELSE 0 END) / 500) AS bigint)
             WHEN step < 2 OR (step = 3 AND k % 4 = 1) OR (step = 4 AND k % 8 = 3) THEN 0 ELSE 1 END AS version FROM c),
s AS (SELECT id, step, again, captured, version, md5(CASE WHEN hot THEN 'hot' ELSE body END || '/' || version) AS digest,
             CASE WHEN hot THEN 'https://www.hot.example/Start?id=1' ELSE url END AS url FROM v),
u AS (SELECT id, step, again, captured, version, digest, '"' || substr(digest, 1, 8) || '"' AS tag,
             CASE step WHEN 3 THEN url || '#again' WHEN 4 THEN regexp_replace(url, '^http:', 'https:')
                       WHEN 5 THEN regexp_replace(url, '^([^#?]*)\?', '\1?utm_medium=a&') ELSE url END AS url FROM s),
p AS (SELECT *, regexp_extract(url, '(?s)^([A-Za-z]+://[^/?#]*)?([^?#]*)(?:\?([^#]*))?', 1) AS front,
             regexp_extract(url, '(?s)^([A-Za-z]+://[^/?#]*)?([^?#]*)(?:\?([^#]*))?', 2) AS path,
             string_split(regexp_extract(url, '(?s)^([A-Za-z]+://[^/?#]*)?([^?#]*)(?:\?([^#]*))?', 3), '&') AS params FROM u),
q AS (SELECT id, string_agg(x, '&' ORDER BY encode(string_split(x, '=')[1]), i) AS query FROM (SELECT id, unnest(params) AS x, unnest(range(len(params))) AS i FROM p)
      WHERE x <> '' AND NOT regexp_full_match(lower(string_split(x, '=')[1]), '(?s)utm_.*|gclid|fbclid|msclkid|phpsessid|jsessionid') GROUP BY id),
r AS (SELECT p.*, regexp_replace(lower(front), '^[a-z]+://(www\.|m\.)?', '') || regexp_replace(path, '(\.html|/)$', '') || coalesce('?' || query, '') AS place
      FROM p LEFT JOIN q USING (id)),
full_ AS (SELECT place, captured, max(id) AS id FROM r WHERE NOT again GROUP BY ALL),
j AS (SELECT a.id, a.step, a.captured, a.tag, a.version, b.id AS src FROM r a ASOF LEFT JOIN full_ b ON a.place = b.place AND a.captured > b.captured WHERE a.again),
o AS (SELECT j.id, j.captured, j.src, f.digest, CASE WHEN src IS NULL THEN 'orphan' WHEN CASE WHEN j.step < 4 THEN f.tag = j.tag WHEN j.step = 4 THEN f.version = j.version ELSE true END
             THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j LEFT JOIN r f ON f.id = j.src)
SELECT id AS record_id, outcome, src AS source_id, CASE WHEN outcome = 'resolved' THEN digest END AS digest,
       CASE WHEN outcome = 'resolved' THEN 'content-type=text/html;date=' || captured || ';server=old' END AS headers FROM o
"""

HARD_NEGATIVES = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  [cast(floor(256 * cast(x AS double)) AS bigint) FOR x IN embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len([1 FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, e.vec_id, a.label = e.label AS same,
             cast(list_sum([a.v[i] * e.v[i] FOR i IN range(1, len(e.v) + 1)]) AS bigint) AS score
      FROM e a JOIN e ON a.vec_id % 50 = 0 AND a.vec_id <> e.vec_id AND len(a.v) = len(e.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS turn FROM s WHERE same),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, p.score AS positive_score, s.vec_id AS negative_id, s.score AS negative_score,
             cast(row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY s.score DESC, s.vec_id) AS integer) AS rank
      FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT s.same AND p.turn <= 5
        AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score)
SELECT * FROM n WHERE rank <= 3
"""
