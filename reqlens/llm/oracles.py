"""DuckDB SQL that gives the rows of the corpus queries, where SQL can express them."""

#: Words of a text; hash of a row; water level over sources in order of cap / weight; bound by running sums over hashes.
OP2 = r"""
WITH r AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         CAST(('0x' || substr(md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '\N'), coalesce(source, '\N'), md5(coalesce(text, '')))), 1, 12)) AS BIGINT) AS hash
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM r GROUP BY source),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, source_size * 2 AS cap FROM s),
l AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE - ((sum(cap) OVER o) - cap)::DOUBLE) / ((sum(weight) OVER ()) - (sum(weight) OVER o) + weight) AS lev
      FROM w WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST)),
f AS (SELECT arg_min(lev, cap::DOUBLE / weight) FILTER (WHERE lev * weight < cap) AS final FROM l),
t AS (SELECT source, source_size, CASE WHEN final IS NULL THEN cap::DOUBLE ELSE least(final * weight, cap::DOUBLE) END AS target FROM l, f),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM t),
q AS (SELECT *, target - whole * source_size AS need FROM p),
u AS (SELECT r.source, r.hash, sum(r.size) AS size FROM r GROUP BY ALL),
c AS (SELECT u.*, q.need, sum(u.size) OVER (PARTITION BY u.source ORDER BY u.hash) AS upto FROM u JOIN q ON u.source IS NOT DISTINCT FROM q.source),
b AS (SELECT source, min({'hash': hash, 'nearer': CASE WHEN upto - need < need - (upto - size) THEN 1 ELSE 0 END}) AS at FROM c WHERE upto > need GROUP BY source)
SELECT r.doc_id, r.size, q.source_size, q.target,
       CAST(r.size * (q.whole + CASE WHEN q.whole < 2 AND (b.at IS NULL OR r.hash < b.at.hash + b.at.nearer) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r JOIN q ON r.source IS NOT DISTINCT FROM q.source LEFT JOIN b ON r.source IS NOT DISTINCT FROM b.source
"""

#: Every window of 50 words, its least document, and the words that a window with a smaller one covers.
OP6 = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
i AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
h AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM i),
m AS (SELECT h, min(doc_id) AS first FROM h GROUP BY h),
d AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS k FROM h JOIN m USING (h) WHERE first < doc_id),
e AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w),
r AS (SELECT doc_id, string_agg(word, ' ' ORDER BY k) AS kept, count(*) AS n FROM e ANTI JOIN d USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN r USING (doc_id)
"""

#: Sets of shingles, one class for equal sets, pairs by common shingles, and the least document that links reach.
OP8 = r"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), CAST([] AS VARCHAR[])) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' ')) END)) AS s FROM w),
k AS (SELECT doc_id, len(s) AS n, CASE WHEN len(s) = 0 THEN doc_id::VARCHAR ELSE md5(array_to_string(s, chr(10))) END AS c, s FROM s),
g AS (SELECT c, min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s FROM k GROUP BY c),
t AS (SELECT id, n, unnest(s) AS x FROM g),
l AS (SELECT a.id AS u, b.id AS v FROM t a JOIN t b ON a.x = b.x AND a.id != b.id AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n) GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT id, id FROM g UNION SELECT r.a, l.v FROM r JOIN l ON l.u = r.b),
o AS (SELECT a AS id, min(b) AS least FROM r GROUP BY a)
SELECT k.doc_id, k.n AS n_shingles, o.least AS component_id FROM k JOIN g USING (c) JOIN o ON o.id = g.id
"""

OP9 = r"""
WITH p AS (
  SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(((page_id % 366) + 366) % 366 AS INTEGER) AS DATE) AS fetched_on,
         regexp_replace(lower(regexp_extract(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '\.$', '') AS host,
         regexp_extract(coalesce(url, ''), '(?i)^[a-z][a-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS rest
  FROM pages),
k AS (SELECT *, regexp_replace(regexp_replace(host, '^www\.', '') || rest, '/$', '') AS url_key, string_split(host, '.') AS labels FROM p),
n AS (
  SELECT 'host' AS kind, host AS entry, 5 AS of FROM k WHERE host != ''
  UNION SELECT 'domain', array_to_string(labels[greatest(len(labels) - 2, 1):greatest(len(labels) - 2, 1) + 2], '.'), 5 FROM k WHERE host != ''
  UNION SELECT 'url', url_key, 100 FROM k WHERE host != ''),
h AS (SELECT kind, entry, of, md5(kind || '|' || entry) AS h FROM n),
d AS (SELECT kind, entry, h, CAST(DATE '2023-12-01' + CAST(('0x' || substr(h, 5, 2)) AS INTEGER) AS DATE) AS since FROM h WHERE CAST(('0x' || substr(h, 1, 4)) AS INTEGER) % of = 0),
i AS (SELECT kind, entry, since, CASE WHEN CAST(('0x' || substr(h, 7, 1)) AS INTEGER) < 8 THEN CAST(since + 1 + CAST(('0x' || substr(h, 9, 2)) AS INTEGER) % 128 AS DATE) END AS until FROM d),
m AS (
  SELECT k.url, k.fetched_on, i.kind, i.entry, i.since, i.until, CASE i.kind WHEN 'url' THEN 0 WHEN 'host' THEN 1 ELSE 2 END AS rank
  FROM (SELECT DISTINCT url, host, url_key, fetched_on FROM k WHERE host != '') k
  JOIN i ON i.since <= k.fetched_on AND (i.until IS NULL OR k.fetched_on < i.until)
   AND CASE i.kind WHEN 'url' THEN i.entry = k.url_key WHEN 'host' THEN i.entry = k.host ELSE k.host = i.entry OR ends_with(k.host, '.' || i.entry) END),
v AS (SELECT url, fetched_on, count(*) AS n_entries, arg_min({'kind': kind, 'entry': entry, 'since': since, 'until': until}, {'rank': rank, 'len': -length(entry), 'kind': kind, 'entry': entry}) AS by FROM m GROUP BY ALL)
SELECT k.page_id, k.url, k.host, k.fetched_on, coalesce(v.n_entries, 0) AS n_entries, v.n_entries IS NOT NULL AS blocked,
       v.by.kind AS kind, v.by.entry AS entry, v.by.since AS since, v.by.until AS until
FROM k LEFT JOIN v ON k.url = v.url AND k.fetched_on = v.fetched_on
"""

OP10 = r"""
WITH e AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x != 0)) > 0),
d AS (
  SELECT q.vec_id AS query_id, c.vec_id, min(sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])), lambda a, b: a + b))) AS score
  FROM e q JOIN e c ON q.vec_id != c.vec_id WHERE q.vec_id % 100 = 0 GROUP BY ALL),
o AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score FROM d)
SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op2_mixing": OP2, "op6_substring_dedup": OP6, "op8_ngram_jaccard": OP8, "op9_url_filters": OP9, "op10_nearest": OP10}
