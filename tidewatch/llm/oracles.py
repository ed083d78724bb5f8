"""SQL twins of the queries that SQL can express."""

LINE_DEDUP = """
WITH cut AS (
  SELECT doc_id, source, text, row_number() OVER () AS rid FROM documents
), lines AS (
  SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM cut
), counted AS (
  SELECT l.source, trim(l.line, ' ') AS line, count(DISTINCT rid) AS pages, min(doc_id) AS keeper, any_value(t.total) AS total,
         len(regexp_extract_all(trim(l.line, ' '), '[^\\x20\\x09-\\x0D]+')) > 50 AS passage
  FROM lines l JOIN (SELECT source, count(*) AS total FROM documents GROUP BY source) t ON l.source = t.source
  WHERE trim(l.line, ' ') <> ''
  GROUP BY l.source, trim(l.line, ' ')
), often AS (
  SELECT source, line, CASE WHEN passage THEN keeper END AS keeper FROM counted
  WHERE CASE WHEN passage THEN pages > 1 AND pages > CAST(0.001 AS DOUBLE) * total ELSE pages >= 5 AND pages > CAST(0.05 AS DOUBLE) * total END
), marked AS (
  SELECT l.*, o.line IS NOT NULL AND (o.keeper IS NULL OR l.doc_id <> o.keeper) AS bad
  FROM lines l LEFT JOIN often o ON l.source = o.source AND trim(l.line, ' ') = o.line
), joined AS (
  SELECT rid, count(*) AS n_lines, count(*) FILTER (WHERE bad) AS n_dropped,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS text
  FROM marked GROUP BY rid
)
SELECT c.doc_id, CASE WHEN c.text IS NULL THEN NULL ELSE coalesce(j.text, '') END AS text,
       coalesce(j.n_lines, 0) AS n_lines, coalesce(j.n_dropped, 0) AS n_dropped
FROM cut c LEFT JOIN joined j USING (rid)
"""

NEAR_DEDUP = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
), shingles AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 2 THEN [w[1]]
         ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s
  FROM words
), classes AS (
  SELECT min(doc_id) AS rep, list_sort(s) AS s FROM shingles WHERE len(s) > 0 GROUP BY list_sort(s)
), cells AS (
  SELECT rep, len(s) AS n, unnest(s) AS g FROM classes
), common AS (
  SELECT a.rep AS u, b.rep AS v, a.n AS nu, b.n AS nv, count(*) AS c
  FROM cells a JOIN cells b ON a.g = b.g AND a.rep < b.rep
  WHERE 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY ALL
), links AS (
  SELECT u, v FROM common WHERE 100 * c >= 80 * (nu + nv - c)
), both_ways AS (
  SELECT u, v FROM links UNION ALL SELECT v, u FROM links
), reach AS (
  SELECT rep AS v, rep AS c FROM classes
  UNION
  SELECT b.v, r.c FROM reach r JOIN both_ways b ON b.u = r.v WHERE r.c < b.v
), named AS (
  SELECT v, min(c) AS component FROM reach GROUP BY v
)
SELECT x.doc_id, len(x.s) AS n_shingles, coalesce(n.component, x.doc_id) AS component_id,
       x.doc_id = coalesce(n.component, x.doc_id) AS kept
FROM shingles x LEFT JOIN classes k ON list_sort(x.s) = k.s LEFT JOIN named n ON n.v = k.rep
"""

URL_FILTERS = """
WITH given AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), rows AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM given
), marks AS (
  SELECT doc_id AS page_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS is_bad
  FROM labels WHERE doc_id IS NOT NULL AND (quality IS NOT NULL OR toxic IS NOT NULL) GROUP BY doc_id
), counted AS (
  SELECT host, count(is_bad) AS n, coalesce(sum(is_bad), 0) AS bad,
         regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS name
  FROM rows LEFT JOIN marks USING (page_id) WHERE host <> '' GROUP BY host
), parts AS (
  SELECT *, string_split(name, '.') AS p FROM counted
), hosts AS (
  SELECT host, n, bad,
         CASE WHEN len(p) < 2 THEN name WHEN two THEN array_to_string(p[-3:], '.') ELSE array_to_string(p[-2:], '.') END AS domain,
         CASE WHEN two THEN array_to_string(p[-2:], '.') ELSE p[-1] END AS suffix
  FROM (SELECT *, array_to_string(p[-2:], '.') IN ('ac.uk', 'co.uk', 'gov.uk', 'org.uk', 'com.au', 'net.au', 'org.au', 'co.jp',
    'ne.jp', 'or.jp', 'co.kr', 'co.nz', 'co.za', 'com.br', 'com.cn', 'com.mx', 'com.tr', 'com.tw', 'co.in', 'com.ar') AS two FROM parts)
), total AS (
  SELECT CASE WHEN sum(n) > 0 THEN (sum(bad) + 0.5::DOUBLE) / (sum(n) + 1.0::DOUBLE) ELSE 0::DOUBLE END AS m FROM hosts
), s0 AS (
  SELECT suffix, sum(n) AS n, sum(bad) AS bad, max(m) AS m FROM hosts, total GROUP BY suffix
), sk AS (
  SELECT 1 / coalesce(least(greatest((sum(n * pow(bad / n::DOUBLE - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0)::DOUBLE,
         0.001::DOUBLE), 0.999::DOUBLE), 0.001::DOUBLE) - 1 AS k FROM s0 WHERE n > 0
), s1 AS (
  SELECT suffix, (bad + k * m) / (n + k) AS m FROM s0, sk
), d0 AS (
  SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad, max(m) AS m FROM hosts JOIN s1 USING (suffix) GROUP BY domain, suffix
), dk AS (
  SELECT 1 / coalesce(least(greatest((sum(n * pow(bad / n::DOUBLE - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0)::DOUBLE,
         0.001::DOUBLE), 0.999::DOUBLE), 0.001::DOUBLE) - 1 AS k FROM d0 WHERE n > 0
), d1 AS (
  SELECT domain, suffix, (bad + k * m) / (n + k) AS m FROM d0, dk
), h0 AS (
  SELECT host, n, bad, m FROM hosts JOIN d1 USING (domain, suffix)
), hk AS (
  SELECT 1 / coalesce(least(greatest((sum(n * pow(bad / n::DOUBLE - m, 2) / (m * (1 - m))) - count(*)) / nullif(sum(n - 1), 0)::DOUBLE,
         0.001::DOUBLE), 0.999::DOUBLE), 0.001::DOUBLE) - 1 AS k FROM h0 WHERE n > 0
), h1 AS (
  SELECT host, n, k, (bad + k * m) / (n + k) AS mean FROM h0, hk
), known AS (
  SELECT host, round(mean - 1.645::DOUBLE * sqrt(mean * (1 - mean) / (n + k + 1)), 6) AS bound FROM h1
), rules(says, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
         ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), fits AS (
  SELECT DISTINCT ON (host, path) host, path, rhost || rpath AS rule, says
  FROM (SELECT DISTINCT host, path FROM rows) JOIN rules
    ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  ORDER BY host, path, length(rhost || rpath) DESC, rhost || rpath
)
SELECT page_id, r.host, r.path, f.rule, coalesce(f.says, CASE WHEN k.bound > 0.35::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict, k.bound
FROM rows r LEFT JOIN fits f ON r.host = f.host AND r.path = f.path LEFT JOIN known k ON r.host = k.host
"""

DECONTAMINATION = """
WITH dw AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark
), wins AS (
  SELECT DISTINCT item, unnest(CASE WHEN len(w) <= 10 THEN [array_to_string(w, ' ')]
         ELSE [array_to_string(w[i : i + 9], ' ') FOR i IN range(1, len(w) - 8)] END) AS body, least(len(w), 10) AS n
  FROM iw WHERE len(w) > 0
), spans AS (
  SELECT rid, i, n, array_to_string(w[i : i + n - 1], ' ') AS body
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, (SELECT DISTINCT n FROM wins))
), met AS (
  SELECT s.rid, s.i, s.n, x.item FROM spans s JOIN wins x ON s.body = x.body AND s.n = x.n
), covered AS (
  SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM met) GROUP BY rid
), named AS (
  SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM met GROUP BY rid
)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (rid) LEFT JOIN named USING (rid)
"""

CONVERSATION_TRIE = """
WITH turns AS (
  SELECT conv_id AS c, strlen(coalesce(text, '')) AS size, turn,
         left(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS d
  FROM conversations WHERE conv_id IS NOT NULL
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, d) AS p FROM turns
), crc AS (
  SELECT c, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
    lambda acc, b: list_reduce(list_prepend(xor(acc, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
                               lambda x, z: xor(x >> 1, (x & 1) * 3988292384)))) % 9 AS h
  FROM (SELECT DISTINCT c FROM turns)
), chosen AS (
  SELECT k.c, 0 AS part, b.p, b.d, b.size FROM crc k JOIN placed b ON b.c = k.c - k.c % 5 AND b.p <= k.h
  UNION ALL
  SELECT k.c, 1, o.p, o.d, o.size FROM crc k JOIN placed o ON o.c = k.c AND o.p > k.h
), ordered AS (
  SELECT *, row_number() OVER (PARTITION BY c ORDER BY part, p) AS r FROM chosen
), prefixes AS (
  SELECT c, r, size, string_agg(d, '') OVER (PARTITION BY c ORDER BY r) AS key FROM ordered
  UNION ALL SELECT c, 0, 0, '' FROM crc
), lengths AS (
  SELECT c, max(r) AS len FROM prefixes GROUP BY c
), nodes AS (
  SELECT key, any_value(r) AS depth, any_value(size) AS size, min(c) AS low, count(*) AS n,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE r = len), '')) AS ends
  FROM prefixes JOIN lengths USING (c) GROUP BY key
), kids AS (
  SELECT left(key, 32 * (depth - 1)) AS key, count(*) AS kids FROM nodes WHERE depth > 0 GROUP BY ALL
), counted AS (
  SELECT n.*, coalesce(k.kids, 0) AS kids FROM nodes n LEFT JOIN kids k USING (key)
), owed AS (
  SELECT left(key, 32 * k) AS key, sum((kids = 0)::BIGINT) AS leaves, sum((n - 1) * size) AS saved
  FROM (SELECT *, unnest(range(depth + 1)) AS k FROM counted) GROUP BY ALL
)
SELECT x.low AS conv_id, x.depth::BIGINT AS depth, p.low AS parent_conv_id, x.n AS n_convs, x.kids AS n_children,
       o.leaves::BIGINT AS n_leaves, o.saved::BIGINT AS saved_tokens, x.ends AS ends_sha256
FROM counted x JOIN owed o USING (key) LEFT JOIN nodes p ON x.depth > 0 AND p.key = left(x.key, 32 * (x.depth - 1))
"""
