"""DuckDB SQL of the queries that SQL can express, over the registered tables."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP9 = rf"""
WITH d AS (SELECT doc_id, source AS host, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
words AS (SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w),
windows AS (SELECT doc_id, i, w || ' ' || lead(w, 1) OVER s || ' ' || lead(w, 2) OVER s AS g FROM words WINDOW s AS (PARTITION BY doc_id ORDER BY i)),
twice AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS c FROM windows WHERE g IS NOT NULL) WHERE c > 1),
covered AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, range(3) r(k) GROUP BY doc_id),
split AS (SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS l FROM d),
lines AS (SELECT doc_id, host, text, l, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS norm,
          len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words FROM split WHERE regexp_matches(l, '[^\x20\x09-\x0D]')),
hosts AS (SELECT host, count(*) AS docs FROM d GROUP BY host),
counts AS (SELECT host, norm, count(DISTINCT doc_id) AS n FROM lines GROUP BY host, norm),
frequent AS (SELECT counts.host, norm FROM counts JOIN hosts ON counts.host IS NOT DISTINCT FROM hosts.host WHERE n > greatest(3, 0.005 * docs)),
dup AS (SELECT doc_id, sum(c - 1) AS n FROM (SELECT doc_id, l, count(*) AS c FROM lines GROUP BY doc_id, l) GROUP BY doc_id),
lost AS (SELECT doc_id, sum(words) AS n FROM lines JOIN frequent ON lines.norm = frequent.norm AND lines.host IS NOT DISTINCT FROM frequent.host GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(length(array_to_string(ws, '')), 0) AS word_chars,
      length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines,
      coalesce(covered.n, 0) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS boilerplate_words
      FROM w LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id) LEFT JOIN lost USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT *, NOT base_failed AND boilerplate_words <= 0.5 * n_words AS kept FROM f
"""

OP1 = rf"""
WITH raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
lines AS (SELECT doc_id, l, n, regexp_matches(l, '[^\x20\x09-\x0D]') AS solid,
          CAST(sum(CASE WHEN regexp_matches(l, '[^\x20\x09-\x0D]') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS k FROM raw),
norm AS (SELECT doc_id, k, translate(regexp_replace(l, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), '{_UPPER}', '{_LOWER}') AS x,
         len(regexp_extract_all(l, '[^\x20\x09-\x0D]+')) AS words, count(*) OVER (PARTITION BY doc_id) AS all_lines FROM lines WHERE solid),
ahead AS (SELECT doc_id, k, all_lines, words, x AS a, lead(x, 1) OVER s AS b, lead(x, 2) OVER s AS c, words + lead(words, 1) OVER s AS two FROM norm WINDOW s AS (PARTITION BY doc_id ORDER BY k)),
w AS (SELECT doc_id, k, 3 AS size, a, b, c FROM ahead WHERE c IS NOT NULL
      UNION ALL SELECT doc_id, k, 2, a, b, NULL FROM ahead WHERE b IS NOT NULL AND (two > 50 OR all_lines = 2)
      UNION ALL SELECT doc_id, k, 1, a, NULL, NULL FROM ahead WHERE words > 50 OR all_lines = 1),
later AS (SELECT doc_id, k, size FROM (SELECT *, row_number() OVER (PARTITION BY size, a, b, c ORDER BY doc_id, k) AS r FROM w) WHERE r > 1),
covered AS (SELECT DISTINCT later.doc_id, norm.k FROM later JOIN norm ON norm.doc_id = later.doc_id AND norm.k BETWEEN later.k AND later.k + later.size - 1),
marked AS (SELECT lines.*, CASE WHEN solid THEN here.k IS NOT NULL ELSE here.k IS NOT NULL AND next.k IS NOT NULL END AS gone
           FROM lines LEFT JOIN covered here ON here.doc_id = lines.doc_id AND here.k = lines.k LEFT JOIN covered next ON next.doc_id = lines.doc_id AND next.k = lines.k + 1),
cleaned AS (SELECT doc_id, coalesce(string_agg(l, chr(10) ORDER BY n) FILTER (WHERE NOT gone), '') AS text, CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_removed FROM marked GROUP BY doc_id)
SELECT d.doc_id, c.text, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed FROM documents d LEFT JOIN cleaned c USING (doc_id)
"""

_LISTED = "regexp_matches('.' || host, '[.](adult-x|ads-track|casino-win|cheap-pills|free-bets|spam-farm)[.]example[.](com|net|org)$')"
OP6 = rf"""
WITH r AS (SELECT page_id, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
fits AS (SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
         FROM h JOIN rules ON ends_with('.' || host, '.' || rhost) AND starts_with(path, rpath) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, CASE WHEN {_LISTED} THEN 'block' ELSE 'allow' END) AS verdict FROM h LEFT JOIN fits USING (page_id)
"""

# crc32 is a fold over the bits of the decimal id
_CRC = """4294967295 - list_reduce(list_concat([4294967295], flatten(list_transform(range(1, length(conv_id::VARCHAR) + 1),
          lambda i: [ascii(substr(conv_id::VARCHAR, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
          lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, CASE WHEN a % 2 = 1 THEN 3988292384 ELSE 0 END) END)"""
OP11 = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), text) AS pos
           FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, ({_CRC}) % 9 AS h FROM (SELECT DISTINCT conv_id FROM t)),
r AS (SELECT c.conv_id, 0 AS part, pos, role, text FROM c JOIN t ON t.conv_id = c.base AND pos <= h
      UNION ALL SELECT c.conv_id, 1, pos, role, text FROM c JOIN t ON t.conv_id = c.conv_id AND pos > h),
p AS (SELECT conv_id, row_number() OVER w AS depth, strlen(text) AS bytes, sha256(to_json(list([role, text]) OVER w)::VARCHAR) AS k FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
      UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT depth, k, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(bytes) AS bytes FROM p GROUP BY depth, k),
up AS (SELECT node.*, above.depth AS d0, above.k AS k0 FROM node LEFT JOIN p above ON above.conv_id = node.conv_id AND above.depth = node.depth - 1),
kids AS (SELECT d0 AS depth, k0 AS k, count(*) AS n_children FROM up WHERE depth > 0 GROUP BY d0, k0),
full_node AS (SELECT up.*, coalesce(n_children, 0) AS n_children FROM up LEFT JOIN kids USING (depth, k)),
below AS (SELECT p.depth, p.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * x.bytes) AS saved_tokens
          FROM full_node x JOIN p ON p.conv_id = x.conv_id AND p.depth <= x.depth GROUP BY p.depth, p.k),
ends AS (SELECT depth, k, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM p JOIN (SELECT conv_id, max(depth) AS depth FROM p GROUP BY conv_id) USING (conv_id, depth) GROUP BY depth, k)
SELECT x.conv_id, x.depth, above.conv_id AS parent_conv_id, x.n_convs, x.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, coalesce(sha, sha256('')) AS ends_sha256
FROM full_node x JOIN below USING (depth, k) LEFT JOIN ends USING (depth, k) LEFT JOIN node above ON above.depth = x.d0 AND above.k = x.k0
"""

OP13 = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) >= 2 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN w ELSE [] END) AS own FROM d),
sets AS (SELECT list_sort(own) AS own, len(own) AS n, min(doc_id) AS node FROM s WHERE len(own) > 0 GROUP BY own),
sh AS MATERIALIZED (SELECT node, n, unnest(own) AS g FROM sets),
link AS MATERIALIZED (SELECT a.node AS a, b.node AS b FROM sh a JOIN sh b ON a.g = b.g AND a.node <> b.node AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
         GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
reach(node, top) AS (SELECT node, node FROM sets UNION SELECT link.b, reach.top FROM reach JOIN link ON link.a = reach.node WHERE reach.top < link.b),
least_of AS (SELECT node, min(top) AS component_id FROM reach GROUP BY node),
named AS (SELECT own, component_id FROM sets JOIN least_of USING (node))
SELECT doc_id, CAST(len(s.own) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, doc_id = coalesce(component_id, doc_id) AS kept
FROM s LEFT JOIN named ON list_sort(s.own) = named.own
"""
