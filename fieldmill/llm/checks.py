"""DuckDB SQL for the queries that SQL can express: plain definitions, without the operators' methods."""

from __future__ import annotations

from fieldmill.llm import hosts, quality

BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
SPACE = r"[ \t\n\x0B\f\r]"


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


LINE_QUALITY = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '{SPACE}'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w) x),
rep AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep WHERE n > 1) x GROUP BY doc_id),
l AS (SELECT doc_id, line, trim(line, {BLANKS}) AS bare FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d) x),
m AS (SELECT doc_id, line, bare, lower(bare) AS low, len(regexp_split_to_array(bare, '{SPACE}')) AS n,
  length(bare) - length(regexp_replace(bare, '{quality.SYMBOL}', '', 'g')) AS marks,
  len(list_filter(string_split(bare, ' '), lambda x: regexp_matches(x, '[!?]{{2,}}$'))) AS doubled,
  len(list_filter(string_split(bare, ' '), lambda x: x IN ('|', '»', '›', '•', '·', '>'))) AS separators,
  {' + '.join(f"(len(string_split(lower(bare), {quoted(x)})) - 1) * {x.count(' ') + 1}" for x in quality.BOILERPLATE)} AS phrase_words FROM l),
p AS (SELECT doc_id, line, bare, bare = '' OR ((regexp_matches(bare, {quoted(quality.ENDS_SENTENCE)}) OR regexp_matches(bare, {quoted(quality.SENTENCE_MARKS)}) OR n < 3) AND doubled * 3 <= n
  AND marks * 10 <= length(bare) AND separators * 8 <= n AND rtrim(low, ' .!>»') NOT IN ({', '.join(map(quoted, quality.CALLS))})
  AND (phrase_words = 0 OR phrase_words * {quality.BOILERPLATE_SHARE} < n)) AS pass FROM m),
s AS (SELECT doc_id, count(*) FILTER (WHERE bare <> '') - count(DISTINCT line) FILTER (WHERE bare <> '') AS n_dup_lines,
  CAST(sum(length(bare)) AS BIGINT) AS line_chars, CAST(coalesce(sum(length(bare)) FILTER (WHERE pass), 0) AS BIGINT) AS kept_chars FROM p GROUP BY doc_id),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, length(array_to_string(w, '')) AS word_chars,
  length(t) - length(regexp_replace(t, '{quality.SYMBOL}', '', 'g')) AS n_symbols, n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, line_chars, kept_chars
  FROM w JOIN s ON s.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * kept_chars >= 50 * line_chars AS kept FROM b"""

NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '{SPACE}'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0) x),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, k.b FROM reach r JOIN link k ON k.a = r.b),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(m, w.doc_id)) AS component_id,
  w.doc_id = least(w.doc_id, coalesce(m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN least ON least.doc_id = w.doc_id"""

TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) r WHERE rank <= 5"""


def reputation(rules: list[tuple[str, str, str]]) -> str:
    """The same priors, level by level, and the rules."""
    def level(key: str, parent: str, above: str) -> str:
        return f"""
o_{key} AS (SELECT c.{key}, c.{parent}, sum(good) AS good, sum(n) AS n, any_value(a.mean) AS mean FROM counts c JOIN {above} a ON a.{parent} = c.{parent} GROUP BY ALL),
v_{key} AS (SELECT (sum(n * power(good / n - mean, 2)) - sum(mean * (1 - mean))) / nullif(sum((n - 1) * mean * (1 - mean)), 0) AS v FROM o_{key}),
k_{key} AS (SELECT CASE WHEN v > 0 THEN least(1e4, greatest(1, 1 / v - 1)) ELSE 1e4 END AS k FROM v_{key}),
p_{key} AS (SELECT {key}, k * mean + good AS a, k * (1 - mean) + n - good AS b, (k * mean + good) / (k + n) AS mean FROM o_{key}, k_{key})"""
    fits = [f"SELECT {quoted(host)} AS own, {quoted(path)} AS prefix, {quoted(says)} AS says" for host, path, says in rules]
    return rf"""
WITH u AS (SELECT page_id, lower(coalesce(regexp_extract(url, '^[\s\S]*?://([^/?#]*)', 1), '')) AS host,
  coalesce(regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
v AS (SELECT *, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS site FROM u),
x AS (SELECT *, string_split(site, '.') AS l, regexp_full_match(site, '[0-9]+([.][0-9]+){{3}}') OR starts_with(site, '[') AS ip FROM v),
y AS (SELECT *, CASE WHEN length(l[-1]) = 2 AND coalesce(l[-2], '') IN ({', '.join(map(quoted, hosts.SECOND_LEVEL))}) THEN 2 ELSE 1 END AS own FROM x),
h AS (SELECT page_id, host, path, site, '' AS every, CASE WHEN ip THEN {quoted(hosts.ADDRESSES)} ELSE array_to_string(l[-own:], '.') END AS suffix,
  CASE WHEN ip THEN site ELSE array_to_string(l[-own - 1:], '.') END AS domain FROM y),
k AS (SELECT doc_id, min(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0 ELSE 0.0 END) AS good FROM labels
  WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY doc_id),
counts AS (SELECT site, domain, suffix, every, CAST(sum(good) AS DOUBLE) AS good, CAST(count(*) AS DOUBLE) AS n FROM h JOIN k ON k.doc_id = h.page_id GROUP BY ALL),
top AS (SELECT '' AS every, (coalesce(sum(good), 0) + 1) AS a, (coalesce(sum(n - good), 0) + 1) AS b,
  (coalesce(sum(good), 0) + 1) / (coalesce(sum(n), 0) + 2) AS mean FROM counts),{level('suffix', 'every', 'top')},{level('domain', 'suffix', 'p_suffix')},{level('site', 'domain', 'p_domain')},
e AS (SELECT h.*, coalesce(ph.a, pd.a, ps.a, top.a) AS a, coalesce(ph.b, pd.b, ps.b, top.b) AS b FROM h LEFT JOIN p_site ph ON ph.site = h.site
  LEFT JOIN p_domain pd ON pd.domain = h.domain LEFT JOIN p_suffix ps ON ps.suffix = h.suffix, top),
r AS ({' UNION ALL '.join(fits)}),
f AS (SELECT page_id, host, path, arg_max(own || prefix, length(own || prefix)) AS rule, arg_max(says, length(own || prefix)) AS says
  FROM (SELECT DISTINCT host, path, page_id FROM h) x JOIN r ON (host = own OR ends_with(host, '.' || own)) AND starts_with(path, prefix) GROUP BY ALL)
SELECT e.page_id, e.host, e.path, f.rule, coalesce(f.says, CASE WHEN
  a / (a + b) - 1.645 * sqrt(a / (a + b) * (1 - a / (a + b)) / (a + b + 1)) >= 0.5 THEN 'allow' ELSE 'block' END) AS verdict
FROM e LEFT JOIN f ON f.page_id = e.page_id"""


def crc32(text: str) -> str:
    """Unsigned crc32 of an ASCII text, by its bits."""
    return (f"xor(list_reduce([4294967295::BIGINT] || list_transform(string_split({text}, ''), lambda ch: ord(ch)::BIGINT), lambda a, b: "
            "list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda x, z: "
            "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)")


#: Every beginning is the list of the digests of its turns; subtrees are found by joining each node with its own beginnings.
PREFIX_TRIE = f"""
WITH turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                      row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos
               FROM conversations WHERE conv_id IS NOT NULL),
     own AS (SELECT conv_id, conv_id - conv_id % 100 AS base, {crc32('conv_id::VARCHAR')} % 6 AS h
             FROM (SELECT DISTINCT conv_id FROM turns)),
     rebuilt AS (SELECT o.conv_id, 0 AS part, t.pos, t.role, t.text FROM own o JOIN turns t ON t.conv_id = o.base AND t.pos < o.h
                 UNION ALL
                 SELECT o.conv_id, 1, t.pos, t.role, t.text FROM own o JOIN turns t ON t.conv_id = o.conv_id AND t.pos >= o.h),
     placed AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS d, length(text) AS chars,
                       md5(length(role)::VARCHAR || ':' || role || text) AS name FROM rebuilt),
     beginnings AS (SELECT conv_id, d, chars, string_agg(name, '') OVER (PARTITION BY conv_id ORDER BY d) AS path FROM placed
                    UNION ALL SELECT conv_id, 0, 0, '' FROM own),
     sized AS (SELECT *, max(d) OVER (PARTITION BY conv_id) AS turns FROM beginnings),
     nodes AS (SELECT path, d, min(conv_id) AS conv_id, count(*) AS n, max(chars) AS chars,
                      sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE turns = d), '')) AS ends
               FROM sized GROUP BY path, d),
     child AS (SELECT substr(path, 1, length(path) - 32) AS path, count(*) AS n FROM nodes WHERE d > 0 GROUP BY 1),
     full_nodes AS (SELECT o.*, coalesce(c.n, 0) AS children FROM nodes o LEFT JOIN child c USING (path)),
     above AS (SELECT unnest(range(d + 1)) AS k, * FROM full_nodes),
     subtree AS (SELECT substr(path, 1, 32 * k) AS path, count(*) FILTER (WHERE children = 0) AS leaves, sum((n - 1) * chars) AS saved
                 FROM above GROUP BY 1)
SELECT o.conv_id, o.d AS depth, p.conv_id AS parent_conv_id, o.n AS n_convs, o.children AS n_children, s.leaves AS n_leaves,
       s.saved::BIGINT AS saved_tokens, o.ends AS ends_sha256
FROM full_nodes o JOIN subtree s USING (path) LEFT JOIN nodes p ON o.d > 0 AND p.path = substr(o.path, 1, length(o.path) - 32)
"""
