"""DuckDB SQL of the queries that SQL can express, with its own values, not those of the operators."""

from __future__ import annotations

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("text"))} AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
                                           WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
reach(a, b) AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
least_of AS (SELECT a, min(b) AS m FROM reach GROUP BY a),
copies AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN doc_id ELSE min(doc_id) OVER (PARTITION BY ws) END AS copy_id,
                  CASE WHEN len(ws) = 0 THEN 1 ELSE count(*) OVER (PARTITION BY ws) END AS n_copies FROM w)
SELECT doc_id, least(doc_id, coalesce(m, doc_id)) AS class_id, copy_id, n_copies, (SELECT count(*) FROM link WHERE link.a = doc_id) AS n_links
FROM copies LEFT JOIN least_of ON least_of.a = doc_id
"""

CONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM documents),
it AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(coalesce({_LOWER.format("text")}, ''), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark WHERE item_id IS NOT NULL),
il AS (SELECT item, ws, least(13, len(ws)) AS size FROM it WHERE len(ws) > 0),
pat AS (SELECT DISTINCT item, size, s FROM (SELECT item, size, unnest(list_transform(range(1, len(ws) - size + 2), lambda i: array_to_string(ws[i:i + size - 1], ' '))) AS s FROM il)),
spot AS (SELECT doc_id, size, unnest(range(1, len(ws) - size + 2)) AS i FROM d, (SELECT DISTINCT size FROM il)),
win AS (SELECT spot.doc_id, spot.size, spot.i, array_to_string(d.ws[spot.i:spot.i + spot.size - 1], ' ') AS s FROM spot JOIN d USING (doc_id)),
hit AS (SELECT win.doc_id, win.size, win.i, pat.item FROM win JOIN pat ON win.size = pat.size AND win.s = pat.s),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + size)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item) AS n, array_to_string(list_sort(list(DISTINCT item)), ',') AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, coalesce(pos.n, 0) AS n_hit, coalesce(items.n, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(pos.n, 0) > 0 AND 20 * coalesce(pos.n, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SUBSTRINGS = rf"""
WITH w AS (SELECT doc_id, {_WORDS.format("text")} AS ws FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 49], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
first AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (s) WHERE doc_id > low),
word AS (SELECT doc_id, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS p FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS body FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, len(ws) - coalesce(kept.n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""

URLS = rf"""
WITH p AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
u AS (SELECT page_id, {_LOWER.format("regexp_extract(rest, '^[^/?#]*')")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p),
rules(rule, rhost, rpath, verdict) AS (VALUES ('com/', 'com', '/', 'allow'), ('example.com/en/', 'example.com', '/en/', 'block'),
  ('www.example.com/en/', 'www.example.com', '/en/', 'allow'), ('net/es/', 'net', '/es/', 'block'), ('net/fr/', 'net', '/fr/', 'block')),
pats(name, pat) AS (VALUES ('pharmacy shop', '(^|[.-])cheap-?pills([.-]|\n)'),
  ('casino', '(^|[./-])casino[s]?([./-]|\n|$)'), ('adult', '(^|[./-])xxx([./-]|\n|$)'), ('adult, plain', '(^|[./-])porn([./-]|\n|$)'),
  ('advert server', '^(ads?|adserver|banners?)[0-9]*\.[^\n]*\n'), ('tracker pixel', '\n(/[^/]*)*/(pixel|beacon)\.gif$'),
  ('log-in page', '\n(/[^/]*)*/(wp-)?login(\.php)?/?$'), ('free download', '(^|[.-])free-downloads?[.-]')),
fit AS (SELECT page_id, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict FROM u JOIN rules
        ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id),
hit AS (SELECT page_id, max(name) AS name FROM u JOIN pats ON regexp_matches(host || chr(10) || path, pat) GROUP BY page_id)
SELECT page_id, host, path, fit.rule AS rule, coalesce(fit.verdict, CASE WHEN hit.name IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       CASE WHEN fit.rule IS NULL THEN hit.name END AS pattern_rule
FROM u LEFT JOIN fit USING (page_id) LEFT JOIN hit USING (page_id)
"""


def _spans(kind: str, order: int, regex: str, keep: str) -> str:
    """Rows (doc_id, start, ord, stop, kind) of one pattern: gaps and bodies in turn give the places."""
    return f"""
SELECT doc_id, start, {order} AS ord, start + length(body) AS stop, '{kind}' AS kind, body FROM (
  SELECT doc_id, body, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:k - 1], lambda x: length(x))), 0) AS start
  FROM (SELECT doc_id, found, gaps, unnest(found) AS body, unnest(range(1, len(found) + 1)) AS k
        FROM (SELECT doc_id, regexp_extract_all(text, '{regex}') AS found, string_split_regex(text, '{regex}') AS gaps FROM t) WHERE len(found) > 0)) WHERE {keep}"""


_KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEYWORDS + "[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SECRETS = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
base AS ({_spans("assign", 0, _ASSIGN, f"length(regexp_extract(body, '{_ASSIGN}', 2)) >= 8")} UNION ALL
  {_spans("access", 1, "AKIA[A-Z0-9]+", "length(body) >= 16")} UNION ALL {_spans("hex", 2, "[0-9a-f]+", "length(body) >= 32")}),
cand AS ({_spans("entropy", 3, "[A-Za-z0-9+/_=-]+", "length(body) >= 20")}),
picked AS (SELECT *, CASE WHEN regexp_matches(body, '^[0-9a-fA-F]+$') THEN 2.95 WHEN regexp_matches(body, '^[A-Za-z0-9]+$') THEN 3.65 ELSE 3.75 END AS least FROM cand
  WHERE regexp_matches(body, '[0-9]') AND NOT regexp_matches(body, '^[0-9]+$')
    AND NOT regexp_matches(body, '^[0-9a-fA-F]{{8}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{4}}-[0-9a-fA-F]{{12}}$')
    AND NOT regexp_matches(body, '^[A-Za-z]+([_/=-]+[A-Za-z]+)*[_/=-]*[0-9]{{0,4}}$')
    AND NOT regexp_matches(body, '(?i)example|placeholder|your[_-]|xxxx|abcdefghij|0123456789') AND NOT regexp_matches(body, '^sha(1|256|384|512)-')),
windows AS (SELECT doc_id, start, least, k, substr(body, k, 20) AS win FROM (SELECT *, unnest(range(1, length(body) - 18)) AS k FROM picked)),
counts AS (SELECT doc_id, start, least, k, c, count(*) AS n FROM (SELECT doc_id, start, least, k, unnest(string_split(win, '')) AS c FROM windows) GROUP BY ALL),
entropy AS (SELECT doc_id, start, max(e) AS e, any_value(least) AS least FROM (SELECT doc_id, start, least, k, log2(20) - sum(n * log2(n)) / 20 AS e FROM counts GROUP BY doc_id, start, least, k) GROUP BY doc_id, start),
high AS (SELECT picked.doc_id, picked.start, picked.ord, picked.stop, picked.kind FROM picked JOIN entropy USING (doc_id, start) WHERE e >= entropy.least
  AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = picked.doc_id AND b.start < picked.stop AND picked.start < b.stop)),
said AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS s,
  count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS k, count(*) FILTER (kind = 'hex') AS h FROM base GROUP BY doc_id),
everything AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS BIGINT) || ':' || CAST(stop AS BIGINT), ',' ORDER BY start, ord) AS s
  FROM (SELECT doc_id, start, ord, stop, kind FROM base UNION ALL SELECT * FROM high) GROUP BY doc_id)
SELECT t.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(said.s, '')) AS base_sha256, coalesce(everything.s, '') AS spans
FROM t LEFT JOIN said USING (doc_id) LEFT JOIN everything USING (doc_id)
"""

QUALITY = rf"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_WORDS.format("text")} AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents),
win AS (SELECT doc_id, i, array_to_string(ws[i:i + 2], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
again AS (SELECT doc_id, s FROM win GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + 3)) AS p FROM win JOIN again USING (doc_id, s)) GROUP BY doc_id),
line AS (SELECT doc_id, host, array_to_string({_WORDS.format("x")}, ' ') AS s, len({_WORDS.format("x")}) AS n
  FROM (SELECT doc_id, host, translate(unnest(lines), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS x FROM w)),
frequent AS (SELECT host, s FROM line GROUP BY host, s HAVING count(DISTINCT doc_id) > 20),
removed AS (SELECT doc_id, sum(n) AS n FROM line JOIN frequent USING (host, s) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS word_chars,
  length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
  coalesce(rep.n, 0) AS n_repeat_words, len(ws) - coalesce(removed.n, 0) AS n_left FROM w LEFT JOIN rep USING (doc_id) LEFT JOIN removed USING (doc_id))
SELECT doc_id, n_words, CAST(word_chars AS BIGINT) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 2 * n_left >= n_words AS kept, CAST(n_left AS BIGINT) AS n_left FROM m
"""

_TOKEN = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
MIDDLE = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_TOKEN}') AS ts, sha256('42:' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
k AS (SELECT *, CAST('0x' || h[1:8] AS BIGINT) % (len(ts) + 1) AS u, CAST('0x' || h[9:16] AS BIGINT) % (len(ts) + 1) AS v,
             CAST('0x' || h[17:24] AS BIGINT) % 100 AS w, CAST('0x' || h[25:32] AS BIGINT) % 100 AS z FROM d),
f AS (SELECT doc_id, text, len(ts) AS n, CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR w >= 50 THEN 'plain' WHEN z < 80 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(ts[1:least(u, v)], '') AS p, array_to_string(ts[least(u, v) + 1:greatest(u, v)], '') AS m, array_to_string(ts[greatest(u, v) + 1:], '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(text) AS restored_sha256
FROM f
"""


def _assigned(n: int) -> str:
    """CTEs of round n: the nearest of the centroids c{n} for every vector, and the centroids moved."""
    return f"""
n{n} AS MATERIALIZED (SELECT vec_id, arg_min(c, [dist, c]) AS c, min(dist) AS dist FROM (
  SELECT vec_id, c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM v, c{n} k) GROUP BY vec_id),
m{n} AS (SELECT c, i, floor(sum(e) / count(*)) AS e FROM (SELECT c, unnest(range(1, 65)) AS i, unnest(x) AS e FROM n{n} JOIN v USING (vec_id)) GROUP BY c, i),
c{n + 1} AS MATERIALIZED (SELECT c, coalesce(new, x) AS x FROM c{n} LEFT JOIN (SELECT c, list(CAST(e AS BIGINT) ORDER BY i) AS new FROM m{n} GROUP BY c) USING (c)),"""


# Every vec_id of the table stands once in it.
CENTROIDS = f"""
WITH v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: CAST(floor(64 * CAST(e AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR))) - 1 AS c, x FROM v ORDER BY sha256('1:' || CAST(vec_id AS VARCHAR)) LIMIT 16),
{_assigned(0)}{_assigned(1)}{_assigned(2)}
last AS (SELECT vec_id, arg_min(c, [dist, c]) AS c, min(dist) AS dist FROM (
  SELECT vec_id, c, list_sum(list_transform(list_zip(v.x, k.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS dist FROM v, c3 k) GROUP BY vec_id)
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(dist AS BIGINT) AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(dist) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c3.x, ',')) AS centroid_sha256 FROM last JOIN c3 USING (c)
"""

ORACLES = {
    "op2_jaccard_join": JACCARD,
    "op3_benchmark_decontamination": CONTAMINATION,
    "op5_substring_dedup": SUBSTRINGS,
    "op6_url_filters": URLS,
    "op8_secret_scans": SECRETS,
    "op9_quality_rules": QUALITY,
    "op11_centroid_clustering": CENTROIDS,
    "op13_fill_in_middle": MIDDLE,
}
