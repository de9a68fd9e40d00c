"""DuckDB SQL for the rows of those queries that SQL can express."""

OP1 = r"""
WITH item AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, list_slice(w, i, i + least(len(w), 8) - 1) AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8 + 1, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT len(t) AS n FROM win),
doc AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
  FROM documents),
grams AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, sizes WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, n, item_id FROM grams JOIN win USING (t)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM doc LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""

_KIND = r"""
  SELECT doc_id, {rank} AS r, '{kind}' AS kind, s, s + length(m) AS e, size
  FROM (SELECT doc_id, unnest(ms) AS m, unnest(ks) AS size,
          unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))) AS s
        FROM (SELECT doc_id, regexp_extract_all(t, {re}) AS ms, list_transform(regexp_extract_all(t, {re}, {group}), lambda g: length(g)) AS ks, regexp_split_to_array(t, {re}) AS gs
              FROM d WHERE regexp_matches(t, {re})))
"""

_ASSIGN = r"""'((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'"""

OP4 = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), hit AS (SELECT * FROM (\n"
    + " UNION ALL ".join(
        _KIND.format(rank=rank, kind=kind, re=pattern, group=group)
        for rank, (kind, pattern, group) in enumerate(
            [
                ("assign", _ASSIGN, 2),
                ("access", "'AKIA[A-Z0-9]+'", 0),
                ("hex", "'[0-9a-f]+'", 0),
                ("pem", "'-----BEGIN [A-Z ]*PRIVATE KEY-----'", 0),
                ("jwt", r"'eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+'", 0),
            ]
        )
    )
    + """) WHERE size >= CASE kind WHEN 'assign' THEN 12 WHEN 'access' THEN 18 WHEN 'hex' THEN 16 ELSE 0 END),
g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  string_agg(CASE WHEN r < 3 THEN kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) END, ',' ORDER BY s, r) AS base,
  string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT), ',' ORDER BY s, r) AS spans FROM hit GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
)

OP5 = r"""
WITH rest AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest),
rules(verdict, h, q) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (SELECT page_id, arg_max(h || q, length(h || q)) AS rule, arg_max(verdict, length(h || q)) AS v
  FROM p JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, q) GROUP BY page_id)
SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN best USING (page_id)
"""

OP6 = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, md5(array_to_string(list_slice(w, i, i + 3), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n, min(h) AS least, bit_xor(hash(h)) AS x, sum(hash(h)) AS y FROM sh GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY n, least, x, y) AS rep FROM n),
rep AS (SELECT doc_id, n FROM class WHERE doc_id = rep),
held AS (SELECT doc_id, n, h FROM sh JOIN rep USING (doc_id)),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM held a JOIN held b ON a.h = b.h AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  GROUP BY a.doc_id, a.n, b.doc_id, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(a, b) AS (SELECT doc_id, doc_id FROM rep UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
root AS (SELECT a AS rep, min(b) AS root FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, d.doc_id) AS component_id, coalesce(root, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN class USING (doc_id) LEFT JOIN root USING (rep)
"""

OP7 = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(list_slice(w, i, i + 49), ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
first AS (SELECT h, min(doc_id) AS m FROM win GROUP BY h),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN first USING (h) WHERE m < doc_id) GROUP BY doc_id),
word AS (SELECT d.doc_id, unnest(w) AS x, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT word.doc_id, string_agg(x, ' ' ORDER BY p) AS s FROM word ANTI JOIN (SELECT doc_id, unnest(ps) AS p FROM gone) g USING (doc_id, p) GROUP BY word.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP8 = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))
"""

OP9 = r"""
WITH l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
many AS (SELECT key, min(doc_id) AS m FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
f AS (SELECT doc_id, i, line, m IS NOT NULL AND m <> doc_id AS gone FROM k LEFT JOIN many USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM f GROUP BY doc_id
"""

ORACLES = {
    "op1_decontamination": OP1,
    "op4_secret_scan": OP4,
    "op5_url_filter": OP5,
    "op6_near_dedup": OP6,
    "op7_substring_dedup": OP7,
    "op8_exact_dedup": OP8,
    "op9_line_dedup": OP9,
}
