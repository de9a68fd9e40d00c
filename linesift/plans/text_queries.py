"""Queries whose result is a whole text for each output."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lines
from ..streaming import session
from ..views.compact import compact_outputs
from ..views.slim import slim_outputs
from ..views.text import Config, view_config
from . import log_queries
from .rank_queries import printed_outputs
from .registry import query, table
from .search_queries import PRINTED, found, search, url_paths


# What is left of a text, if it is large and gets a tenth smaller; else it is passed on. From lg, body and dr (drops, j).
PASSED_ON = """rw AS (SELECT output_id, string_agg(text, chr(10) ORDER BY seq) AS raw FROM lg GROUP BY 1),
wh AS (SELECT rw.output_id, raw, (length(raw) + 3) // 4 AS raw_tokens, body || chr(10) || '[linesift] not shown: ' || drops || '.' AS t, j FROM rw LEFT JOIN body USING (output_id) LEFT JOIN dr USING (output_id)),
gd AS (SELECT *, coalesce(raw_tokens > 500 AND (length(t) + 3) // 4 <= raw_tokens * 0.9, false) AS good FROM wh)
SELECT output_id, CASE WHEN good THEN t ELSE raw END AS text, raw_tokens, CASE WHEN good THEN (length(t) + 3) // 4 ELSE raw_tokens END AS tokens, CASE WHEN good THEN j ELSE '{"level":"L0"}' END AS stats FROM gd"""


def search_outputs(spark, sf_dir):
    """Search results as raw text, one for each directory: bounded texts, as a tool would print them."""
    s = search(spark, sf_dir, 1, 1)
    rows = s.withColumn("output_id", F.regexp_extract("path", "^(.*/[^/]*?)[0-9]?[0-9][.]txt$", 1))
    row = lines.printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), 1_000_000)
    return printed_outputs(rows.select("output_id", "seq", row.alias("line")))


@query()
def slim_lossless(spark, sf_dir):
    return slim_outputs(search_outputs(spark, sf_dir), view_config("lossless"))


# The rows of search_outputs, each output's files in one directory; then the sums from which each output's step is chosen.
NOTES = f"""{found(1, 1)}, x AS (SELECT regexp_extract(path, '^(.*/[^/]*?)[0-9]?[0-9][.]txt$', 1) AS o, path, number, text, is_match, seq FROM s),
pr AS (SELECT *, {PRINTED} AS line, number - coalesce(lag(number) OVER (PARTITION BY o, path ORDER BY number), number) > 1 AS gap FROM x),
bl AS (SELECT *, length(line) + 1 AS chars, sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY o, path ORDER BY number) AS block FROM pr),
raw AS (SELECT o, string_agg({PRINTED.replace('length(text) <= 300', 'true')}, chr(10) ORDER BY seq) AS raw, count(*) AS n FROM x GROUP BY o),
fa AS (SELECT o, sum(chars) - 1 + CASE WHEN bool_or(NOT is_match) THEN 3 * (count(DISTINCT path || ':' || block) - 1) ELSE 0 END AS whole, coalesce(sum(chars) FILTER (is_match), 0) - 1 AS bare,
  bool_or(NOT is_match) AS context, count(*) FILTER (is_match) AS total, count(DISTINCT path) FILTER (is_match) AS files, count(DISTINCT path) AS every FROM bl GROUP BY o),
rk AS (SELECT *, row_number() OVER (PARTITION BY o, path ORDER BY number) AS rank FROM bl WHERE is_match),
sz AS (SELECT o, rank, sum(sum(chars)) OVER (PARTITION BY o ORDER BY rank) - 1 AS size FROM rk GROUP BY o, rank),
cp AS (SELECT o, greatest(coalesce(max(rank) FILTER ((size + 3) // 4 + 210 <= 600), 0), max(CASE WHEN files = 1 THEN 1 ELSE 8 END)) AS cap FROM sz JOIN fa USING (o) GROUP BY o),
kp AS (SELECT rk.*, cap FROM rk JOIN cp USING (o) WHERE rank <= cap),
ks AS (SELECT o, sum(chars) - 1 AS capped, count(*) AS lefts FROM kp GROUP BY o),
fc AS (SELECT o, path, min(seq) AS first, (sum(chars) - 1 + 3) // 4 + 1 AS cost FROM kp GROUP BY o, path),
st AS (SELECT o, path FROM (SELECT *, sum(cost) OVER w AS used, row_number() OVER w AS place FROM fc WINDOW w AS (PARTITION BY o ORDER BY first, path ROWS UNBOUNDED PRECEDING)) WHERE place = 1 OR used <= 390),
lv AS (SELECT fa.*, cap, lefts, CASE WHEN (whole + 3) // 4 <= 600 THEN 0 WHEN (bare + 3) // 4 <= 600 THEN 1 WHEN (capped + 3) // 4 <= 600 THEN 2 ELSE 3 END AS level FROM fa JOIN cp USING (o) JOIN ks USING (o)),
sh AS (SELECT bl.*, level FROM bl JOIN lv USING (o) LEFT JOIN rk ON rk.o = bl.o AND rk.path = bl.path AND rk.number = bl.number LEFT JOIN st ON st.o = bl.o AND st.path = bl.path
  WHERE level = 0 OR (bl.is_match AND (level = 1 OR (rk.rank <= cap AND (level = 2 OR st.path IS NOT NULL))))),
b0 AS (SELECT *, number - coalesce(lag(number) OVER (PARTITION BY o, path ORDER BY number), number) > 1 AS cut FROM sh),
b1 AS (SELECT *, min(seq) OVER (PARTITION BY o, path) AS first, sum(CASE WHEN cut THEN 1 ELSE 0 END) OVER (PARTITION BY o, path ORDER BY number) AS nb FROM b0),
b2 AS (SELECT o, first, path, nb, string_agg(line, chr(10) ORDER BY number) AS t, bool_or(NOT is_match) AS c, count(*) AS n, count(*) FILTER (is_match) AS m FROM b1 GROUP BY 1, 2, 3, 4),
bd AS (SELECT o, CASE WHEN bool_or(c) THEN string_agg(t, chr(10) || '--' || chr(10) ORDER BY first, path, nb) ELSE string_agg(t, chr(10) ORDER BY first, path, nb) END AS body, sum(n) + CASE WHEN bool_or(c) THEN count(*) - 1 ELSE 0 END AS lines, sum(m) AS shown FROM b2 GROUP BY o),
ms AS (SELECT o, path, min(seq) AS seq, count(*) - coalesce(any_value(k), 0) AS n FROM bl LEFT JOIN (SELECT o, path, count(*) AS k FROM sh WHERE is_match GROUP BY 1, 2) USING (o, path) WHERE is_match GROUP BY o, path HAVING count(*) - coalesce(any_value(k), 0) > 0),
mr AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY seq, path) AS place FROM ms),
mt AS (SELECT o, string_agg(path || ' (' || n || ')', ', ' ORDER BY place) FILTER (place <= 10) || CASE WHEN count(*) > 10 THEN '; ' || (count(*) - 10) || ' more files by directory: ' || any_value(regexp_extract(path, '^(.*)/', 1)) || '/ (' || CAST(sum(n) FILTER (place > 10) AS BIGINT) || ')' ELSE '' END AS missing FROM mr GROUP BY o),
sp AS (SELECT lv.*, list_filter([CASE WHEN level >= 1 AND context THEN 'context lines dropped' END, CASE WHEN level >= 2 AND lefts < total THEN 'max ' || cap || ' matches per file' END,
  CASE WHEN level = 3 AND (SELECT count(*) FROM st WHERE st.o = lv.o) < files THEN 'files dropped from the end' END], lambda z: z IS NOT NULL) AS steps FROM lv),
tx AS (SELECT o, raw, body || CASE WHEN len(steps) > 0 THEN chr(10) || '[linesift] ' || n || ' -> ' || CAST(lines AS BIGINT) || ' lines, ' || CAST(shown AS BIGINT) || '/' || total || ' matches shown, ' || array_to_string(steps, '; ') || '.' || CASE WHEN missing IS NULL THEN '' ELSE ' Not shown: ' || missing || '.' END ELSE '' END AS t,
  '{{"kind":"content","matches_total":"' || total || '","files_total":"' || every || '","matches_kept":"' || CAST(shown AS BIGINT) || '","steps":"' || array_to_string(steps, ', ') || '"}}' AS stats FROM sp JOIN bd USING (o) JOIN raw USING (o) LEFT JOIN mt USING (o))"""


@query(f"""WITH {NOTES} SELECT o AS output_id, CASE WHEN (length(t) + 3) // 4 < (length(raw) + 3) // 4 THEN t ELSE raw END AS text, (length(raw) + 3) // 4 AS raw_tokens,
  least((length(t) + 3) // 4, (length(raw) + 3) // 4) AS tokens, stats FROM tx""")
def slim_notes(spark, sf_dir):
    return slim_outputs(search_outputs(spark, sf_dir), Config(max_tokens=600, view="notes"))


@query()
def slim_coverage(spark, sf_dir):
    rows = search_outputs(spark, sf_dir).withColumn("intent", F.lit("err thnt erth")).withColumn("pattern", F.lit("the"))
    return slim_outputs(rows, Config(max_tokens=600, view="coverage"))


@query()
def slim_paths(spark, sf_dir):
    rows = url_paths(spark, sf_dir).select(F.regexp_extract("path", "^([^/]*)", 1).alias("output_id"), "seq", F.col("path").alias("line"))
    return slim_outputs(printed_outputs(rows), Config(max_tokens=300, view="notes"))


@query(log_queries.DIAGS + """, d1 AS (SELECT *, row_number() OVER (PARTITION BY output_id, path, pos, message ORDER BY seq) AS r FROM dg), f AS (SELECT * FROM d1 WHERE r = 1),
g AS (SELECT output_id, message, min(seq) AS lead_, count(*) AS n, sum(length(text) + 1) AS chars, sum(length(pos) + 1) AS pc FROM f GROUP BY 1, 2), pp AS (SELECT output_id, message, sum(length(path) + 2) AS pl FROM (SELECT DISTINCT output_id, message, path FROM f) GROUP BY 1, 2),
ok AS (SELECT output_id, message, lead_ FROM g JOIN pp USING (output_id, message) WHERE n >= 3 AND pc + pl + length(message) + 60 < chars),
lb AS (SELECT output_id, seq, 'duplicate diagnostic lines' AS label FROM d1 WHERE r > 1 UNION ALL SELECT f.output_id, seq, 'repeated diagnostic lines' FROM f JOIN ok USING (output_id, message) WHERE seq <> lead_),
w AS (SELECT f.output_id, f.message, lead_, path, min(seq) AS first, count(*) AS n, path || ' ' || string_agg(pos, ' ' ORDER BY seq) AS t FROM f JOIN ok USING (output_id, message) WHERE seq <> lead_ GROUP BY 1, 2, 3, 4),
nt AS (SELECT output_id, lead_ + 0.5 AS sq, '[linesift] ' || CAST(sum(n) AS BIGINT) || ' more places with this same diagnostic (' || message || '): ' || string_agg(t, '; ' ORDER BY first) AS text FROM w GROUP BY output_id, message, lead_),
kept AS (SELECT output_id, CAST(seq AS DOUBLE) AS sq, text FROM lg ANTI JOIN lb USING (output_id, seq) UNION ALL SELECT * FROM nt), body AS (SELECT output_id, string_agg(text, chr(10) ORDER BY sq, text) AS body FROM kept GROUP BY 1),
sums AS (SELECT output_id, label, count(*) AS n, min(seq) AS first FROM lb GROUP BY 1, 2), dr AS (SELECT output_id, string_agg(n || ' ' || label, ', ' ORDER BY first, label) AS drops, '{"dropped":{' || string_agg('"' || label || '":' || n, ',' ORDER BY first, label) || '}}' AS j FROM sums GROUP BY 1),
""" + PASSED_ON)
def compact_diagnostics(spark, sf_dir):
    rows = log_queries.diag_log(spark, sf_dir).select("output_id", "seq", F.col("text").alias("line"))
    return compact_outputs(printed_outputs(rows))


@query(f"""WITH {log_queries.EVENTS}, lg AS (SELECT * FROM ev), k AS (SELECT *, 'T' || substr(text, 20) AS key FROM ev), r AS (SELECT *, sum(CASE WHEN key = p THEN 0 ELSE 1 END) OVER (PARTITION BY output_id ORDER BY seq) AS run FROM (SELECT *, lag(key) OVER (PARTITION BY output_id ORDER BY seq) AS p FROM k)),
z AS (SELECT *, count(*) OVER (PARTITION BY output_id, run) AS size, row_number() OVER (PARTITION BY output_id, run ORDER BY seq) AS place FROM r),
body AS (SELECT output_id, string_agg(CASE WHEN size >= 5 AND place = 1 THEN text || chr(10) || '[linesift] ' || (size - 2) || ' similar lines not shown' ELSE text END, chr(10) ORDER BY seq) AS body FROM z WHERE size < 5 OR place = 1 OR place = size GROUP BY 1),
dr AS (SELECT output_id, CAST(sum(size - 2) AS BIGINT) || ' similar repeated lines' AS drops, '{{"dropped":{{"similar repeated lines":' || CAST(sum(size - 2) AS BIGINT) || '}}}}' AS j FROM z WHERE size >= 5 AND place = 1 GROUP BY 1),
""" + PASSED_ON)
def compact_event_logs(spark, sf_dir):
    rows = log_queries.event_log(spark, sf_dir).select("output_id", "seq", F.col("text").alias("line"))
    return compact_outputs(printed_outputs(rows))


@query("SELECT 's' || user_id AS session, CAST(event_id AS VARCHAR) AS key FROM (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS last FROM events) WHERE event_type <> 'purchase' AND (last IS NULL OR event_id > last)")
def session_replay(spark, sf_dir):
    """The state that the streaming operator ends with, replayed in batch: what each session still holds as shown."""
    rows = table(spark, sf_dir, "events").select(
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session"), F.when(F.col("event_type") == "purchase", "edit").otherwise("shown").alias("kind"), F.lit("f").alias("file"),
        F.col("event_id").cast("string").alias("key"), F.col("event_id").alias("ns"),
    )
    return session.replay(rows).select("session", "key")
