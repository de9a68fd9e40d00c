"""Queries over search results: grep over the corpus, and what reduces its output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clip, tokens
from ..operators import coverage, lines, lossless, paths
from ..sources import corpus
from .registry import query, table

PATTERN = "(?i)the "
BUDGET = 2000

FILES = """
ff AS (SELECT coalesce(source, '') AS output_id, doc_id, concat_ws('/', lang, source, CAST(doc_id AS VARCHAR) || '.txt') AS path,
  CASE WHEN text = '' THEN [] WHEN ends_with(text, chr(10)) THEN string_split(left(text, length(text) - 1), chr(10)) ELSE string_split(text, chr(10)) END AS ls
  FROM documents WHERE text IS NOT NULL),
l AS (SELECT output_id, path, doc_id, unnest(ls) AS text, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS number FROM ff)"""


def found(before: int = 0, after: int = 0, pattern: str = PATTERN) -> str:
    """SQL of the search result s: output_id, path, number, text, is_match, seq."""
    return f"""{FILES},
h AS (SELECT *, regexp_matches(text, '{pattern}') AS is_match, doc_id * 1000000 + number AS seq FROM l),
s AS (SELECT output_id, path, number, text, is_match, seq FROM (SELECT *, max(CAST(is_match AS INT)) OVER (PARTITION BY path ORDER BY number RANGE BETWEEN {after} PRECEDING AND {before} FOLLOWING) AS near FROM h) WHERE near = 1)"""


PRINTED = "CASE WHEN path = '' THEN '' ELSE path || CASE WHEN is_match THEN ':' ELSE '-' END END || number || CASE WHEN is_match THEN ':' ELSE '-' END || CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || '…[+' || (length(text) - 300) || ' chars]' END"
BLOCKS = "bl AS (SELECT *, CAST(sum(CASE WHEN number - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, path ORDER BY number) AS BIGINT) AS block FROM (SELECT *, lag(number) OVER (PARTITION BY output_id, path ORDER BY number) AS prev FROM s))"


def search(spark: SparkSession, sf_dir: str, before: int = 0, after: int = 0, pattern: str = PATTERN) -> DataFrame:
    return corpus.grep(table(spark, sf_dir, "documents"), pattern, before, after)


def url_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as files: output_id (the scheme), seq, path (host and path), n = 1."""
    rows = table(spark, sf_dir, "pages").filter(F.col("url").contains("://"))
    return rows.select(F.regexp_extract("url", "^([a-z]+)://", 1).alias("output_id"), F.col("page_id").alias("seq"), F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), F.lit(1).cast("bigint").alias("n"))


URLS = "u AS (SELECT regexp_extract(url, '^([a-z]+)://', 1) AS output_id, page_id AS seq, regexp_extract(url, '://([^?#]*)', 1) AS path, CAST(1 AS BIGINT) AS n FROM pages WHERE contains(url, '://'))"


@query(f"""WITH {found(2, 1)}, {BLOCKS},
f AS (SELECT output_id, path, min(seq) AS seq, count(*) FILTER (is_match) AS matches, min(number) AS first, max(number) AS last, count(DISTINCT block) AS blocks,
  min(CASE WHEN is_match AND length(text) > 200 THEN number END) AS long_match, (sum(length({PRINTED}) + 1) - 1 + 3) // 4 + 1 AS cost FROM bl GROUP BY output_id, path),
c AS (SELECT *, sum(cost) OVER w AS total, row_number() OVER w AS place FROM f WINDOW w AS (PARTITION BY output_id ORDER BY seq ROWS UNBOUNDED PRECEDING))
SELECT output_id, path, matches, first, last, blocks, long_match, CAST(cost AS BIGINT) AS cost, round(cost / 2000.0, 6) AS share FROM c WHERE total <= 2000 OR place = 1""")
def search_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which files match, how often and where, and what share of the budget they cost: the files of each output that fit it."""
    rows = lines.with_blocks(search(spark, sf_dir, 2, 1))
    chars = F.sum(F.char_length(lines.printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"))) + 1)
    files = rows.groupBy("output_id", "path").agg(
        F.min("seq").alias("seq"), F.count_if("is_match").alias("matches"), F.min("number").alias("first"), F.max("number").alias("last"), F.count_distinct("block").alias("blocks"),
        F.min(F.when(F.col("is_match") & (F.char_length("text") > 200), F.col("number"))).alias("long_match"), (F.floor((chars - 1 + 3) / 4) + 1).cast("bigint").alias("cost"),
    )
    kept = lines.prefix_budget(files, ["seq"], "cost", BUDGET).filter("kept")
    return kept.select("output_id", "path", "matches", "first", "last", "blocks", "long_match", "cost", F.round(F.col("cost") / 2000.0, 6).alias("share"))


@query(f"WITH {found()} SELECT output_id, path, number, text FROM s")
def grep_matches(spark, sf_dir):
    return search(spark, sf_dir).select("output_id", "path", "number", "text")


@query(f"WITH {found(2, 1)} SELECT path, number, text, is_match FROM s")
def grep_context(spark, sf_dir):
    return search(spark, sf_dir, 2, 1).select("path", "number", "text", "is_match")


@query(f"WITH {found()} SELECT output_id, path, count(*) AS n FROM s GROUP BY output_id, path")
def grep_counts(spark, sf_dir):
    return search(spark, sf_dir).groupBy("output_id", "path").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {found()} SELECT DISTINCT output_id, path FROM s")
def files_with_matches(spark, sf_dir):
    return search(spark, sf_dir).select("output_id", "path").distinct()


@query(r"SELECT coalesce(source, '') AS output_id, concat_ws('/', lang, source, CAST(doc_id AS VARCHAR) || '.txt') AS path, len(regexp_extract_all(text, '(?s)the .{0,40}\n.{0,20}th')) AS hits FROM documents WHERE regexp_matches(text, '(?s)the .{0,40}\n.{0,20}th')")
def grep_multiline(spark, sf_dir):
    return corpus.grep_text(table(spark, sf_dir, "documents"), r"the .{0,40}\n.{0,20}th")


@query(f"WITH {found()} SELECT path, number FROM (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY seq) AS r FROM s) WHERE r > 5 AND r <= 25")
def head_limit_offset(spark, sf_dir):
    """Rows 6 to 25 of each output."""
    order = Window.partitionBy("output_id").orderBy("seq")
    return search(spark, sf_dir).withColumn("r", F.row_number().over(order)).filter("r <= 25").filter("r > 5").select("path", "number")


TWICE = "t AS (SELECT * FROM s UNION ALL SELECT output_id, path, number, text, NOT is_match AS is_match, seq + 500000 AS seq FROM s WHERE length(text) > 100)"


@query(f"""WITH {found(1, 1)}, {TWICE}
SELECT output_id, path, number, min(seq) AS seq, arg_min(text, (NOT is_match, seq)) AS text, bool_or(is_match) AS is_match FROM t GROUP BY output_id, path, number""")
def dedupe_match_wins(spark, sf_dir):
    s = search(spark, sf_dir, 1, 1)
    again = s.filter(F.char_length("text") > 100).withColumn("seq", F.col("seq") + 500000).withColumn("is_match", ~F.col("is_match"))
    return lines.dedupe_lines(s.unionByName(again)).select("output_id", "path", "number", "seq", "text", "is_match")


def _blocks_sql(gap: int, source: str = "s") -> str:
    return f"""b AS (SELECT *, sum(CASE WHEN number - prev > {gap + 1} THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, path ORDER BY number) AS g
  FROM (SELECT *, lag(number) OVER (PARTITION BY output_id, path ORDER BY number) AS prev FROM {source}))
SELECT output_id, path, CAST(g AS BIGINT) AS block, min(number) AS first, max(number) AS last, count(*) AS lines, count(*) FILTER (is_match) AS matches FROM b GROUP BY output_id, path, g"""


@query(f"WITH {found(2, 1)}, {_blocks_sql(0)}")
def blocks_islands(spark, sf_dir):
    return lines.blocks(search(spark, sf_dir, 2, 1))


@query(f"WITH {found()}, {_blocks_sql(2)}")
def blocks_gap2(spark, sf_dir):
    return lines.blocks(search(spark, sf_dir), gap=2)


@query(f"WITH {found(2, 1)}, m AS (SELECT * FROM s WHERE is_match), {_blocks_sql(0, 'm')}")
def drop_context(spark, sf_dir):
    return lines.blocks(lines.drop_context(search(spark, sf_dir, 2, 1)))


@query(f"""WITH {found(2, 1)}, {BLOCKS}, r AS (SELECT output_id, path, min(number) AS a, max(number) AS b FROM bl GROUP BY output_id, path, block)
SELECT output_id, path, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ',' ORDER BY a) AS ranges FROM r GROUP BY output_id, path""")
def line_ranges(spark, sf_dir):
    return lines.ranges(search(spark, sf_dir, 2, 1))


@query(f"WITH {found()} SELECT path, number, CASE WHEN length(text) <= 80 THEN text ELSE left(text, 80) || '…[+' || (length(text) - 80) || ' chars]' END AS text FROM s")
def clip_long_lines(spark, sf_dir):
    return search(spark, sf_dir).select("path", "number", clip(F.col("text"), 80).alias("text"))


@query("SELECT doc_id, (length(text) + 3) // 4 AS tokens, (length(text) + 3) // 4 <= 500 AS passes FROM documents")
def token_estimate(spark, sf_dir):
    """The size gate: outputs at or below the trigger pass unchanged."""
    return table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"), (tokens(F.col("text")) <= 500).alias("passes"))


@query(f"""WITH {found(1, 1)}, r AS (SELECT *, CASE WHEN is_match THEN count(*) FILTER (is_match) OVER (PARTITION BY output_id, path ORDER BY number) END AS rank FROM s),
o AS (SELECT *, max(rank) OVER (PARTITION BY output_id, path) > 3 AS over_ FROM r), k AS (SELECT * FROM o WHERE rank IS NULL OR rank <= 3),
i AS (SELECT *, sum(CASE WHEN number - prev > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, path ORDER BY number) AS block FROM (SELECT *, lag(number) OVER (PARTITION BY output_id, path ORDER BY number) AS prev FROM k)),
w AS (SELECT *, bool_or(is_match) OVER (PARTITION BY output_id, path, block) AS holds FROM i)
SELECT output_id, path, number, text, is_match FROM w WHERE holds OR NOT coalesce(over_, false)""")
def cap_per_file(spark, sf_dir):
    return lines.cap_matches(search(spark, sf_dir, 1, 1), 3).select("output_id", "path", "number", "text", "is_match")


@query(f"""WITH {found()}, r AS (SELECT *, row_number() OVER (PARTITION BY output_id, path ORDER BY number) AS rank, length({PRINTED}) + 1 AS chars FROM s),
o AS (SELECT output_id, count(DISTINCT path) AS files, max(rank) AS most FROM r GROUP BY output_id),
z AS (SELECT output_id, rank, sum(sum(chars)) OVER (PARTITION BY output_id ORDER BY rank) - 1 AS size FROM r GROUP BY output_id, rank),
f AS (SELECT output_id, CASE WHEN files = 1 THEN 1 ELSE 2 END AS lowest, rank, size, most FROM z JOIN o USING (output_id))
SELECT output_id, CAST(greatest(max(CASE WHEN (size + 3) // 4 + 210 <= 60000 AND rank <= greatest(lowest, most - 1) THEN rank END), max(lowest)) AS BIGINT) AS cap FROM f GROUP BY output_id""")
def budget_cap(spark, sf_dir):
    """The largest number of matches a file that fits 60,000 tokens, at least 2."""
    return lines.budget_cap(search(spark, sf_dir), 60_000, floor=2)


FILE_COSTS = f"""fc AS (SELECT output_id, path, min(seq) AS first, count(*) FILTER (is_match) AS matches,
  (sum(length({PRINTED}) + 1) - 1 + CASE WHEN bool_or(NOT is_match) THEN 3 * max(block) ELSE 0 END + 3) // 4 + 1 AS cost FROM bl GROUP BY output_id, path)"""


@query(f"""WITH {found(2, 1)}, {BLOCKS}, {FILE_COSTS}, c AS (SELECT *, sum(cost) OVER w AS total, row_number() OVER w AS place FROM fc WINDOW w AS (PARTITION BY output_id ORDER BY first, path ROWS UNBOUNDED PRECEDING))
SELECT output_id, path, first, CAST(cost AS BIGINT) AS cost, matches FROM c WHERE place = 1 OR total <= 1790""")
def file_prefix_budget(spark, sf_dir):
    return lines.file_prefix(search(spark, sf_dir, 2, 1), BUDGET)


def _prefix_sql(rows: str, budget: int) -> str:
    return f"SELECT output_id, seq, row FROM (SELECT *, sum((length(row) + 3) // 4 + 1) OVER w AS total, row_number() OVER w AS place FROM ({rows}) WINDOW w AS (PARTITION BY output_id ORDER BY seq ROWS UNBOUNDED PRECEDING)) WHERE place = 1 OR total <= {budget}"


def _prefix(rows: DataFrame, budget: int) -> DataFrame:
    rows = rows.withColumn("cost", tokens(F.col("row")) + 1)
    return lines.prefix_budget(rows, ["seq"], "cost", budget, least_cost=1).filter("kept").select("output_id", "seq", "row")


@query(f"WITH {URLS} {_prefix_sql('SELECT output_id, min(seq) AS seq, path AS row FROM u GROUP BY output_id, path', 940)}")
def path_prefix_budget(spark, sf_dir):
    rows = paths.distinct_paths(url_paths(spark, sf_dir)).withColumnRenamed("path", "row")
    return _prefix(rows, 940)


@query(f"WITH {found()} {_prefix_sql('SELECT output_id, min(seq) AS seq, path || chr(58) || count(*) AS row FROM s GROUP BY output_id, path', 460)}")
def count_prefix_budget(spark, sf_dir):
    rows = search(spark, sf_dir).groupBy("output_id", "path").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    return _prefix(rows.select("output_id", "seq", F.concat_ws(":", "path", F.col("n").cast("string")).alias("row")), 460)


@query(f"WITH {FILES} {_prefix_sql('SELECT output_id, doc_id * 1000000 + number AS seq, CASE WHEN length(text) <= 300 THEN text ELSE left(text, 300) || chr(8230) || chr(91) || chr(43) || (length(text) - 300) || chr(32) || chr(99) || chr(104) || chr(97) || chr(114) || chr(115) || chr(93) END AS row FROM l', 840)}")
def row_prefix_budget(spark, sf_dir):
    rows = corpus.corpus_lines(table(spark, sf_dir, "documents"))
    return _prefix(rows.select("output_id", "seq", clip(F.col("text"), 300).alias("row")), 840)


SPELT = "k AS (SELECT output_id, path, seq, count FROM (SELECT output_id, path, min(seq) AS seq, count(*) AS count FROM s GROUP BY output_id, path) UNION ALL SELECT output_id, './' || path, max(seq) + 5, 2 * count(*) FROM s GROUP BY output_id, path)"


def spelt_twice(spark, sf_dir):
    rows = search(spark, sf_dir).groupBy("output_id", "path").agg(F.min("seq").alias("seq"), F.max("seq").alias("last"), F.count(F.lit(1)).alias("count"))
    again = rows.select("output_id", F.concat(F.lit("./"), "path").alias("path"), (F.col("last") + 5).alias("seq"), (F.col("count") * 2).alias("count"))
    return rows.drop("last").unionByName(again)


@query(f"WITH {found()}, {SPELT} SELECT output_id, regexp_replace(path, '^\\./', '') AS path, max(count) AS count, min(seq) AS seq FROM k GROUP BY 1, 2")
def counts_max(spark, sf_dir):
    return lossless.merge_counts(spelt_twice(spark, sf_dir), "max")


@query(f"WITH {found()}, {SPELT} SELECT output_id, regexp_replace(path, '^\\./', '') AS path, arg_min(count, seq) AS count, min(seq) AS seq FROM k GROUP BY 1, 2")
def counts_first(spark, sf_dir):
    return lossless.merge_counts(spelt_twice(spark, sf_dir), "first")


def _rollup_sql(rows: str, limit: int) -> str:
    """Directory roll-up of rows (output_id, seq, path, n), each depth written out."""
    return f"""d AS (SELECT output_id, CASE WHEN path LIKE '%/%' THEN regexp_extract(path, '^(.*)/[^/]*$', 1) ELSE '.' END AS dir, sum(n) AS n, min(seq) AS seq FROM ({rows}) GROUP BY 1, 2),
p AS (SELECT output_id, string_split(dir, '/') AS parts, n, seq FROM d), m AS (SELECT output_id, max(len(parts)) - 1 AS deepest FROM p GROUP BY output_id),
c AS (SELECT output_id, parts, n, seq, unnest(range(0, deepest + 1)) AS depth FROM p JOIN m USING (output_id)),
g AS (SELECT output_id, depth, array_to_string(parts[1:depth + 1], '/') AS dir, sum(n) AS n, min(seq) AS seq FROM c GROUP BY 1, 2, 3),
k AS (SELECT output_id, depth, count(*) AS groups, lag(count(*)) OVER (PARTITION BY output_id ORDER BY depth) AS up FROM g GROUP BY 1, 2),
st AS (SELECT output_id, max(depth) AS depth, arg_max(groups > {limit}, depth) AS big FROM k WHERE groups <= {limit} OR depth = 0 OR (up < 3 AND groups > 3) GROUP BY output_id),
o AS (SELECT output_id, dir, n, seq, big, row_number() OVER (PARTITION BY output_id ORDER BY CASE WHEN big AND depth > 0 THEN -n ELSE 0 END, seq, dir) AS r FROM g JOIN st USING (output_id, depth))
SELECT output_id, CASE WHEN big THEN least(r, {limit}) ELSE r END AS place, CASE WHEN bool_or(big) AND min(r) >= {limit} THEN '+' || count(*) || ' other dirs' ELSE min(dir) END AS dir, CAST(sum(n) AS BIGINT) AS n FROM o GROUP BY 1, 2"""


@query(f"WITH {URLS}, {_rollup_sql('SELECT * FROM u', 10)}")
def dir_rollup(spark, sf_dir):
    return paths.rollup_dirs(url_paths(spark, sf_dir), 10)


@query(f"WITH {found()}, {_rollup_sql('SELECT output_id, path, min(seq) AS seq, count(*) AS n FROM s GROUP BY 1, 2', 3)}")
def dir_rollup_search(spark, sf_dir):
    """Omitted matches by directory, three directories at most."""
    rows = search(spark, sf_dir).groupBy("output_id", "path").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    return paths.rollup_dirs(rows, 3)


@query(f"""WITH {URLS}, r AS (SELECT output_id, path, min(seq) AS seq FROM u GROUP BY 1, 2), d AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir FROM r),
z AS (SELECT *, min(seq) OVER w AS dir_seq, count(*) FILTER (dir <> path) OVER w AS files FROM d WINDOW w AS (PARTITION BY output_id, dir))
SELECT output_id, dir_seq, seq, CASE WHEN dir <> '' AND files >= 2 AND dir <> path THEN '  ' || substr(path, length(dir) + 1) ELSE path END AS row FROM z
UNION ALL SELECT DISTINCT output_id, dir_seq, CAST(0 AS BIGINT), dir FROM z WHERE dir <> '' AND files >= 2""")
def group_paths_by_dir(spark, sf_dir):
    return paths.grouped_paths(paths.distinct_paths(url_paths(spark, sf_dir)))


@query(f"""WITH {found()}, k AS (SELECT output_id, path, min(seq) AS seq, count(*) AS count FROM s GROUP BY 1, 2), d AS (SELECT *, regexp_extract(path, '^(.*/)', 1) AS dir FROM k)
SELECT output_id, seq, path, CASE WHEN dir <> '' AND count(*) OVER (PARTITION BY output_id, dir) >= 2 THEN '  ' || substr(path, length(dir) + 1) ELSE path END || ':' || count AS row FROM d""")
def group_counts_by_dir(spark, sf_dir):
    rows = search(spark, sf_dir).groupBy("output_id", "path").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("count"))
    return lossless.grouped_rows(rows)


# A tree listing of the pages: host, language, page.
TREE = f"""{URLS}, q AS (SELECT DISTINCT output_id, string_split(path, '/')[1] AS a, string_split(path, '/')[2] AS b, string_split(path, '/')[3] AS c FROM u),
e AS (SELECT DISTINCT output_id, a AS k1, '' AS k2, '' AS k3, '├── ' || a AS text FROM q UNION SELECT DISTINCT output_id, a, b, '', '│   ├── ' || b FROM q UNION SELECT output_id, a, b, c, '│   │   ├── ' || c FROM q),
tr AS (SELECT output_id, row_number() OVER (PARTITION BY output_id ORDER BY k1, k2, k3, text) AS seq, text, k1, k2, CASE WHEN k2 = '' THEN 1 WHEN k3 = '' AND NOT starts_with(text, '│   │') THEN 2 ELSE 3 END AS dep FROM e)"""


def tree_listing(spark, sf_dir):
    parts = F.split("path", "/")
    rows = url_paths(spark, sf_dir).select("output_id", F.get(parts, 0).alias("k1"), F.coalesce(F.get(parts, 1), F.lit("")).alias("k2"), F.coalesce(F.get(parts, 2), F.lit("")).alias("k3"))
    none = F.lit("")
    one = rows.select("output_id", "k1", none.alias("k2"), none.alias("k3"), F.concat(F.lit("├── "), "k1").alias("text"))
    two = rows.select("output_id", "k1", "k2", none.alias("k3"), F.concat(F.lit("│   ├── "), "k2").alias("text"))
    three = rows.select("output_id", "k1", "k2", "k3", F.concat(F.lit("│   │   ├── "), "k3").alias("text"))
    order = Window.partitionBy("output_id").orderBy("k1", "k2", "k3", "text")
    return one.union(two).union(three).distinct().select("output_id", F.row_number().over(order).cast("bigint").alias("seq"), "text")


@query(f"""WITH {TREE}, z AS (SELECT output_id, dep, sum(sum((length(text) + 3) // 4 + 1)) OVER (PARTITION BY output_id ORDER BY dep) AS total, max(dep) OVER (PARTITION BY output_id) AS deepest FROM tr GROUP BY output_id, dep),
lv AS (SELECT output_id, max(dep) AS level FROM z WHERE total <= 1500 AND dep < deepest GROUP BY output_id)
SELECT output_id, CAST(level AS BIGINT) AS level, count(*) FILTER (dep <= level) AS shown, count(*) FILTER (dep > level) AS hidden FROM tr LEFT JOIN lv USING (output_id) GROUP BY output_id, level""")
def tree_depth_limit(spark, sf_dir):
    rows = paths.tree_levels(tree_listing(spark, sf_dir), 1500)
    return rows.groupBy("output_id", "level").agg(F.count_if(F.col("depth") <= F.col("level")).alias("shown"), F.count_if(F.col("depth") > F.col("level")).alias("hidden"))


@query(f"""WITH {TREE}, z AS (SELECT output_id, dep, sum(sum((length(text) + 3) // 4 + 1)) OVER (PARTITION BY output_id ORDER BY dep) AS total, max(dep) OVER (PARTITION BY output_id) AS deepest FROM tr GROUP BY output_id, dep),
lv AS (SELECT output_id, max(dep) AS level FROM z WHERE total <= 1500 AND dep < deepest GROUP BY output_id)
SELECT output_id, CASE WHEN level = 1 THEN k1 ELSE k1 || '/' || k2 END AS owner, count(*) AS n FROM tr JOIN lv USING (output_id) WHERE dep > level GROUP BY 1, 2""")
def tree_hidden_entries(spark, sf_dir):
    return paths.tree_hidden(tree_listing(spark, sf_dir), 1500)


# ls -R of the pages: a section for the root, each host and each host/language.
LS = f"""{URLS}, q AS (SELECT DISTINCT output_id, string_split(path, '/')[1] AS a, string_split(path, '/')[2] AS b, string_split(path, '/')[3] AS c FROM u),
sec AS (SELECT DISTINCT output_id, '.' AS name, a AS item, 0 AS dep FROM q UNION SELECT DISTINCT output_id, './' || a, b, 1 FROM q UNION SELECT output_id, './' || a || '/' || b, c, 2 FROM q),
rw AS (SELECT DISTINCT output_id, name, 0 AS o, name || ':' AS text, dep FROM sec UNION ALL SELECT output_id, name, 1, item, dep FROM sec UNION ALL SELECT DISTINCT output_id, name, 2, '', dep FROM sec)"""


def ls_listing(spark, sf_dir):
    parts = F.split("path", "/")
    q = url_paths(spark, sf_dir).select("output_id", F.get(parts, 0).alias("a"), F.get(parts, 1).alias("b"), F.get(parts, 2).alias("c"))
    sec = q.select("output_id", F.lit(".").alias("name"), F.col("a").alias("item")).union(q.select("output_id", F.concat(F.lit("./"), "a"), "b")).union(q.select("output_id", F.concat(F.lit("./"), "a", F.lit("/"), "b"), "c")).distinct()
    names = sec.select("output_id", "name").distinct()
    rows = names.select("output_id", "name", F.lit(0).alias("o"), F.concat("name", F.lit(":")).alias("text")).union(sec.select("output_id", "name", F.lit(1), "item")).union(names.select("output_id", "name", F.lit(2), F.lit("")))
    order = Window.partitionBy("output_id").orderBy("name", "o", "text")
    return rows.select("output_id", F.row_number().over(order).cast("bigint").alias("seq"), F.coalesce("text", F.lit("")).alias("text"))


@query(f"""WITH {LS}, z AS (SELECT output_id, dep, sum(sum((length(coalesce(text, '')) + 3) // 4 + 1)) OVER (PARTITION BY output_id ORDER BY dep) AS total FROM rw GROUP BY 1, 2),
lv AS (SELECT output_id, max(dep) AS level FROM z WHERE total <= 4000 AND dep < 2 GROUP BY 1)
SELECT output_id, CAST(level AS BIGINT) AS level, count(*) FILTER (o = 0) AS sections, count(*) FILTER (o = 1 AND text <> '') AS entries FROM rw JOIN lv USING (output_id) WHERE dep > level GROUP BY 1, 2""")
def ls_depth_limit(spark, sf_dir):
    return paths.ls_levels(ls_listing(spark, sf_dir), 4000)


INDEX = "ix AS (SELECT output_id, path, count(*) AS matches, min(number) AS first, max(number) AS last, min(CASE WHEN regexp_matches(text, '^The ') THEN number END) AS defined FROM s WHERE is_match GROUP BY 1, 2)"


@query(f"WITH {found(1, 1)}, {INDEX} SELECT * FROM ix")
def coverage_index(spark, sf_dir):
    """The index of files; a line that begins with The stands for a definition."""
    return coverage.file_index(search(spark, sf_dir, 1, 1), "^The ")


@query(f"""WITH {found(1, 1)}, {INDEX} SELECT path, path || ': ' || matches || CASE WHEN matches = 1 THEN ' match' ELSE ' matches' END || ', ' ||
CASE WHEN first = last THEN 'line ' || first ELSE 'lines ' || first || '-' || last END || CASE WHEN defined IS NULL THEN '' ELSE ', def ' || defined END AS row FROM ix""")
def coverage_rows(spark, sf_dir):
    return coverage.index_rows(coverage.file_index(search(spark, sf_dir, 1, 1), "^The ")).select("path", "row")


@query(r"WITH " + found() + r""", m AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS key FROM s),
f AS (SELECT output_id, key, path, count(*) AS n, sum(length(CAST(number AS VARCHAR)) + 1 + length(text) + 1) AS plain, sum(length(CAST(number AS VARCHAR)) + 1) AS digits, min(seq) AS seq FROM m WHERE length(key) >= 16 GROUP BY 1, 2, 3),
t AS (SELECT output_id, key, sum(n) AS count, count(*) AS files, sum(plain) AS plain, sum(3 + length(path) + 1 + digits - 1 - length(path) - 3) AS rows_, min(seq) AS seq FROM f GROUP BY 1, 2)
SELECT output_id, key AS text, CAST(count AS BIGINT) AS count, files, seq FROM t WHERE count >= 3 AND 11 + length(CAST(CAST(count AS BIGINT) AS VARCHAR)) + 1 + 28 + least(length(key), 1000) + rows_ < plain""")
def factor_repeats(spark, sf_dir):
    return lossless.factor_repeats(search(spark, sf_dir))


@query(f"""WITH {found(1, 0)}, r AS (SELECT output_id, path, sum(length({PRINTED.replace("300", "1000")}) + 1) AS flat, count(*) AS n FROM s GROUP BY 1, 2)
SELECT output_id, CAST(sum(flat) - 1 AS BIGINT) AS flat, CAST(sum(CASE WHEN n = 1 THEN flat ELSE flat - n * (length(path) + 1) + length(path) + 2 END) - 1 AS BIGINT) AS heading FROM r GROUP BY 1""")
def layout_choice(spark, sf_dir):
    return lossless.layout_sizes(search(spark, sf_dir, 1, 0))


# Pages as files of lines, cut before each list item; links are the names that a line holds.
PAGE_LINES = "pl AS (SELECT regexp_extract(url, '^([a-z]+)://', 1) AS output_id, regexp_extract(url, '://([^?#]*)', 1) AS path, CAST(unnest(range(1, len(ls) + 1)) AS BIGINT) AS number, unnest(ls) AS text FROM (SELECT url, string_split(html, '<li>') AS ls FROM pages WHERE contains(url, '://')))"
LINK = 'href="/([^"]*)"'


def page_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").filter(F.col("url").contains("://")).select("url", F.posexplode(F.split("html", "<li>", -1)).alias("p", "text"))
    return rows.select(
        F.regexp_extract("url", "^([a-z]+)://", 1).alias("output_id"), F.regexp_extract("url", "://([^?#]*)", 1).alias("path"), (F.col("p") + 1).cast("bigint").alias("number"), "text",
        F.col("text").rlike("href=").alias("is_match"),
    )


NAMED = f"nm AS (SELECT output_id, path, number, unnest(list_distinct(list_filter(regexp_extract_all(text, '{LINK}', 1), lambda x: x <> ''))) AS name FROM pl WHERE contains(text, 'href='))"


@query(f"WITH {PAGE_LINES}, {NAMED} SELECT output_id, name, path, string_agg(CAST(number AS VARCHAR), ',' ORDER BY number) AS numbers FROM nm GROUP BY 1, 2, 3")
def project_names_by_name(spark, sf_dir):
    return lossless.names_by_name(page_lines(spark, sf_dir), LINK)


@query(f"WITH {PAGE_LINES}, {NAMED} SELECT output_id, path, string_agg(name || ':' || number, ' ' ORDER BY number, name || ':' || number) AS names FROM nm GROUP BY 1, 2")
def project_names_by_file(spark, sf_dir):
    return lossless.names_by_file(page_lines(spark, sf_dir), LINK)


@query(f"""WITH {PAGE_LINES}, h AS (SELECT output_id, count(*) AS matches, count(*) FILTER (regexp_matches(text, '{LINK}')) AS a, count(*) FILTER (contains(text, '<nav>')) AS b FROM pl WHERE contains(text, 'href=') GROUP BY 1)
SELECT output_id, CASE WHEN a >= b THEN 'link' ELSE 'nav' END AS rule, greatest(a, b) AS hits, matches FROM h WHERE greatest(a, b) >= 0.5 * matches""")
def recogniser_choice(spark, sf_dir):
    return lossless.recognised(page_lines(spark, sf_dir), [("link", LINK), ("nav", "<nav>")])


@query(f"""WITH {found(1, 1)}, {BLOCKS}, f AS (SELECT *, min(seq) OVER (PARTITION BY output_id, path) AS first FROM bl),
b AS (SELECT output_id, first, path, block, string_agg({PRINTED}, chr(10) ORDER BY number) AS t, bool_or(NOT is_match) AS c FROM f GROUP BY 1, 2, 3, 4)
SELECT output_id, md5(CASE WHEN bool_or(c) THEN string_agg(t, chr(10) || '--' || chr(10) ORDER BY first, path, block) ELSE string_agg(t, chr(10) ORDER BY first, path, block) END) AS text_md5 FROM b GROUP BY 1""")
def render_flat(spark, sf_dir):
    """The whole text of each search result, as a digest."""
    return lines.rendered(search(spark, sf_dir, 1, 1)).select("output_id", F.md5("text").alias("text_md5"))
