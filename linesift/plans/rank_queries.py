"""Queries over ranking, session memory, evaluation and parsing."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.text import STOP_WORDS, looks_like_path, terms, tokens
from ..operators import evaluate, lines, memory, parse, rank
from ..sources import corpus
from .registry import query, table
from .search_queries import BLOCKS, FILES, PRINTED, URLS, found, search, url_paths

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def terms_sql(rows: str, text: str, key: str) -> str:
    """CTE tm: key, term (repeats stay) of rows."""
    return f"""w0 AS (SELECT {key}, unnest(regexp_extract_all({text}, '[A-Za-z][A-Za-z0-9]*')) AS w FROM {rows}),
w1 AS (SELECT {key}, w AS p FROM w0 UNION ALL SELECT * FROM (SELECT {key}, unnest(list_filter(regexp_extract_all(regexp_replace(w, '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '[A-Z]?[a-z]+|[A-Z]+|[0-9]+'), lambda x: x <> w)) AS p FROM w0)),
w2 AS (SELECT {key}, lower(p) AS p FROM w1 WHERE length(p) > 1 AND lower(p) NOT IN ({STOPS})),
tm AS (SELECT {key}, CASE WHEN ends_with(p, 'ing') AND length(p) >= 6 THEN left(p, length(p) - 3) WHEN ends_with(p, 'ed') AND length(p) >= 5 THEN left(p, length(p) - 2)
  WHEN ends_with(p, 'es') AND length(p) >= 5 THEN left(p, length(p) - 2) WHEN ends_with(p, 's') AND length(p) >= 4 THEN left(p, length(p) - 1) WHEN ends_with(p, 'e') AND length(p) >= 4 THEN left(p, length(p) - 1) ELSE p END AS term FROM w2)"""


@query(f"WITH {terms_sql('(SELECT conv_id, turn, text FROM conversations)', 'text', 'conv_id, turn')} SELECT conv_id, turn, term, count(*) AS n FROM tm GROUP BY 1, 2, 3")
def terms_explode(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(terms(F.col("text"))).alias("term"))
    return rows.groupBy("conv_id", "turn", "term").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {terms_sql('(SELECT item_id, text FROM benchmark)', 'text', 'item_id')}, t AS (SELECT item_id, term, count(*) AS n FROM tm GROUP BY 1, 2) SELECT 'all' AS output_id, term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df FROM t GROUP BY term")
def tf_df(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.lit("all").alias("output_id"), "text")
    return rank.term_stats(rows, F.col("text"))


UNITS = f"""q1 AS (SELECT *, CASE WHEN is_match THEN number END AS mn FROM bl),
q2 AS (SELECT *, last_value(mn IGNORE NULLS) OVER (PARTITION BY output_id, path, block ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm FROM q1),
q3 AS (SELECT *, CASE WHEN is_match THEN sum(CASE WHEN is_match AND (pm IS NULL OR number - pm > 2) THEN 1 ELSE 0 END) OVER (PARTITION BY output_id, path, block ORDER BY number) END AS run FROM q2),
q4 AS (SELECT *, CASE WHEN is_match THEN run * 1000000 + (count(*) FILTER (is_match) OVER (PARTITION BY output_id, path, block, run ORDER BY number) - 1) // 5 END AS k FROM q3),
q5 AS (SELECT *, last_value(mn IGNORE NULLS) OVER b AS p, last_value(k IGNORE NULLS) OVER b AS pk, first_value(mn IGNORE NULLS) OVER a AS n, first_value(k IGNORE NULLS) OVER a AS nk FROM q4
  WINDOW b AS (PARTITION BY output_id, path, block ORDER BY number ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY output_id, path, block ORDER BY number ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
q6 AS (SELECT *, CASE WHEN p IS NOT NULL AND (n IS NULL OR number - p <= n - number) THEN pk ELSE nk END AS own FROM q5),
un AS (SELECT output_id, path, number, text, is_match, seq, block, dense_rank() OVER (PARTITION BY output_id, path, block ORDER BY own NULLS FIRST) AS unit FROM q6)"""


@query(f"WITH {found(3, 2)}, {BLOCKS}, {UNITS} SELECT path, number, block, unit FROM un")
def units_nearest_context(spark, sf_dir):
    return rank.with_units(search(spark, sf_dir, 3, 2)).select("path", "number", "block", "unit")




UNIT_ROWS = f"""ur AS (SELECT output_id, path, block, unit, min(seq) AS first, count(*) FILTER (is_match) AS matches, string_agg(text, chr(10) ORDER BY number) AS text,
  (sum(length({PRINTED}) + 1) - 1 + 3) // 4 + 1 AS full_, (sum(length({PRINTED}) + 1) FILTER (is_match) - 1 + 3) // 4 + 1 AS bare FROM un GROUP BY 1, 2, 3, 4)"""

BM25 = f"""{terms_sql("(SELECT output_id, path AS pth, block, unit, path || ' ' || text AS body FROM ur)", 'body', 'output_id, pth, block, unit')},
ln AS (SELECT output_id, pth, block, unit, count(*) AS long FROM tm GROUP BY 1, 2, 3, 4),
al AS (SELECT ur.output_id, ur.path AS pth, ur.block, ur.unit, coalesce(long, 0) AS long FROM ur LEFT JOIN ln ON ur.output_id = ln.output_id AND ur.path = ln.pth AND ur.block = ln.block AND ur.unit = ln.unit),
sz AS (SELECT output_id, count(*) AS n, avg(long) AS mean FROM al GROUP BY 1),
qt(term, weight) AS (VALUES ('err', 1.0), ('thnt', 1.0), ('erth', 1.0), ('tion', 1.0), ('onn', 1.0), ('sh', 0.3)),
tf AS (SELECT output_id, pth, block, unit, term, count(*) AS tf FROM tm WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2, 3, 4, 5),
df AS (SELECT output_id, term, count(*) AS df FROM tf GROUP BY 1, 2),
sc AS (SELECT al.output_id, al.pth, al.block, al.unit, coalesce(sum(weight * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * al.long / mean))), 0.0) AS score
  FROM al JOIN sz USING (output_id) LEFT JOIN tf USING (output_id, pth, block, unit) LEFT JOIN df USING (output_id, term) LEFT JOIN qt USING (term) GROUP BY 1, 2, 3, 4)"""
BM25_INTENT, BM25_PATTERN = "err thnt erth tion onn", "sh"


@query(f"WITH {found(1, 1)}, {BLOCKS}, {UNITS}, {UNIT_ROWS}, {BM25} SELECT output_id, pth AS path, block, unit, round(score, 6) AS score FROM sc")
def bm25_units(spark, sf_dir):
    scored = rank.bm25(rank.units(search(spark, sf_dir, 1, 1)), (BM25_INTENT, BM25_PATTERN))
    return scored.select("output_id", "path", "block", "unit", F.round("score", 6).alias("score"))


def ranked_units(spark, sf_dir, most: int | None = None):
    """Units by score; scores that differ by less than 1e-6 count as equal, ties go to the earlier unit."""
    scored = rank.bm25(rank.units(search(spark, sf_dir, 1, 1)), (BM25_INTENT, BM25_PATTERN)).drop("text", "defined").withColumn("score", F.round("score", 6))
    if most:
        return rank.shortlist(scored, most)
    return rank.with_place(scored, [F.desc("score"), F.col("first")])


RANKED = f"{found(1, 1)}, {BLOCKS}, {UNITS}, {UNIT_ROWS}, {BM25}, rk AS (SELECT ur.*, round(score, 6) AS score, row_number() OVER (PARTITION BY ur.output_id ORDER BY round(score, 6) DESC, first) AS rank FROM ur JOIN sc ON ur.output_id = sc.output_id AND ur.path = sc.pth AND ur.block = sc.block AND ur.unit = sc.unit)"


@query(f"WITH {RANKED} SELECT output_id, path, block, unit, score, CAST(rank AS BIGINT) AS rank FROM rk WHERE rank <= 60")
def shortlist_topk(spark, sf_dir):
    """The 60 best units of each output: a top-k report."""
    return ranked_units(spark, sf_dir, 60).select("output_id", "path", "block", "unit", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {RANKED} SELECT output_id, path, min(rank) AS best FROM rk GROUP BY 1, 2")
def files_by_best_unit(spark, sf_dir):
    return rank.best_first(ranked_units(spark, sf_dir)).withColumn("best", F.col("best").cast("bigint"))


@query(f"""WITH {RANKED}, ls AS (SELECT output_id, list({{'r': rank, 'f': CAST(full_ AS BIGINT), 'b': CAST(bare AS BIGINT)}} ORDER BY rank) AS xs FROM rk WHERE full_ <= 895 OR bare <= 1790 GROUP BY 1),
rd AS (SELECT output_id, list_reduce(xs, lambda a, x: CASE WHEN a.used + x.f <= 895 THEN {{'used': a.used + x.f, 'kept': list_append(a.kept, x.r || ':full')}}
  WHEN a.used + x.b <= 1790 THEN {{'used': a.used + x.b, 'kept': list_append(a.kept, x.r || ':bare')}} ELSE a END, {{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS VARCHAR[])}}) AS o FROM ls)
SELECT output_id, CAST(split_part(k, ':', 1) AS BIGINT) AS rank, split_part(k, ':', 2) AS kept FROM (SELECT output_id, unnest(o.kept) AS k FROM rd)""")
def greedy_skip_fill(spark, sf_dir):
    rows = rank.greedy_fill(ranked_units(spark, sf_dir).select("output_id", "rank", "full", "bare"), 1790)
    return rows.filter("kept is not null").select("output_id", F.col("rank").cast("bigint").alias("rank"), "kept")


@query(f"""WITH {URLS}, r AS (SELECT output_id, path, min(seq) AS seq, (length(path) + 3) // 4 + 1 AS cost FROM u GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY output_id ORDER BY CASE WHEN contains(path, '/en/') THEN 1.0 ELSE 0.0 END DESC, seq) AS rank FROM r),
ls AS (SELECT output_id, list({{'r': rank, 'f': CAST(cost AS BIGINT)}} ORDER BY rank) AS xs FROM o GROUP BY 1),
rd AS (SELECT output_id, list_reduce(xs, lambda a, x: CASE WHEN a.used + x.f <= 400 THEN {{'used': a.used + x.f, 'kept': list_append(a.kept, x.r)}} ELSE a END, {{'used': CAST(0 AS BIGINT), 'kept': CAST([] AS BIGINT[])}}) AS o FROM ls)
SELECT output_id, path, rank FROM (SELECT output_id, unnest(o.kept) AS rank FROM rd) JOIN o USING (output_id, rank)""")
def rank_paths(spark, sf_dir):
    """English pages first, then greedily what fits 400 tokens."""
    rows = url_paths(spark, sf_dir).groupBy("output_id", "path").agg(F.min("seq").alias("seq")).withColumn("full", tokens(F.col("path")) + 1)
    order = Window.partitionBy("output_id").orderBy(F.desc(F.when(F.col("path").contains("/en/"), 1.0).otherwise(0.0)), "seq")
    rows = rows.withColumn("rank", F.row_number().over(order).cast("bigint")).withColumn("bare", F.col("full"))
    return rank.greedy_fill(rows, 400, 1.0).filter("kept is not null").select("output_id", "path", "rank")


# --- session memory ------------------------------------------------------------------


@query(f"WITH {found()}, sn AS (SELECT path, number FROM l WHERE regexp_matches(text, '(?i)and ')) SELECT path, number FROM s ANTI JOIN sn USING (path, number)")
def seen_antijoin(spark, sf_dir):
    """A second search's rows without those that the first has shown."""
    seen = search(spark, sf_dir, pattern="(?i)and ")
    return memory.unseen(search(spark, sf_dir), seen, ["path", "number"]).select("path", "number")


def shown_events(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.lit("s").alias("session"), F.col("user_id").alias("file"), F.col("event_id").alias("key"), F.col("props").alias("digest"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ns"), "event_type")
    return rows


@query("""WITH inv AS (SELECT user_id, max(ts) AS ts FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT 's' AS session, e.user_id AS file, event_id AS key FROM events e LEFT JOIN inv USING (user_id) WHERE event_type <> 'purchase' AND (inv.ts IS NULL OR e.ts > inv.ts)""")
def invalidate_asof(spark, sf_dir):
    """What was shown of a file after its last edit; purchases stand for edits."""
    rows = shown_events(spark, sf_dir)
    return memory.still_seen(rows.filter("event_type <> 'purchase'"), rows.filter("event_type = 'purchase'"))


@query("SELECT user_id AS file, arg_max(props, (ts, props)) AS digest FROM events GROUP BY 1")
def latest_fingerprint(spark, sf_dir):
    return memory.latest(shown_events(spark, sf_dir), ["file"], "digest", "ns").select("file", "digest")


@query(f"""WITH {found(3, 3)}, sn AS (SELECT *, regexp_matches(text, '(?i)ing ') AS seen FROM s), {BLOCKS.replace('FROM s)', 'FROM sn)')},
a AS (SELECT *, (SELECT arg_min(m.number, (abs(m.number - x.number), m.number)) FROM bl m WHERE m.path = x.path AND m.block = x.block AND m.is_match) AS anchor FROM bl x),
w AS (SELECT path, block, least(number, anchor) AS lo, greatest(number, anchor) AS hi FROM a WHERE NOT seen AND NOT is_match AND anchor IS NOT NULL)
SELECT path, number, NOT seen OR EXISTS (SELECT 1 FROM w WHERE w.path = bl.path AND w.block = bl.block AND bl.number BETWEEN lo AND hi) AS kept FROM bl""")
def new_context_keeps_anchor(spark, sf_dir):
    rows = search(spark, sf_dir, 3, 3).withColumn("seen", F.col("text").rlike("(?i)ing "))
    return memory.split_seen(rows).select("path", "number", "kept")


# --- evaluation ----------------------------------------------------------------------


@query("""WITH d AS (SELECT conv_id, max(turn) FILTER (role = 'user') AS u, max(turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY 1)
SELECT d.conv_id, max(c.text) FILTER (c.role = 'user' AND c.turn = u) AS intent, max(c.text) FILTER (c.role = 'assistant' AND c.turn = a) AS subtask FROM d JOIN conversations c ON d.conv_id = c.conv_id GROUP BY 1""")
def transcript_intent(spark, sf_dir):
    """The last user text of a transcript is the intent, the last assistant text the subtask."""
    last = lambda role: F.max(F.when(F.col("role") == role, F.struct("turn", "text")))
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(last("user").alias("u"), last("assistant").alias("a"))
    return rows.select("conv_id", F.col("u.text").alias("intent"), F.col("a.text").alias("subtask"))


EVIDENCE = f"""{found()}, an AS (SELECT doc_id, path, number, l.doc_id * 1000000 + number AS anchor, coalesce(quality = 1, false) AS critical FROM l LEFT JOIN labels USING (doc_id) WHERE regexp_matches(text, '(?i)of ')),
sh AS (SELECT path, number FROM s WHERE length(text) > 60), nd AS (SELECT DISTINCT regexp_extract(path, '^([^/]*/[^/]*)/', 1) AS path FROM s WHERE length(text) > 400)"""


@query(f"""WITH {EVIDENCE}, tl AS (SELECT DISTINCT anchor FROM an JOIN nd ON starts_with(an.path, nd.path || '/'))
SELECT anchor, an.path, an.number, critical, CASE WHEN EXISTS (SELECT 1 FROM sh WHERE sh.path = an.path AND sh.number = an.number) THEN 'kept'
  WHEN anchor IN (SELECT anchor FROM tl) OR an.path IN (SELECT path FROM sh) THEN 'recoverable' ELSE 'lost' END AS status FROM an""")
def evidence_status(spark, sf_dir):
    s = search(spark, sf_dir)
    every = corpus.corpus_lines(table(spark, sf_dir, "documents")).filter(F.col("text").rlike("(?i)of "))
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    doc = F.floor(F.col("seq") / corpus.FILE_LINES).cast("bigint")
    anchors = every.withColumn("doc_id", doc).join(labels, "doc_id", "left").select(F.col("seq").alias("anchor"), "path", "number", F.coalesce(F.col("quality") == 1, F.lit(False)).alias("critical"))
    shown = s.filter(F.char_length("text") > 60)
    named = s.filter(F.char_length("text") > 400).select(F.regexp_extract("path", "^([^/]*/[^/]*)/", 1).alias("path"))
    return evaluate.evidence_status(anchors, shown, named)


@query(f"WITH {found(2, 2)} SELECT output_id, count(*) AS wanted, count(*) FILTER (is_match) AS found FROM s GROUP BY 1")
def location_recall(spark, sf_dir):
    s = search(spark, sf_dir, 2, 2)
    return evaluate.location_recall(s, s.filter("is_match"))


@query(f"WITH {found(1, 1)}, x AS (SELECT output_id, path, number, left(text, 40) AS text FROM s) SELECT output_id, path, number, text FROM x WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.output_id = x.output_id AND s.text = x.text)")
def subset_check(spark, sf_dir):
    """Rows whose clipped text no raw row of the output holds."""
    s = search(spark, sf_dir, 1, 1)
    return evaluate.invented(s.select("output_id", "path", "number", F.substring("text", 1, 40).alias("text")), s)


@query("""WITH r AS (SELECT l_returnflag, l_extendedprice AS raw, l_extendedprice * (1 - l_discount) AS out, l_quantity AS ms, CASE WHEN l_extendedprice > 0 THEN 1 - l_extendedprice * (1 - l_discount) / l_extendedprice ELSE 0.0 END AS saving FROM lineitem),
p AS (SELECT l_returnflag, ms, row_number() OVER (PARTITION BY l_returnflag ORDER BY ms) - 1 AS i, least(count(*) OVER (PARTITION BY l_returnflag) - 1, CAST(floor(count(*) OVER (PARTITION BY l_returnflag) * 0.95) AS BIGINT)) AS pos FROM r)
SELECT r.l_returnflag, count(*) AS n, round(sum(raw), 2) AS raw, round(sum(out), 2) AS out, round(avg(saving), 6) AS mean_saving, round(median(saving), 6) AS median_saving, (SELECT ms FROM p WHERE p.l_returnflag = r.l_returnflag AND i = pos) AS p95_ms FROM r GROUP BY 1""")
def workload_aggregates(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_extendedprice").alias("raw"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("out"), F.col("l_quantity").alias("ms"))
    return evaluate.workload_aggregates(rows, "l_returnflag").withColumn("raw", F.round("raw", 2)).withColumn("out", F.round("out", 2))


@query("SELECT round(sum(m * w) / sum(w), 6) AS mean FROM (SELECT l_returnflag, avg(l_discount) AS m FROM lineitem GROUP BY 1) JOIN (VALUES ('A', 3.0), ('N', 2.0), ('R', 1.0)) t(l_returnflag, w) USING (l_returnflag)")
def category_mean(spark, sf_dir):
    weights = spark.createDataFrame([("A", 3.0), ("N", 2.0), ("R", 1.0)], "l_returnflag string, weight double")
    return evaluate.weighted_mean(table(spark, sf_dir, "lineitem"), weights, "l_returnflag", "l_discount")


def _pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", F.col("l_quantity").alias("cost"))
    return evaluate.pairs(rows, ["l_orderkey"], "l_linestatus", "cost", off="O", on="F")


@query("WITH p AS (SELECT l_orderkey, sum(l_quantity) FILTER (l_linestatus = 'O') AS a, sum(l_quantity) FILTER (l_linestatus = 'F') AS b FROM lineitem GROUP BY 1) SELECT count(*) AS pairs, round(sum(b) / sum(a) - 1, 6) AS change FROM p WHERE a IS NOT NULL AND b IS NOT NULL")
def pairs_ratio(spark, sf_dir):
    return _pairs(spark, sf_dir).agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum("on") / F.sum("off") - 1, 6).alias("change"))


@query()
def bootstrap_interval(spark, sf_dir):
    """The paired change with its 95 % interval; resampling differs by engine, so there is no SQL for it."""
    return evaluate.bootstrap_ratio(_pairs(spark, sf_dir))


@query(r"""WITH k AS (SELECT conv_id AS session, turn AS seq, lower(regexp_extract(text, '[A-Za-z]+ [A-Za-z]+')) AS key FROM conversations WHERE role = 'user'),
w AS (SELECT session, seq, key, unnest(list_distinct(string_split(key, ' '))) AS word FROM k),
r AS (SELECT DISTINCT b.session, b.seq FROM w a JOIN w b ON a.session = b.session AND a.word = b.word AND a.seq < b.seq AND (a.key = b.key OR (contains(a.key, b.key) AND length(b.key) >= 4) OR (contains(b.key, a.key) AND length(a.key) >= 4)))
SELECT k.session, k.seq, k.key, r.seq IS NOT NULL AS refines FROM k LEFT JOIN r ON k.session = r.session AND k.seq = r.seq""")
def re_search_detect(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("role = 'user'").select(F.col("conv_id").alias("session"), F.col("turn").alias("seq"), F.lower(F.regexp_extract("text", "[A-Za-z]+ [A-Za-z]+", 0)).alias("key"))
    return evaluate.searches_again(rows)


# --- parsing: a search result printed, then read back, must equal itself -------------------


def printed_outputs(rows):
    """output_id, raw: rows (output_id, seq, line) as one text an output; outputs are files here, so each is a small text."""
    every = F.transform(F.array_sort(F.collect_list(F.struct("seq", "line"))), lambda x: x["line"])
    return rows.groupBy("output_id").agg(F.array_join(every, "\n").alias("raw"))


def _per_file(spark, sf_dir, before=1, after=1):
    return search(spark, sf_dir, before, after).withColumn("output_id", F.col("path"))


@query(f"WITH {found(1, 1)} SELECT path, number, text, is_match FROM s")
def flat_parse(spark, sf_dir):
    s = _per_file(spark, sf_dir)
    raw = printed_outputs(s.select("output_id", "seq", lines.printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), 1_000_000).alias("line")))
    return parse.flat_content(parse.raw_lines(raw)).select("path", "number", "text", "is_match")


@query(f"WITH {found(1, 1)} SELECT path, number, text, is_match FROM s")
def heading_parse(spark, sf_dir):
    s = _per_file(spark, sf_dir)
    row = F.concat(F.col("number").cast("string"), F.when(F.col("is_match"), ":").otherwise("-"), F.col("text"))
    heads = s.select("output_id", F.lit(0).cast("bigint").alias("seq"), F.col("path").alias("line")).distinct()
    raw = printed_outputs(heads.unionByName(s.select("output_id", "seq", row.alias("line"))))
    return parse.headed_content(parse.raw_lines(raw)).select("path", "number", "text", "is_match")


@query(f"WITH {found(1, 1)} SELECT path, number, text, is_match FROM s")
def select_string_parse(spark, sf_dir):
    s = _per_file(spark, sf_dir)
    row = F.concat(F.when(F.col("is_match"), "> ").otherwise("  "), F.concat_ws(":", "path", F.col("number").cast("string"), "text"))
    raw = printed_outputs(s.select("output_id", "seq", row.alias("line")))
    return parse.select_string(parse.raw_lines(raw)).select("path", "number", "text", "is_match")


@query(f"WITH {found(1, 1)} SELECT path, number, text, is_match FROM s")
def rg_json_parse(spark, sf_dir):
    s = _per_file(spark, sf_dir)
    data = F.struct(F.struct(F.col("path").alias("text")).alias("path"), F.struct(F.concat("text", F.lit("\n")).alias("text")).alias("lines"), F.col("number").alias("line_number"))
    event = F.to_json(F.struct(F.when(F.col("is_match"), "match").otherwise("context").alias("type"), data.alias("data")))
    raw = printed_outputs(s.select("output_id", "seq", event.alias("line")))
    return parse.json_events(parse.raw_lines(raw)).select("path", "number", "text", "is_match")


@query(f"WITH {found()} SELECT path, number, text FROM s")
def same_line_parse(spark, sf_dir):
    s = search(spark, sf_dir)
    # One output for each text: the head holds it, a row for each file its numbers.
    rows = s.groupBy(F.col("text").alias("output_id"), "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list("number")), lambda n: n.cast("string")), ",").alias("n"), F.min("seq").alias("seq"))
    heads = rows.select("output_id", F.lit(0).cast("bigint").alias("seq"), F.concat(F.lit("[linesift] 3 matches are this same line: "), "output_id").alias("line")).distinct()
    raw = printed_outputs(heads.unionByName(rows.select("output_id", "seq", F.concat(F.lit("  "), "path", F.lit(":"), "n").alias("line"))))
    return parse.same_line_groups(parse.raw_lines(raw), r"^\[linesift\] [0-9]+ matches are this same line: (.*)$").select("path", "number", "text")


@query(f"WITH {found()} SELECT path, count(*) AS count FROM s GROUP BY path")
def counts_parse(spark, sf_dir):
    rows = search(spark, sf_dir).groupBy("output_id", "path").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    dirs = F.regexp_extract("path", "^(.*/)", 1)
    rows = rows.withColumn("output_id", dirs)
    heads = rows.select("output_id", F.lit(0).cast("bigint").alias("seq"), F.col("output_id").alias("line")).distinct()
    name = F.regexp_extract("path", "([^/]*)$", 1)
    raw = printed_outputs(heads.unionByName(rows.select("output_id", "seq", F.concat(F.lit("  "), name, F.lit(":"), F.col("n").cast("string")).alias("line"))))
    return parse.parse_counts(parse.raw_lines(raw)).select("path", "count")


@query(f"WITH {URLS} SELECT DISTINCT path FROM u")
def path_list_parse(spark, sf_dir):
    rows = url_paths(spark, sf_dir).select(F.regexp_extract("path", "^([^/]*)", 1).alias("output_id"), "seq", F.col("path").alias("line"))
    return parse.listed_entries(parse.raw_lines(printed_outputs(rows))).select(F.col("entry").alias("path")).distinct()


@query(f"""WITH {found()}, k AS (SELECT path || '#flat' AS output_id, 'content' AS kind FROM s UNION SELECT path || '#count', 'count' FROM s UNION SELECT path || '#path', 'paths' FROM s) SELECT output_id, kind FROM k""")
def detect_kind(spark, sf_dir):
    s = search(spark, sf_dir)
    flat = s.select(F.concat("path", F.lit("#flat")).alias("output_id"), "seq", lines.printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), 1_000_000).alias("line"))
    files = s.groupBy("path").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("n"))
    counts = files.select(F.concat("path", F.lit("#count")).alias("output_id"), "seq", F.concat_ws(":", "path", F.col("n").cast("string")).alias("line"))
    listed = files.select(F.concat("path", F.lit("#path")).alias("output_id"), "seq", F.col("path").alias("line"))
    return parse.detect_kind(parse.raw_lines(printed_outputs(flat.unionByName(counts).unionByName(listed))))


@query(f"WITH {found()}, f AS (SELECT path, count(*) AS n FROM s GROUP BY path) SELECT path AS output_id, 'header' AS part, CAST(1 AS BIGINT) AS n FROM f UNION ALL SELECT path, 'body', n FROM f UNION ALL SELECT path, 'footer', 1 FROM f")
def framing_split(spark, sf_dir):
    s = _per_file(spark, sf_dir, 0, 0)
    body = s.select("output_id", "seq", lines.printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), 1_000_000).alias("line"))
    frame = lambda seq, text: s.select("output_id", F.lit(seq).cast("bigint").alias("seq"), F.lit(text).alias("line")).distinct()
    raw = printed_outputs(frame(0, "Found 3 files").unionByName(body).unionByName(frame(1 << 60, "(Results are truncated here)")))
    return parse.with_framing(parse.raw_lines(raw)).filter("part is not null").groupBy("output_id", "part").agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {FILES}, u AS (SELECT path, regexp_matches(text, '^.+?:[0-9]+:') AS hit, text, regexp_extract(text, '^(.+?)-[0-9]+-', 1) AS p FROM l WHERE trim(text) <> '' AND text <> '--'),
c AS (SELECT path, hit, NOT hit AND p <> '' AND NOT regexp_matches(p, '^[ \t]') AND NOT contains(trim(p), ' ') AND regexp_matches(p, '[./\\\\]') AS ctx FROM u),
f AS (SELECT path, count(*) AS n, count(*) FILTER (hit) AS hits, count(*) FILTER (hit OR ctx) AS parsed FROM c GROUP BY path)
SELECT path AS output_id, (parsed = 0 OR hits > 0) AND n - parsed <= greatest(2.0, 0.05 * n) AS reliable FROM f""")
def reliability_gate(spark, sf_dir):
    """Whether each document would pass as search output: prose doesn't parse, and only a line or two of it is let through."""
    rows = corpus.corpus_lines(table(spark, sf_dir, "documents")).select(F.col("path").alias("output_id"), "seq", F.col("text").alias("line"))
    raw = parse.raw_lines(printed_outputs(rows))
    return parse.reliable(raw, parse.flat_content(raw))


@query(r"""WITH w AS (SELECT conv_id, turn, text, list_has_any(string_split(lower(regexp_replace(text, '[^A-Za-z]+', ' ', 'g')), ' '), ['error', 'errors', 'fail', 'failed', 'failure', 'failures', 'exception', 'traceback', 'panicked', 'assertionerror']) AS bad FROM conversations)
SELECT conv_id, turn, (bad OR regexp_matches(text, '[\w./\\-]+\.[A-Za-z]\w*[:(][0-9]+')) AND NOT regexp_matches(text, '^0 (errors|failures|failed)\b|\b0 failed\b|\b0 errors\b|\.\.\. ok$| PASSED\b') AS critical FROM w WHERE text IS NOT NULL""")
def critical_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").filter("text is not null").select("conv_id", "turn", "text")
    return evaluate.critical(rows).select("conv_id", "turn", "critical")


@query("SELECT page_id, contains(url, '.') AND NOT contains(trim(url), ' ') AS path_like FROM pages WHERE url IS NOT NULL")
def path_predicate(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").filter("url is not null")
    return rows.select("page_id", looks_like_path(F.col("url")).alias("path_like"))
