"""Queries over test and build logs made from the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_times
from ..operators import logs
from .registry import query, table

# One log for each supplier, made of the line items that it sold.
ITEMS = "it AS (SELECT CAST(l_suppkey AS VARCHAR) AS output_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_quantity) AS r, * FROM lineitem)"


def items(spark, sf_dir) -> DataFrame:
    order = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return table(spark, sf_dir, "lineitem").withColumn("output_id", F.col("l_suppkey").cast("string")).withColumn("r", F.row_number().over(order).cast("bigint"))


def log(rows: DataFrame, text, last: str | None = None, first: str | None = None) -> DataFrame:
    """output_id, seq, text: a line of each item, between a first and a last line of each log."""
    out = rows.select("output_id", (F.col("r") + 1).alias("seq"), text.alias("text"))
    ends = rows.groupBy("output_id").agg(F.max("r").alias("n"))
    if first:
        out = out.unionByName(ends.select("output_id", F.lit(1).cast("bigint").alias("seq"), F.lit(first).alias("text")))
    if last:
        out = out.unionByName(ends.select("output_id", (F.col("n") + 2).alias("seq"), F.lit(last).alias("text")))
    return out


def log_sql(text: str, last: str | None = None, first: str | None = None) -> str:
    parts = [f"SELECT output_id, r + 1 AS seq, {text} AS text FROM it"]
    if first:
        parts.append(f"SELECT DISTINCT output_id, CAST(1 AS BIGINT), '{first}' FROM it")
    if last:
        parts.append(f"SELECT output_id, max(r) + 2, '{last}' FROM it GROUP BY output_id")
    return f"WITH {ITEMS}, lg AS ({' UNION ALL '.join(parts)})"


def name():
    return F.concat(F.lit("orders::o"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"))


def passed():
    return F.col("l_linestatus") == "F"


NAME_SQL = "'orders::o' || l_orderkey || '_' || l_linenumber"


@query(log_sql(f"'test ' || {NAME_SQL} || ' ... ' || CASE WHEN l_linestatus = 'F' THEN 'ok' ELSE 'FAILED' END", "test result: FAILED.") + " SELECT output_id, seq, text FROM lg WHERE NOT (starts_with(text, 'test orders') AND ends_with(text, ' ... ok'))")
def compact_pass_lines(spark, sf_dir):
    rows = log(items(spark, sf_dir), F.concat(F.lit("test "), name(), F.lit(" ... "), F.when(passed(), "ok").otherwise("FAILED")), "test result: FAILED.")
    return logs.drop_passing(rows, "cargo").filter("label is null").select("output_id", "seq", "text")


@query(log_sql(f"'tests/test_' || l_returnflag || '.py::test_' || l_orderkey || '_' || l_linenumber || ' ' || CASE WHEN l_linestatus = 'F' THEN 'PASSED' ELSE 'FAILED' END || '  [ 10%]'", "==== 1 failed in 1.5s ====", "==== test session starts ====") + " SELECT output_id, count(*) FILTER (contains(text, ' PASSED ')) AS n FROM lg GROUP BY 1 HAVING count(*) FILTER (contains(text, ' PASSED ')) > 0")
def compact_pytest_lines(spark, sf_dir):
    text = F.concat(F.lit("tests/test_"), F.col("l_returnflag"), F.lit(".py::test_"), F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string"), F.lit(" "), F.when(passed(), "PASSED").otherwise("FAILED"), F.lit("  [ 10%]"))
    rows = log(items(spark, sf_dir), text, "==== 1 failed in 1.5s ====", "==== test session starts ====")
    return logs.counters(logs.drop_passing(rows, "pytest")).select("output_id", "n")


@query(log_sql("'   ' || CASE WHEN l_partkey < 150 THEN 'Compiling' WHEN l_returnflag = 'A' THEN 'Fresh' ELSE 'warning:' END || ' pkg' || l_partkey || ' v1.' || l_linenumber") + """, p AS (SELECT *, regexp_matches(text, '^ +(Compiling|Fresh) ') AS hit FROM lg), c AS (SELECT output_id, count(*) FILTER (hit) AS n FROM p GROUP BY 1)
SELECT output_id, 'cargo progress lines' AS label, n FROM c WHERE n >= 10""")
def compact_progress10(spark, sf_dir):
    """Progress lines go only where a log has ten of the family."""
    word = F.when(F.col("l_partkey") < 150, "Compiling").when(F.col("l_returnflag") == "A", "Fresh").otherwise("warning:")
    rows = log(items(spark, sf_dir), F.concat(F.lit("   "), word, F.lit(" pkg"), F.col("l_partkey").cast("string"), F.lit(" v1."), F.col("l_linenumber").cast("string")))
    return logs.counters(logs.drop_progress(rows)).select("output_id", "label", "n")


SECTION_TEXT = "CASE WHEN l_linenumber = 1 THEN '==== ' || CASE WHEN l_returnflag = 'A' THEN 'FAILURES' ELSE 'PASSES' END || ' ====' WHEN l_linenumber = 2 THEN '____ test_' || l_partkey || ' ____' WHEN l_partkey < 100 THEN 'an error ' || l_partkey ELSE 'line ' || l_partkey END"


def section_log(spark, sf_dir):
    part = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_linenumber") == 1, F.concat(F.lit("==== "), F.when(F.col("l_returnflag") == "A", "FAILURES").otherwise("PASSES"), F.lit(" ===="))).when(
        F.col("l_linenumber") == 2, F.concat(F.lit("____ test_"), part, F.lit(" ____"))
    ).when(F.col("l_partkey") < 100, F.concat(F.lit("an error "), part)).otherwise(F.concat(F.lit("line "), part))
    return log(items(spark, sf_dir), text)


SECTIONS_SQL = log_sql(SECTION_TEXT) + r""", a AS (SELECT *, coalesce(last_value(CASE WHEN starts_with(text, '====') THEN trim(text, '= ') END IGNORE NULLS) OVER (PARTITION BY output_id ORDER BY seq), '') AS section FROM lg)"""


@query(SECTIONS_SQL + " SELECT output_id, section, count(*) AS n FROM a GROUP BY 1, 2")
def log_sections(spark, sf_dir):
    return logs.with_section(section_log(spark, sf_dir)).groupBy("output_id", "section").agg(F.count(F.lit(1)).alias("n"))


@query(SECTIONS_SQL + r""", b AS (SELECT *, section = 'PASSES' AS inside, section = 'PASSES' AND (starts_with(text, '====') OR starts_with(text, '____')) AS opens FROM a),
c AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY output_id ORDER BY seq) AS test, inside AND NOT opens AND contains(text, 'error') AS trouble FROM b),
e AS (SELECT *, bool_or(trouble) OVER (PARTITION BY output_id, test) AS keeps, bool_or(trouble) OVER (PARTITION BY output_id) AS some_ FROM c)
SELECT output_id, seq, text FROM e WHERE NOT (inside AND NOT (trouble OR (opens AND (keeps OR (starts_with(text, '====') AND some_)))))""")
def compact_sections(spark, sf_dir):
    return logs.drop_passes_section(section_log(spark, sf_dir)).filter("label is null").select("output_id", "seq", "text")


# A log for each user's events; few texts, so runs occur.
EVENTS = "ev AS (SELECT CAST(user_id AS VARCHAR) AS output_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, strftime(ts, '%Y-%m-%d %H:%M:%S') || ' [' || CASE WHEN event_type IN ('view', 'click', 'signup', 'purchase') THEN 'info] request' ELSE 'error] failed' END AS text FROM events)"


def event_log(spark, sf_dir):
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = table(spark, sf_dir, "events")
    text = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" ["), F.when(F.col("event_type").isin("view", "click", "signup", "purchase"), "info] request").otherwise("error] failed"))
    return rows.select(F.col("user_id").cast("string").alias("output_id"), F.row_number().over(order).cast("bigint").alias("seq"), text.alias("text"))


@query(f"""WITH {EVENTS}, k AS (SELECT *, 'T' || substr(text, 20) AS key FROM ev), r AS (SELECT *, sum(CASE WHEN key = p THEN 0 ELSE 1 END) OVER (PARTITION BY output_id ORDER BY seq) AS run FROM (SELECT *, lag(key) OVER (PARTITION BY output_id ORDER BY seq) AS p FROM k)),
z AS (SELECT *, count(*) OVER (PARTITION BY output_id, run) AS run_size, row_number() OVER (PARTITION BY output_id, run ORDER BY seq) AS run_place FROM r)
SELECT output_id, seq, text, run_size, run_place FROM z WHERE NOT (run_size >= 5 AND run_place > 1 AND run_place < run_size)""")
def log_runs_collapse(spark, sf_dir):
    return logs.repeat_runs(event_log(spark, sf_dir)).filter("label is null").select("output_id", "seq", "text", "run_size", "run_place")


@query(f"WITH {EVENTS} SELECT output_id, seq, 'T' || substr(text, 20) AS key FROM ev")
def masked_log_lines(spark, sf_dir):
    return event_log(spark, sf_dir).select("output_id", "seq", mask_times(F.col("text")).alias("key"))


DIAG_TEXT = "'src/m' || l_suppkey || '.ts(' || l_linenumber || ',' || CAST(l_quantity AS INT) || '): error TS' || (l_partkey % 20) || ': wrong type of argument'"
DIAGS = log_sql(DIAG_TEXT) + """, dg AS (SELECT output_id, seq, text, regexp_extract(text, '^([^(]*)', 1) AS path, regexp_extract(text, '[(]([0-9]+,[0-9]+)[)]', 1) AS pos, regexp_extract(text, ': (error.*)$', 1) AS message FROM lg)"""


def diag_log(spark, sf_dir):
    s = lambda c: F.col(c).cast("string")
    text = F.concat(F.lit("src/m"), s("l_suppkey"), F.lit(".ts("), s("l_linenumber"), F.lit(","), F.col("l_quantity").cast("int").cast("string"), F.lit("): error TS"), (F.col("l_partkey") % 20).cast("string"), F.lit(": wrong type of argument"))
    return log(items(spark, sf_dir), text)


@query(DIAGS + " SELECT output_id, seq, path, pos, message FROM dg")
def diag_parse(spark, sf_dir):
    return logs.diagnostics(diag_log(spark, sf_dir)).select("output_id", "seq", "path", "pos", "message")


@query(DIAGS + " SELECT output_id, seq FROM (SELECT *, row_number() OVER (PARTITION BY output_id, path, pos, message ORDER BY seq) AS r FROM dg) WHERE r > 1")
def diag_duplicates(spark, sf_dir):
    return logs.diagnostic_labels(logs.diagnostics(diag_log(spark, sf_dir))).filter("label = 'duplicate diagnostic lines'").select("output_id", "seq")


@query(DIAGS + """, f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY output_id, path, pos, message ORDER BY seq) AS r FROM dg) WHERE r = 1),
g AS (SELECT output_id, message, min(seq) AS lead_, count(*) AS n, sum(length(text) + 1) AS chars, sum(length(pos) + 1) AS pc FROM f GROUP BY 1, 2), pp AS (SELECT output_id, message, sum(length(path) + 2) AS pl FROM (SELECT DISTINCT output_id, message, path FROM f) GROUP BY 1, 2),
ok AS (SELECT output_id, message, lead_ FROM g JOIN pp USING (output_id, message) WHERE n >= 3 AND pc + pl + length(message) + 60 < chars),
w AS (SELECT f.output_id, f.message, f.path, min(f.seq) AS first, count(*) AS n, f.path || ' ' || string_agg(pos, ' ' ORDER BY seq) AS t FROM f JOIN ok ON f.output_id = ok.output_id AND f.message = ok.message WHERE seq <> lead_ GROUP BY 1, 2, 3)
SELECT output_id, message, CAST(sum(n) AS BIGINT) AS places, string_agg(t, '; ' ORDER BY first) AS listed FROM w GROUP BY 1, 2""")
def diag_group_places(spark, sf_dir):
    return logs.places(logs.diagnostics(diag_log(spark, sf_dir))).select("output_id", "message", "places", "listed")


GO_TEXT = f"CASE WHEN l_linenumber <= 2 THEN '=== RUN   Test' || l_partkey WHEN l_linestatus = 'F' THEN '    --- PASS: Test' || l_partkey ELSE '    log ' || {NAME_SQL} END"


@query(log_sql(GO_TEXT, "FAIL\tpkg\t1.2s".replace("\t", " ")) + r""", n AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY output_id ORDER BY seq), '') AS nxt FROM lg)
SELECT output_id, seq, text FROM n WHERE NOT (contains(text, '--- PASS') OR (starts_with(text, '=== RUN') AND (starts_with(nxt, '=== RUN') OR contains(nxt, '--- PASS') OR starts_with(nxt, 'FAIL'))))""")
def lookahead_headers(spark, sf_dir):
    part = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_linenumber") <= 2, F.concat(F.lit("=== RUN   Test"), part)).when(passed(), F.concat(F.lit("    --- PASS: Test"), part)).otherwise(F.concat(F.lit("    log "), name()))
    return logs.drop_go_headers(log(items(spark, sf_dir), text, "FAIL pkg 1.2s")).filter("label is null").select("output_id", "seq", "text")


SURE_TEXT = "CASE WHEN l_linenumber % 2 = 1 THEN '[INFO] Running a.Test' || l_orderkey ELSE '[INFO] Tests run: 3, Failures: ' || CASE WHEN l_linestatus = 'F' THEN 0 ELSE 1 END || ', Errors: 0, Skipped: 0, Time elapsed: 0.1 s - in a.Test' || l_orderkey END"


@query(log_sql(SURE_TEXT) + r""", n AS (SELECT *, coalesce(lead(text) OVER (PARTITION BY output_id ORDER BY seq), '') AS nxt, bool_or(contains(text, 'Tests run')) OVER (PARTITION BY output_id) AS on_ FROM lg)
SELECT output_id, seq, text FROM n WHERE NOT (on_ AND (contains(text, 'Failures: 0,') OR (contains(text, 'Running') AND contains(nxt, 'Failures: 0,') AND regexp_extract(text, '(a[.]Test[0-9]+)$', 1) = regexp_extract(nxt, '(a[.]Test[0-9]+)$', 1))))""")
def lookbehind_running(spark, sf_dir):
    order = F.col("l_orderkey").cast("string")
    text = F.when(F.col("l_linenumber") % 2 == 1, F.concat(F.lit("[INFO] Running a.Test"), order)).otherwise(
        F.concat(F.lit("[INFO] Tests run: 3, Failures: "), F.when(passed(), "0").otherwise("1"), F.lit(", Errors: 0, Skipped: 0, Time elapsed: 0.1 s - in a.Test"), order)
    )
    return logs.drop_surefire(log(items(spark, sf_dir), text)).filter("label is null").select("output_id", "seq", "text")


COVER_TEXT = "CASE WHEN l_linenumber = 1 THEN 'TOTAL 10 0 100%' ELSE 'src/m' || l_partkey || '.py 20 ' || CASE WHEN l_linestatus = 'F' THEN '0 100%' ELSE '5 75%' END END"


@query(log_sql(COVER_TEXT, first="Name  Stmts  Miss  Cover") + " SELECT output_id, seq, text FROM lg WHERE NOT (starts_with(text, 'src/') AND ends_with(text, ' 100%'))")
def coverage_full_rows(spark, sf_dir):
    part = F.col("l_partkey").cast("string")
    text = F.when(F.col("l_linenumber") == 1, F.lit("TOTAL 10 0 100%")).otherwise(F.concat(F.lit("src/m"), part, F.lit(".py 20 "), F.when(passed(), "0 100%").otherwise("5 75%")))
    return logs.drop_covered(log(items(spark, sf_dir), text, first="Name  Stmts  Miss  Cover")).filter("label is null").select("output_id", "seq", "text")


# A pytest log for each supplier: a progress line for each order, then a summary that lists failures (of most suppliers all of them).
FAILURES = "CASE WHEN l_linenumber = 1 THEN 'a.py ..' || CASE WHEN l_linestatus = 'F' THEN '.F' ELSE 'F.' END ELSE '.x.' END"
LISTED_SQL = f"""WITH {ITEMS}, n AS (SELECT output_id, max(r) AS n, count(*) FILTER (l_linenumber = 1) AS f FROM it GROUP BY 1),
lg AS (SELECT output_id, r + 1 AS seq, {FAILURES} AS text FROM it UNION ALL SELECT DISTINCT output_id, 1, '==== test session starts ====' FROM it UNION ALL SELECT output_id, n + 2, '==== short test summary info ====' FROM n
  UNION ALL SELECT output_id, n + 2 + r, 'FAILED a.py::t' || r FROM n JOIN it USING (output_id) WHERE r <= f - CASE WHEN CAST(output_id AS BIGINT) % 3 = 0 THEN 1 ELSE 0 END)"""


@query(LISTED_SQL + " SELECT output_id, count(*) AS n FROM lg JOIN n USING (output_id) WHERE regexp_matches(text, '^a[.]py [.F]+$') AND CAST(output_id AS BIGINT) % 3 <> 0 GROUP BY 1")
def failing_progress_listed(spark, sf_dir):
    """Progress lines go where the summary lists all their failures, and stay where it leaves one out."""
    rows = items(spark, sf_dir)
    first = F.col("l_linenumber") == 1
    text = F.when(first, F.concat(F.lit("a.py .."), F.when(passed(), ".F").otherwise("F."))).otherwise(".x.")
    sums = rows.groupBy("output_id").agg(F.max("r").alias("n"), F.count_if(first).alias("f"))
    short = F.when(F.col("output_id").cast("bigint") % 3 == 0, 1).otherwise(0)
    listed = rows.join(sums, "output_id").filter(F.col("r") <= F.col("f") - short)
    log_ = log(rows, text, first="==== test session starts ====")
    log_ = log_.unionByName(sums.select("output_id", (F.col("n") + 2).alias("seq"), F.lit("==== short test summary info ====").alias("text")))
    log_ = log_.unionByName(listed.select("output_id", (F.col("n") + 2 + F.col("r")).alias("seq"), F.concat(F.lit("FAILED a.py::t"), F.col("r").cast("string")).alias("text")))
    return logs.counters(logs.failing_progress(log_)).select("output_id", "n")


@query(DIAGS + """, f AS (SELECT *, row_number() OVER (PARTITION BY output_id, path, pos, message ORDER BY seq) AS r FROM dg) SELECT output_id, 'duplicate diagnostic lines' AS label, count(*) AS n, min(seq) AS first FROM f WHERE r > 1 GROUP BY 1""")
def drop_counters(spark, sf_dir):
    rows = logs.diagnostic_labels(logs.diagnostics(diag_log(spark, sf_dir)))
    return logs.counters(rows).filter("label = 'duplicate diagnostic lines'")
