"""Small examples with known answers."""

from pyspark.sql import functions as F

from linesift.functions import text
from linesift.operators import evaluate, lines, logs, memory, parse, paths, rank

LINES = "output_id string, seq long, path string, number long, text string, is_match boolean"


def rows(spark, *data, path="a.py"):
    return spark.createDataFrame([("o", i, path, n, t, m) for i, (n, t, m) in enumerate(data)], LINES)


def test_terms(spark):
    got = spark.range(1).select(text.terms(F.lit("ExecuteC max_columns checks")).alias("t")).first()["t"]
    assert got == ["executec", "execut", "max", "column", "check"]


def test_scalars(spark):
    r = spark.range(1).select(
        text.tokens(F.lit("abcde")).alias("t"), text.clip(F.lit("abcdef"), 4).alias("c"), text.group_path(F.lit(".\\a\\b.py")).alias("g"), text.folder(F.lit("b.py")).alias("f"),
        text.looks_like_path(F.lit("a b.py")).alias("p"), text.mask_times(F.lit("2024-01-02 03:04:05 x  ")).alias("m"),
    ).first()
    assert tuple(r) == (2, "abcd…[+2 chars]", "a/b.py", ".", False, "T x")


def test_match_beats_context(spark):
    got = lines.dedupe_lines(rows(spark, (5, "x", False), (6, "y", True), (5, "x", True))).orderBy("number").collect()
    assert [(r["number"], r["is_match"], r["seq"]) for r in got] == [(5, True, 0), (6, True, 1)]


def test_overlapping_groups_are_one_block(spark):
    data = [(10, "a", False), (11, "b", True), (12, "c", False), (11, "b", False), (12, "c", True), (13, "d", False)]
    b = lines.blocks(lines.dedupe_lines(rows(spark, *data))).collect()
    assert [(r["first"], r["last"], r["matches"]) for r in b] == [(10, 13, 2)]


def test_merge_gap(spark):
    two = rows(spark, (1, "a", True), (4, "b", True))
    assert lines.blocks(two, 0).count() == 2 and lines.blocks(two, 2).count() == 1


def test_units(spark):
    got = rank.with_units(rows(spark, *((n, "x", n in (2, 6)) for n in range(1, 8)))).orderBy("number").collect()
    assert [r["unit"] for r in got] == [1, 1, 1, 1, 2, 2, 2]


def test_split_seen(spark):
    data = [(8, False), (9, True), (10, False), (11, False), (49, True), (50, True), (70, True)]
    seen = {9, 10, 11, 49, 50}
    df = rows(spark, *((n, "x", m) for n, m in [(8, False), (9, False), (10, True), (11, False), (49, False), (50, True), (70, True)])).withColumn("seen", F.col("number").isin(list(seen)))
    got = memory.split_seen(df).filter("kept").orderBy("number").collect()
    assert [r["number"] for r in got] == [8, 9, 10, 70] and data


def test_empty_tables(spark):
    none = spark.createDataFrame([], LINES)
    for f in (lines.dedupe_lines, lines.blocks, lines.ranges, rank.with_units, lines.rendered, lambda x: lines.cap_matches(x, 3), lambda x: lines.file_prefix(x, 2000), lambda x: lines.budget_cap(x, 2000)):
        assert f(none).count() == 0


def test_rollup_of_deep_and_absolute_paths(spark):
    p = [("o", i, f"/usr/lib/p{i % 5}/x{i}.py", 1) for i in range(20)] + [("q", 0, "a.py", 2), ("q", 1, "b/c.py", 3)]
    got = paths.rollup_dirs(spark.createDataFrame(p, "output_id string, seq long, path string, n long"), 3).orderBy("output_id", "place").collect()
    assert sum(r["n"] for r in got if r["output_id"] == "o") == 20
    assert [(r["dir"], r["n"]) for r in got if r["output_id"] == "q"] == [(".", 2), ("b", 3)]


def test_dashed_path(spark):
    raw = spark.createDataFrame([("o", "lib/v-2-api.py:5:x\nlib/v-2-api.py-6-y")], "output_id string, raw string")
    got = parse.flat_content(parse.raw_lines(raw)).orderBy("seq").collect()
    assert [(r["path"], r["number"], r["text"], r["is_match"]) for r in got] == [("lib/v-2-api.py", 5, "x", True), ("lib/v-2-api.py", 6, "y", False)]


def test_model_ranking(spark):
    answer = 'Sure: {"ranking": [3, 9, 3, "x", 1]} done'
    got = spark.range(1).select(rank.ranking(F.lit(answer), F.array(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(3).cast("long"))).alias("r")).first()["r"]
    assert got == [3, 1]


def test_paired_change(spark):
    pairs = spark.createDataFrame([(i, 1.0, 0.8) for i in range(3)], "task long, off double, on double")
    r = evaluate.bootstrap_ratio(pairs, rounds=50).first()
    assert round(r["change"], 6) == round(r["low"], 6) == round(r["high"], 6) == -0.2


def test_lines_that_differ_in_data_never_collapse(spark):
    log = spark.createDataFrame([("o", i, f"10:00:0{i % 10} request {i}") for i in range(8)], "output_id string, seq long, text string")
    assert logs.repeat_runs(log).filter("label is not null").count() == 0


def test_failing_progress_is_dropped_when_listed(spark):
    text_ = ["=== test session starts ===", "a.py ..F", "=== short test summary info ===", "FAILED a.py::t"]
    log = spark.createDataFrame([("o", i, t) for i, t in enumerate(text_)], "output_id string, seq long, text string")
    assert [r["seq"] for r in logs.failing_progress(log).filter("label is not null").collect()] == [1]


def test_citations(spark):
    answers = spark.createDataFrame([("r", "See src/a.py:10 and :14, then b/c.go:7.")], "run string, text string")
    got = evaluate.citations(answers)
    assert sorted((r["path"], r["number"]) for r in got.collect()) == [("b/c.go", 7), ("src/a.py", 10), ("src/a.py", 14)]
    targets = spark.createDataFrame([("x", "src/a.py", 16, 18), ("y", "b/c.go", 1, 4), ("z", "src/a.py", 11, 11)], "target string, path string, first long, last long")
    assert {r["target"]: r["cited"] for r in evaluate.cited(targets, got).collect()} == {"x": True, "y": False, "z": True}


def test_run_metrics(spark):
    rows = [("r", 1, "Bash", '{"command":"rg foo src"}', "x" * 9), ("r", 2, "Bash", '{"command":"rg  foo"}', None), ("r", 3, "Bash", '{"command":"make"}', ""), ("r", 4, "Bash", '{"command":"make"}', "")]
    calls = spark.createDataFrame(rows, "run string, seq long, name string, input string, result string")
    r = evaluate.run_metrics(calls, lambda name, key: key.startswith("rg "), lambda name, key: key == "make").first()
    assert (r["searches"], r["again"], r["reruns"], r["tool_tokens"]) == (2, 1, 1, 3)
