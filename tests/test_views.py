"""Views and compaction over tables of outputs: every layout keeps all locations, nothing is invented, budgets hold."""

import itertools
import json
import re

import pytest
from pyspark.sql import functions as F

from linesift.functions import recognise
from linesift.operators import logs, read
from linesift.views.compact import compact_outputs, listed_places
from linesift.views.slim import slim_outputs
from linesift.views.text import Config, dirs_text, view_config


def search_text(files=30, hits=20, context=True, note=""):
    out = []
    for i, n in itertools.product(range(files), range(hits)):
        p, at = f"src/pkg{i % 3}/file{i}.py", 10 * n + 5
        out += [f"{p}-{at - 1}-    # before"] * context + [f"{p}:{at}:    value = compute_{n}(alpha){note}"]
    return "\n".join(out)


ENV = "\n".join(f"svc/{i % 4}/f{i}.js:{n}:  const x{n} = process.env.KEY_{(i * n) % 25} || 'd{i}-{n}'" for i in range(40) for n in range(1, 12))
PLAIN = "\n".join(f"some words about nothing {i}: a b" for i in range(900))
PATHS, COUNTS = "\n".join(f"a/b/c{i}.py" for i in range(400)), "\n".join(f"a/b/c{i}.py:{i}" for i in range(400))
MIXED = "src/\n  a.py:3:x\n  b.py\n    7:y\n    --\n    9-z\n\nc.py\n1:one\n\n[linesift] 3 matches are this same line: same text\n  d.py:1,2\n  e.py:5\nf.py:4:w"


def outputs(spark, **raws):
    rows = [(k, *(v if isinstance(v, tuple) else (v, "", ""))) for k, v in raws.items()]
    return spark.createDataFrame(rows, "output_id string, raw string, intent string, pattern string")


def slim(spark, config, kind=None, seen=None, **raws):
    return {r["output_id"]: (r["text"], json.loads(r["stats"]), r["tokens"], r["raw_tokens"]) for r in slim_outputs(outputs(spark, **raws), config, kind, seen=seen).collect()}


def places(spark, **raws):
    found: dict = {k: set() for k in raws}
    for r in read.locations(outputs(spark, **raws)).collect():
        found[r["output_id"]].add((r["path"], r["number"]))
    return found


def test_reading(spark):
    raws = {
        "mixed": MIXED, "empty": "", "counts": "a.py:3\nb.py:4", "below": "a/\n  x.py:1\n  y.py:2", "flat": "a.py:3:x", "bare": "3:x\n4-y", "paths": "a.py\nb.py\nd/\n  x.py\n  y.py", "events": '{"type":"begin","data":{}}\n{"type":"match","data":{"path":{"text":"q"},"lines":{"text":"a\\nb\\n"},"line_number":4}}\nbroken',
        "marked": "> a.py:1:x\n  a.py:2:y", "framed": "Found 2 lines\n\nx.py:1:a\nx.py-2-b\n\n(Results are truncated)", "unused": "heading.py\nnothing at all here\nz.py:1:k", "dashed": "a-1-b.py:7:m\na-1-b.py-8-n", "null": None,
    }
    found = read.Reading(outputs(spark, **raws))
    kinds = {r["output_id"]: r["kind"] for r in found.kinds.collect()}
    assert kinds == {"mixed": "content", "empty": "paths", "counts": "count", "below": "count", "flat": "content", "bare": "content", "paths": "paths", "events": "content", "marked": "content", "framed": "content", "unused": "content", "dashed": "content", "null": "paths"}
    rows: dict = {}
    for r in found.rows.orderBy("seq").collect():
        rows.setdefault(r["output_id"], []).append((r["path"], r["number"], r["text"], r["is_match"]))
    assert rows["mixed"] == [("src/a.py", 3, "x", True), ("src/b.py", 7, "y", True), ("src/b.py", 9, "z", False), ("c.py", 1, "one", True), ("d.py", 1, "same text", True), ("d.py", 2, "same text", True), ("e.py", 5, "same text", True), ("f.py", 4, "w", True)]
    assert rows["bare"] == [("", 3, "x", True), ("", 4, "y", False)] and rows["events"] == [("q", 4, "a", True), ("q", 5, "b", True)]
    assert rows["marked"] == [("a.py", 1, "x", True), ("a.py", 2, "y", False)] and rows["framed"] == [("x.py", 1, "a", True), ("x.py", 2, "b", False)]
    assert rows["dashed"] == [("a-1-b.py", 7, "m", True), ("a-1-b.py", 8, "n", False)]
    assert {tuple(r)[1:] for r in found.unread.filter("output_id = 'unused'").collect()} == {(1, "heading.py"), (2, "nothing at all here")}
    assert [r["path"] for r in found.paths.filter("output_id = 'paths'").orderBy("seq").collect()] == ["a.py", "b.py", "d/x.py", "d/y.py"]
    assert [tuple(r) for r in found.frame.collect()] == [("framed", "Found 2 lines", "(Results are truncated)")]


def test_lossless(spark):
    raws = {"context": search_text(20, 12), "bare": search_text(context=False), "short": search_text(8, 8, False, " # x"), "env": (ENV, "", "process.env"), "tiny": search_text(3, 3), "paths": PATHS, "counts": COUNTS, "plain": PLAIN, "mixed": MIXED}
    got = slim(spark, view_config("lossless", max_tokens=2400, trigger_tokens=0), **raws)
    assert {k: v[1]["level"] for k, v in got.items()} == {"context": "L1-matches", "bare": "L1", "short": "L1", "env": "L2", "tiny": "L1", "paths": "L1", "counts": "L0", "plain": "L0", "mixed": "L1"}
    kept = ("context", "bare", "short", "tiny", "mixed")
    assert places(spark, **{k: got[k][0] for k in kept}) == places(spark, **{k: raws[k] for k in kept})
    assert all(v[2] <= v[3] for v in got.values()) and got["plain"][0] == PLAIN
    text, stats, *_ = got["env"]
    assert stats["recogniser"] == "env" and stats["matches_kept"] == "440" and stats["names"] == "25"
    want = {(f"svc/{i % 4}/f{i}.js", n, f"KEY_{(i * n) % 25}") for i in range(40) for n in range(1, 12)}
    have, base = set(), ""
    for line in text.split("\n")[1:-1]:
        if "  " not in line.strip():
            base = line.strip()
        else:
            path, _, names = line.strip().partition("  ")
            have |= {(base + path, int(x.split(":")[1]), x.split(":")[0]) for x in names.split(" ")}
    assert have == want
    listed = read.Reading(outputs(spark, paths=got["paths"][0], counts=got["counts"][0]))
    assert {r["path"] for r in listed.paths.collect()} == set(PATHS.split("\n")) and {f"{r['path']}:{r['count']}" for r in listed.counts.collect()} == set(COUNTS.split("\n"))


@pytest.mark.parametrize("view", ["notes", "coverage"])
def test_budgets(spark, view):
    raw = search_text()
    got = slim(spark, Config(view=view, max_tokens=900), plain=raw, asked=(raw, "compute alpha", "compute"), paths=PATHS, counts=COUNTS, fits=search_text(2, 2, False), null=None)
    mine = {line.replace(":", "-") for line in raw.split("\n")}
    for k in ("plain", "asked"):
        text, stats, tokens, _ = got[k]
        assert tokens <= 960 and 0 < int(stats["matches_kept"]) < int(stats["matches_total"]) == 600
        body = [x for x in text.split("\n") if x.startswith("src/")]
        assert body and {x.replace(":", "-") for x in body} <= mine and sum(bool(re.match(r"[^:]*:\d+:", x)) for x in body) == int(stats["matches_kept"])
        if view == "coverage":
            rows = re.findall(r"^  (\S+): (\d+) (?:files, (\d+) )?match", text, re.M)
            assert sum(int(b or a) for _, a, b in rows) == 600
        else:
            named = text.split("Not shown")[1]
            assert sum(map(int, re.findall(r"\((\d+)\)", named))) == 600 - int(stats["matches_kept"])
    assert got["fits"][0] == search_text(2, 2, False) and got["null"][0] == ""
    assert all(v[2] <= 960 for v in got.values())
    assert int(re.search(r"\[linesift\] (\d+)/400 paths shown", got["paths"][0])[1]) + int(re.search(r"a/b/ \((\d+)\)", got["paths"][0])[1]) == 400


def test_listings(spark):
    tree = [f"{'│   ' * d}├── n{i}" for i in range(30) for d in range(4)]
    ls = "\n".join([".:", "a", "b", ""] + [x for d in "abc" for x in (f"./{d}/deep:", *(f"file_number_{i}" for i in range(40)), "")])
    got = slim(spark, Config(max_tokens=300), "lines", tree="\n".join(tree), ls=ls, flat="\n".join(f"line {i}" for i in range(400)), small="a\nb")
    assert "60/120 lines shown: 60 entries deeper than level 2 not shown (under n0/n0/ (2)" in got["tree"][0] or "entries deeper than level" in got["tree"][0]
    assert "3 deeper directories not listed (120 entries)" in got["ls"][0] and "lines not shown" in got["flat"][0] and got["small"][0] == "a\nb"


def test_seen_lines_come_once(spark):
    raw = search_text(12, 24, False)
    first = slim(spark, Config(max_tokens=900), a=raw)["a"][0]
    shown = read.Reading(outputs(spark, a="\n".join(x for x in first.split("\n") if not x.startswith("["))), "content").rows
    again = slim(spark, Config(max_tokens=900), seen=shown.select("output_id", "path", "number", "text"), a=raw)["a"][0]
    lines = lambda t: {x for x in t.split("\n") if x.startswith("src/")}
    assert lines(again) and not lines(first) & lines(again) and "matching lines already shown: src/pkg0/file0.py:" in again


def test_absolute_directories_share_a_base(spark):
    rows = spark.createDataFrame([("a", 1, "/home/me/project/x", 3), ("a", 2, "/home/me/project/y/z", 1), ("a", 3, "+2 other dirs", 2), ("b", 1, "x", 1), ("b", 2, "y", 2)], "output_id string, place long, dir string, n long")
    assert {tuple(r) for r in dirs_text(rows).collect()} == {("a", "under /home/me/project/: x/ (3), y/z/ (1), +2 other dirs (2)"), ("b", "x/ (1), y/ (2)")}


@pytest.mark.parametrize("kind,line,names", [
    ("env", "a = process.env.KEY || process.env['B']", ["KEY", "B"]), ("env", 'os.environ.get("HOME")', ["HOME"]), ("env", "$env:PATH", ["PATH"]), ("import", "import os.path", ["os.path"]), ("import", "from a.b import c", ["a.b"]),
    ("import", "import x from 'y'", ["y"]), ("import", "using System.Text;", ["System.Text"]), ("require", "const a = require('b'), c = require(\"d\")", ["b", "d"]), ("definition", "func (s *Server) Start() {", ["Server.Start"]),
    ("definition", "pub(crate) async fn go()", ["go"]), ("definition", "  async def f(x):", ["f"]), ("definition", "export default class A extends B", ["A"]), ("route", "app.get('/x', h)", ["get /x"]), ("route", '@PostMapping("/y")', ["Post /y"]),
    ("route", "map.get('x')", []), ("config key", 'config.get("a.b")', ["a.b"]), ("config key", "settings.DEBUG", ["DEBUG"]), ("config key", '@Value("${k.v:1}")', ["k.v"]), ("dependency", '"left-pad": "^1.2.0",', ["left-pad ^1.2.0"]),
    ("dependency", "requests>=2.0", ["requests >=2.0"]), ("dependency", "\tgithub.com/a/b v1.2.3", ["github.com/a/b v1.2.3"]), ("dependency", 'serde = { version = "1.0" }', ["serde 1.0"]),
])
def test_names(spark, kind, line, names):
    assert spark.range(1).select(recognise.names_in(F.lit(line), kind)).first()[0] == names


# --- logs ----------------------------------------------------------------------------------

PYTEST = ["=== test session starts ===", "tests/test_b.py ..s.  [ 10%]", *(f"tests/test_a.py::test_{i} PASSED  [ {i}%]" for i in range(60)), "=== PASSES ===", "___ test_q ___", "output of q", "___ test_r ___", "a warning here", "=== FAILURES ===", "____ test_x ____", "E  assert 1 == 2", "=== short test summary info ===", "FAILED tests/test_a.py::test_x", "=== 1 failed, 60 passed in 1.0s ==="]
TYPES = [f"src/m{i % 3}/a{i % 7}.ts({i},3): error TS{i % 2}: wrong type" for i in range(80)]
RUST = [x for i in range(9) for x in ("warning: unused variable: `x`", f"  --> src/lib{i}.rs:{i}:5", "   |", f"{i}  |     let x = 1;", "   |         ^ help: prefix it", "")]
ESLINT = [x for i in range(12) for x in (f"/repo/packages/src/file{i}.js", "  3:1  error  Unexpected var, use let or const instead  no-var", f"  {i}:2  warning  Missing semicolon at the end of the statement  semi", "")]
GCC = [x for i in range(8) for x in (f"src/a{i}.c: In function 'f{i}':", f"src/a{i}.c:{i}:3: warning: unused variable 'x'", f"    {i} |   int x;", "      |       ^")]
WARNINGS = ["=== warnings summary ===", *(x for i in range(12) for x in (f"tests/test_a.py::test_{i}", f"  /src/pkg/mod{i}.py:{i}: DeprecationWarning: old thing is going away soon", f"    call_{i}()", "")), "-- Docs: https://x", "=== 12 passed in 1s ==="]
JEST = ["PASS src/a.test.js", "  ok thing", "FAIL src/b.test.js", "  ● b fails", "    expected 1", "  ✓ fine (2 ms)", "PASS src/c.test.js", "  console.warn careful", *(f"  ✓ test number {i} is fine ({i} ms)" for i in range(20)), "", "Summary of all failing tests", "FAIL src/b.test.js", "  ● b fails", "    expected 1", "", "Test Suites: 1 failed, 2 passed", "Tests: 1 failed"]
TIMES = [f"2024-01-01 00:00:{i:02d} waiting for the server to come up" for i in range(50)] + ["done " + "z" * 40]


@pytest.fixture(scope="module")
def compacted(spark):
    raws = {"pytest": PYTEST, "types": TYPES, "rust": RUST, "eslint": ESLINT, "gcc": GCC, "warnings": WARNINGS, "jest": JEST, "times": TIMES, "none": [f"line {i} {i * i}" for i in range(900)]}
    df = compact_outputs(outputs(spark, **{k: "\n".join(v) for k, v in raws.items()}, null=None), 0)
    return raws, {r["output_id"]: (r["text"], json.loads(r["stats"])) for r in df.collect()}


def test_kept_lines_are_an_ordered_subsequence(compacted):
    raws, got = compacted
    for k, lines in raws.items():
        left = iter(lines)
        shown = [x for x in got[k][0].split("\n") if not x.startswith(("[linesift]", "  mod", "  /src", "  src"))]
        assert all(x in left for x in shown), (k, got[k])
    assert got["none"] == ("\n".join(raws["none"]), {"level": "L0"}) and got["null"][0] == ""


def test_test_logs(compacted):
    _, got = compacted
    text, stats = got["pytest"]
    assert stats["dropped"] == {"passing/skipped test lines": 60, "all-pass progress lines": 1, "passing test output lines": 2} and "assert 1 == 2" in text and "a warning here" in text and "output of q" not in text
    text, stats = got["jest"]
    assert stats["dropped"] == {"passing suite lines": 3, "failure lines repeated in the summary": 2, "passing/skipped test lines": 21} and "careful" in text and text.count("expected 1") == 1
    assert "48 similar lines not shown" in got["times"][0]


def test_diagnostics_are_listed(spark, compacted):
    raws, got = compacted
    listed = {}
    for r in listed_places(spark.createDataFrame([(k, v[0]) for k, v in got.items()], "output_id string, text string")).collect():
        listed.setdefault(r["output_id"], set()).add((r["path"], r["pos"]))
    place = lambda x: re.match(r"([^(:\s]+)[(:](\d+[,:]\d+)", x.strip().removeprefix("--> "))
    for k in ("types", "rust", "gcc"):
        want = {m.groups() for m in map(place, raws[k]) if m}
        have = {m.groups() for m in map(place, got[k][0].split("\n")) if m and not m.string.startswith("[")} | listed[k]
        assert want == have, (k, want ^ have)
        assert len(got[k][0]) < 0.6 * len("\n".join(raws[k]))
    text = got["eslint"][0]
    assert "11 more places with this same diagnostic (error  Unexpected var, use let or const instead  no-var), under /repo/packages/src/" in text and text.count("no-var") == 2
    assert text.count("/repo/packages/src/file") == 1 and "\n\n\n" not in text and listed["eslint"] >= {(f"/repo/packages/src/file{i}.js", "3:1") for i in range(1, 12)}
    assert got["gcc"][0].count("In function") == 1


def test_warnings_are_listed(compacted):
    text, _ = compacted[1]["warnings"]
    assert "11 more places with this same warning" in text and all(f"mod{i}.py:{i}" in text for i in range(12)) and "call_11()" in text


def test_a_long_log_is_walked_by_windows(spark):
    lines = spark.range(1_000_000).select(F.lit("a").alias("output_id"), (F.col("id") + 1).alias("seq"), F.concat(F.lit("test t"), F.col("id").cast("string"), F.when(F.col("id") % 10 == 0, " ... FAILED").otherwise(" ... ok")).alias("text"))
    last = spark.createDataFrame([("a", 1_000_001, "test result: FAILED.")], "output_id string, seq long, text string")
    assert logs.drop_passing(lines.unionByName(last), "cargo").filter("label is null").count() == 100_001
