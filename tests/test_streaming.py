"""A stream of events in micro-batches shows each line once, until an edit or a clear."""

import json
import os

import numpy as np
from pyspark.sql import functions as F

from linesift.sources import outputs
from linesift.operators import evaluate
from linesift.streaming import session, store


def test_session_stream(spark, tmp_path):
    e = lambda kind, key, ns, file="f": {"session": "s", "kind": kind, "file": file, "key": key, "ns": ns}
    batches = [[e("shown", "a", 1), e("shown", "b", 2)], [e("shown", "a", 3), e("shown", "c", 4)], [e("edit", "", 5), e("shown", "a", 6), e("shown", "b", 7, "g")], [e("clear", "", 8), e("shown", "c", 9)]]
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(batches):
        f = tmp_path / "in" / f"{i}.json"
        f.write_text("\n".join(map(json.dumps, rows)))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(session.EVENTS).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    parts = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")  # fixed by the checkpoint from the first start on
    got = []
    q = (
        session.fresh_lines(stream).writeStream.option("checkpointLocation", str(tmp_path / "check")).outputMode("append")
        .foreachBatch(lambda df, _: got.append(sorted(r["key"] for r in df.collect()))).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    assert [x for x in got if x] == [["a", "b"], ["c"], ["a", "b"], ["c"]]
    every = spark.createDataFrame([tuple(r.values()) for b in batches for r in b], session.EVENTS)
    assert [r["key"] for r in session.replay(every).collect()] == ["c"]


def test_store(spark, tmp_path):
    """Parts are united, merged with their oldest times, and cut by edits, fingerprints, clearing and idleness."""
    s = store.SessionStore(spark, f"file://{tmp_path}/memory")
    day = 24 * 3600 * 10**9
    folder = tmp_path / "src"
    folder.mkdir()
    (folder / "a.py").write_text("one")
    os.utime(folder / "a.py", (1_700_000_000, 1_700_000_000))
    now = 1_700_000_100 * 10**9
    assert s.seen().count() == 0
    assert s.fingerprint(f"file://{folder}", now_ns=now) == 1 and s.fingerprint(f"file://{folder}", now_ns=now) == 0
    assert s.fingerprint(f"file://{folder}", now_ns=1_700_000_001 * 10**9) == 1  # too recent to trust its time
    raws = [("x", "a.py:1:one\nb.py:2:two", str(folder)), ("y", "a.py:1:one", str(folder)), ("x-sub", "a.py:1:one\n" + "z" * 40_000, str(folder))]
    s.record_outputs(spark.createDataFrame(raws, "session string, raw string, cwd string"), 10 * day)
    seen = lambda: sorted((r["session"], (r["file"] or "").removeprefix(str(folder))) for r in s.seen().collect())
    assert seen() == [("x", "/a.py"), ("x", "/b.py"), ("x-sub", "/a.py"), ("y", "/a.py")]
    s.record_keys(spark.createDataFrame([("y", "bare")], "session string, key string"), 10 * day)
    s.record_lines(spark.createDataFrame([("x", str(folder / "b.py"), 2, "two")], "session string, path string, number int, text string"), 12 * day)
    s.invalidate(spark.createDataFrame([("x", str(folder / "b.py"))], "session string, file string"), 11 * day)
    assert ("x", "/b.py") in seen()  # shown again after the edit
    assert s.merge_parts(2) and ("x", "/b.py") not in seen() and ("x", "/a.py") in seen()  # the merged line has its oldest time
    (folder / "a.py").write_text("changed")
    assert s.fingerprint(f"file://{folder}", now_ns=now) == 1
    assert seen() == [("y", "")]
    s.clear(["x"], 13 * day)
    assert seen() == [("y", "")] and s.files().count() == 1
    assert s.prune(14 * day) == ["x-sub", "y"] or set(s.prune(14 * day)) <= {"x-sub", "y"}
    assert seen() == []


def test_visible_parts_and_paths(spark):
    text = "line\n" * 10_000
    rows = spark.createDataFrame([(text, "b/../c/./d.py", "/home/x"), ("short", "/abs", "/home/x"), ("y" * 40_000, "", "/")], "t string, p string, c string")
    got = rows.select(store.visible_part(F.col("t")), store.absolute(F.col("p"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(("line\n" * 360)[:-1], "/home/x/c/d.py"), ("short", "/abs"), ("", "")]
    assert spark.range(1).select(store.session_key(F.lit("s"), F.lit("a")), store.session_key(F.lit("s"), F.lit(None).cast("string"))).first()[:] == ("s-a", "s")


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"x \xff y")
    assert outputs.read_outputs(spark, str(tmp_path)).first()["raw"] == "x � y"
    (tmp_path / "t.jsonl").write_text('{"type":"user","message":{"role":"user","content":"find it"}}\nnot json\n{"type":"assistant","message":{"role":"assistant","content":[{"type":"text","text":"look"},{"type":"tool_use","id":"1"}]}}\n')
    r = outputs.query_of(outputs.read_transcripts(spark, str(tmp_path / "t.jsonl"))).first()
    assert (r["intent"], r["subtask"]) == ("find it", "look")
    outputs.register(spark)
    rows = spark.read.format("command").option("commands", "echo hi\nno-such-program x").load().orderBy("code").collect()
    assert [(r["raw"], r["code"]) for r in rows] == [("hi\n", 0), ("", 127)]


def test_tool_calls(spark):
    use = '{"message":{"content":[{"type":"tool_use","id":"1","name":"Grep","input":{"pattern":"x"}}]}}'
    result = '{"message":{"content":[{"type":"tool_result","tool_use_id":"1","content":"a.py:1:x"}]}}'
    rows = outputs.tool_calls(spark.createDataFrame([("r", 1, use), ("r", 2, result)], "run string, seq long, line string")).collect()
    assert [(r["name"], r["result"]) for r in rows] == [("Grep", "a.py:1:x")]


def test_reports(spark, tmp_path):
    rows = spark.createDataFrame([("a|b", 1.23456, None), ("c", 2.0, "x\ny")], "k string, v double, n string")
    assert evaluate.markdown(rows) == "| k | v | n |\n| - | - | - |\n| a\\|b | 1.235 |  |\n| c | 2 | x y |"
    evaluate.write_markdown(rows, f"file://{tmp_path}/r", "Title")
    assert spark.read.text(f"file://{tmp_path}/r", wholetext=True).first()[0].startswith("# Title\n\n| k | v | n |")


def test_bootstrap(spark):
    """The interval doesn't depend on the partitioning, and is that of normal theory."""
    rng = np.random.default_rng(3)
    off = rng.uniform(1, 9, 4000)
    on = off * rng.normal(0.8, 0.1, 4000)
    rows = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(off, on))], "k long, off double, on double")
    one, two = (tuple(evaluate.bootstrap_ratio(rows.repartition(n)).first()) for n in (1, 7))
    assert np.allclose(one, two, rtol=1e-9)
    ratio = on.sum() / off.sum()
    error = np.sqrt(((on - ratio * off) ** 2).sum()) / off.sum()
    assert np.isclose(one[0], ratio - 1) and np.isclose(one[1], ratio - 1 - 1.96 * error, atol=0.15 * error) and np.isclose(one[2], ratio - 1 + 1.96 * error, atol=0.15 * error)
