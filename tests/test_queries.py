"""Each registered query against DuckDB, or against its own invariants, over whole tables."""

import json
import re

import pytest

import __spark_entry__
from linesift.operators import read
from linesift.plans import registry, text_queries

from .oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_against_duckdb(spark, name):
    same(registry.QUERIES[name](spark, SF), registry.ORACLE_SQL[name], SF)


def texts_of(spark, name):
    rows = registry.QUERIES[name](spark, SF).collect()
    assert rows and all("error" not in json.loads(r["stats"]) and r["tokens"] <= r["raw_tokens"] for r in rows)
    return rows


def test_the_lossless_view_reads_back(spark):
    """Every match of every output is shown, and no other place."""
    rows = texts_of(spark, "slim_lossless")
    texts = spark.createDataFrame([(r["output_id"], r["text"]) for r in rows], "output_id string, raw string")
    shown, want = (sorted(map(tuple, read.locations(df).collect())) for df in (texts, text_queries.search_outputs(spark, SF)))
    assert shown == want


def test_the_coverage_view_counts_every_match(spark):
    raw = {r["output_id"]: r["raw"] for r in text_queries.search_outputs(spark, SF).collect()}
    indexed = 0
    for r in texts_of(spark, "slim_coverage"):
        stats, lines = json.loads(r["stats"]), r["text"].split("\n")
        total = sum(bool(re.match(r"[^:]+\.txt:\d+:", x)) for x in raw[r["output_id"]].split("\n"))
        assert int(stats["matches_total"]) == total
        if stats.get("view") == "coverage":
            counts = [re.match(r"  (?:\S+): (?:(\d+) match|\d+ files, (\d+) matches)", x) for x in lines]
            assert sum(int(m[1] or m[2]) for m in counts if m) == total
            indexed += 1
    assert indexed


def test_the_path_view_counts_every_path(spark):
    for r in texts_of(spark, "slim_paths"):
        m = re.search(r"\[linesift\] (\d+)/(\d+) paths shown\. Not shown, by directory: (.*)$", r["text"])
        if m:
            assert int(m[1]) + sum(map(int, re.findall(r"\((\d+)\)", m[3]))) == int(m[2]) == int(json.loads(r["stats"])["unique"])


def test_bootstrap(spark):
    r = registry.QUERIES["bootstrap_interval"](spark, SF).first()
    assert r["low"] <= r["change"] <= r["high"]


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[:2] == ["output_id", "path"]
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
