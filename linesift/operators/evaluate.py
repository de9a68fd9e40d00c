"""Measuring what a reduction kept: evidence, recall, savings, paired comparison."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STATUS = ("kept", "recoverable", "lost")


def evidence_status(anchors: DataFrame, shown: DataFrame, named: DataFrame) -> DataFrame:
    """anchors: anchor, path, number (null: any line), critical. shown: path, number. named: path or directory that a note names.

    Adds status: kept if the place is shown; recoverable if the path, or a directory above it, is named; else lost.
    """
    exact = shown.select("path", "number").distinct().withColumn("here", F.lit(True))
    files = shown.select("path").distinct().withColumn("file", F.lit(True))
    names = named.select(F.col("path").alias("name")).distinct()
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    told = anchors.select("anchor", "path", F.explode(above).alias("name")).join(names, "name").select("anchor").distinct().withColumn("told", F.lit(True))
    rows = anchors.join(exact, ["path", "number"], "left").join(files, "path", "left").join(told, "anchor", "left")
    kept = F.coalesce(F.col("here"), F.col("number").isNull() & F.coalesce("file", F.lit(False)))
    status = F.when(kept, F.lit("kept")).when(F.coalesce("told", F.lit(False)) | F.coalesce("file", F.lit(False)), F.lit("recoverable")).otherwise(F.lit("lost"))
    return rows.select("anchor", "path", "number", "critical", status.alias("status"))


def best_status(rows: DataFrame) -> DataFrame:
    """The best status of each anchor over several steps."""
    rank = F.array_position(F.array(*map(F.lit, STATUS)), F.col("status"))
    return rows.groupBy("anchor").agg(F.min(rank).alias("r")).select("anchor", F.element_at(F.array(*map(F.lit, STATUS)), F.col("r").cast("int")).alias("status"))


def location_recall(wanted: DataFrame, shown: DataFrame) -> DataFrame:
    """output_id, wanted, found: distinct locations of each output, and how many of them are shown."""
    key = ["output_id", "path", "number"]
    all_ = wanted.select(*key).distinct()
    hits = all_.join(shown.select(*key).distinct(), key, "left_semi").groupBy("output_id").agg(F.count(F.lit(1)).alias("found"))
    sums = all_.groupBy("output_id").agg(F.count(F.lit(1)).alias("wanted"))
    return sums.join(hits, "output_id", "left").select("output_id", "wanted", F.coalesce("found", F.lit(0)).cast("bigint").alias("found"))


def invented(body: DataFrame, raw: DataFrame) -> DataFrame:
    """Rows of a reduced body that its raw output doesn't hold: must be none."""
    return body.join(raw.select("output_id", "text").distinct(), ["output_id", "text"], "left_anti")


def order_broken(kept: DataFrame) -> DataFrame:
    """Rows that stand before a row they followed in the raw output: place counts in the reduced output, seq in the raw one."""
    return kept.withColumn("prev", F.lag("seq").over(Window.partitionBy("output_id").orderBy("place"))).filter("seq <= prev")


def workload_aggregates(rows: DataFrame, by: str) -> DataFrame:
    """rows: raw, out, ms. Per group: totals, mean and median saving, and the 95th percentile of ms as element min(n-1, int(.95 n)) of the sorted list.

    The element is found by rank within the group, which Spark sorts and spills; no list is gathered.
    """
    saving = F.when(F.col("raw") > 0, 1 - F.col("out") / F.col("raw")).otherwise(F.lit(0.0))
    rows = rows.withColumn("saving", saving)
    order = Window.partitionBy(by).orderBy("ms")
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    ranked = rows.select(by, "ms", (F.row_number().over(order) - 1).alias("i"), F.least(n - 1, F.floor(n * 0.95)).alias("at"))
    p95 = ranked.filter("i = at").select(by, F.col("ms").alias("p95_ms"))
    sums = rows.groupBy(by).agg(
        F.count(F.lit(1)).alias("n"), F.sum("raw").alias("raw"), F.sum("out").alias("out"), F.round(F.avg("saving"), 6).alias("mean_saving"), F.round(F.median("saving"), 6).alias("median_saving")
    )
    return sums.join(p95, by)


def weighted_mean(rows: DataFrame, weights: DataFrame, by: str, value: str) -> DataFrame:
    """One row: the mean of the groups' means, by weight."""
    means = rows.groupBy(by).agg(F.avg(value).alias("m")).join(weights, by)
    return means.agg(F.round(F.sum(F.col("m") * F.col("weight")) / F.sum("weight"), 6).alias("mean"))


def pairs(rows: DataFrame, key: list[str], mode: str, value: str, off: str = "off", on: str = "on") -> DataFrame:
    """key..., off, on: values of the two modes under one key; pairs that lack one are left out."""
    one = lambda m, name: rows.filter(F.col(mode) == m).groupBy(*key).agg(F.sum(value).alias(name))
    return one(off, "off").join(one(on, "on"), key)


def bootstrap_ratio(pairs_: DataFrame, rounds: int = 2000, seed: int = 7) -> DataFrame:
    """change, low, high: on / off - 1 of the sums, with a 95 % interval from Poisson resampling.

    Each pair is drawn a Poisson(1) number of times a round, by a hash of the pair and the round, so an interval depends
    neither on the order nor on the partitioning. A batch of pairs is a matrix product: what leaves a task is a row a
    round, whatever the number of pairs. Round 0 takes each pair once: the point estimate.
    """
    # Each number of draws up to seven is taken below its cumulated probability.
    below = np.cumsum([np.exp(-1) / math.factorial(k) for k in range(8)])[:-1]

    def draws(pair: np.ndarray) -> np.ndarray:
        x = pair.view(np.uint64)[:, None] + (np.arange(1, rounds + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15)
        for shift, odd in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(odd)
        return np.searchsorted(below, (x >> np.uint64(11)) / float(1 << 53), side="right")

    def sums(batches):
        total = np.zeros((2, rounds + 1))
        for pdf in batches:
            both = pdf[["off", "on"]].to_numpy(float).T
            total[:, 0] += both.sum(1)
            for i in range(0, len(pdf), 1000):
                total[:, 1:] += both[:, i : i + 1000] @ draws(pdf["pair"].to_numpy(np.int64)[i : i + 1000])
        yield pd.DataFrame({"round": np.arange(rounds + 1), "a": total[0], "b": total[1]})

    rows = pairs_.select(F.xxhash64(*pairs_.columns).alias("pair"), F.col("off").cast("double").alias("off"), F.col("on").cast("double").alias("on"))
    found = rows.mapInPandas(sums, "round int, a double, b double").groupBy("round").agg(F.sum("a").alias("a"), F.sum("b").alias("b")).filter("a > 0").withColumn("ratio", F.col("b") / F.col("a") - 1)
    drawn = F.when(F.col("round") > 0, F.col("ratio"))
    return found.agg(F.max(F.when(F.col("round") == 0, F.col("ratio"))).alias("change"), F.percentile(drawn, F.lit(0.025)).alias("low"), F.percentile(drawn, F.lit(0.975)).alias("high"))


def searches_again(calls: DataFrame) -> DataFrame:
    """calls: session, seq, key. Adds refines: an earlier key of the session equals this one, holds it, or is held by it (4 characters or more).

    Keys are compared by the words they share, so a session's calls meet by equi-join, not all with all.
    """
    words = calls.select("session", "seq", "key", F.explode(F.array_distinct(F.split("key", " "))).alias("word"))
    earlier = words.select("session", "word", F.col("seq").alias("s0"), F.col("key").alias("k0"))
    holds = lambda a, b: a.contains(b) & (F.char_length(b) >= 4)
    hit = (F.col("s0") < F.col("seq")) & ((F.col("key") == F.col("k0")) | holds(F.col("key"), F.col("k0")) | holds(F.col("k0"), F.col("key")))
    again = words.join(earlier, ["session", "word"]).filter(hit).select("session", "seq").distinct().withColumn("refines", F.lit(True))
    return calls.join(again, ["session", "seq"], "left").withColumn("refines", F.coalesce("refines", F.lit(False)))



def citations(answers: DataFrame) -> DataFrame:
    """answers: run, text. run, path, number: places cited as path:N; a bare :N belongs to the path named last before it."""
    token = r"(?:[\w./\\-]*[\w/\\-]\.\w+)?:[0-9]+"
    rows = answers.select("run", F.posexplode(F.regexp_extract_all("text", F.lit(token), F.lit(0))).alias("p", "t"))
    path = F.regexp_extract("t", r"^(.*):[0-9]+$", 1)
    order = Window.partitionBy("run").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("path", F.last(F.when(path != "", path), ignorenulls=True).over(order))
    return rows.filter("path is not null").select("run", "path", F.regexp_extract("t", r":([0-9]+)$", 1).cast("bigint").alias("number")).distinct()


def cited(targets: DataFrame, citations_: DataFrame, near: int = 2) -> DataFrame:
    """targets: target, path, first, last. Adds cited: some citation lies in the range, or at most near lines off it.

    Ranges become the lines that they cover, so the join is by equality.
    """
    lines = targets.select("target", "path", F.explode(F.sequence(F.col("first") - near, F.col("last") + near)).alias("number"))
    hit = lines.join(citations_.select("path", "number").distinct(), ["path", "number"]).select("target").distinct().withColumn("cited", F.lit(True))
    return targets.join(hit, "target", "left").withColumn("cited", F.coalesce("cited", F.lit(False)))


def run_metrics(calls: DataFrame, is_search, is_build) -> DataFrame:
    """calls: run, seq, name, input, result. run, searches, again, reruns, tool_tokens.

    is_search and is_build tell a call's command; again counts searches that refine an earlier one, reruns build
    commands that were run before in the same spelling.
    """
    command = F.coalesce(F.get_json_object("input", "$.command"), F.get_json_object("input", "$.pattern"), F.lit(""))
    rows = calls.withColumn("key", F.lower(F.trim(F.regexp_replace(command, r"\s+", " "))))
    rows = rows.withColumn("search", is_search(F.col("name"), F.col("key"))).withColumn("build", is_build(F.col("name"), F.col("key")))
    found = rows.filter("search").select(F.col("run").alias("session"), "seq", "key")
    again = searches_again(found).groupBy(F.col("session").alias("run")).agg(F.count_if("refines").alias("again"))
    reruns = rows.filter("build").groupBy("run", "key").agg((F.count(F.lit(1)) - 1).alias("n")).groupBy("run").agg(F.sum("n").alias("reruns"))
    sums = rows.groupBy("run").agg(F.count_if("search").alias("searches"), F.sum(F.floor((F.char_length(F.coalesce("result", F.lit(""))) + 3) / 4)).cast("bigint").alias("tool_tokens"))
    return sums.join(again, "run", "left").join(reruns, "run", "left").fillna(0, ["again", "reruns"])


# Words of failures, and the forms of passing status lines that hold them nevertheless.
FAILURE_WORDS = ("error", "errors", "fail", "failed", "failure", "failures", "exception", "traceback", "panicked", "assertionerror")
PASSING_FORMS = (r"^0 (errors|failures|failed)\b", r"\b0 failed\b", r"\b0 errors\b", r"\.\.\. ok$", r" PASSED\b")
PLACE = r"[\w./\\-]+\.[A-Za-z]\w*[:(][0-9]+"


def critical(lines: DataFrame) -> DataFrame:
    """lines: text. Adds critical: the line tells of a failure, or of a place in a source file, and isn't a passing status."""
    words = F.array(*map(F.lit, FAILURE_WORDS))
    failure = F.arrays_overlap(F.split(F.lower(F.regexp_replace("text", "[^A-Za-z]+", " ")), " "), words)
    passing = F.lit(False)
    for form in PASSING_FORMS:
        passing = passing | F.col("text").rlike(form)
    return lines.withColumn("critical", (failure | F.col("text").rlike(PLACE)) & ~passing)


def markdown(rows: DataFrame, most: int = 1000) -> str:
    """A report's table as Markdown; at most so many rows, which a report's reader sees on the driver."""
    cell = lambda v: "" if v is None else (f"{v:.4g}" if isinstance(v, float) else str(v)).replace("|", "\\|").replace("\n", " ")
    found = rows.limit(most).collect()
    table = [rows.columns, ["-"] * len(rows.columns), *([cell(v) for v in r] for r in found)]
    return "\n".join(f"| {' | '.join(r)} |" for r in table)


def write_markdown(rows: DataFrame, path: str, title: str = "") -> None:
    """The Markdown sink: one text file below path, written by Spark, so the path may be in any store."""
    text = (f"# {title}\n\n" if title else "") + markdown(rows)
    rows.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
