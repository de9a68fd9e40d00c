"""compact: raw test and build output in, text without what passed or repeats out, with notes on where the repeats are."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_times, tokens
from ..operators import logs, parse
from ..sources.shared import stored
from .text import gathered, number, tagged

TRIGGER, LEAST_SAVING, LEAST_RUN = 500, 0.1, 5

#: Rules by name, in the order in which they may claim a line; further rules, lines in and lines with label out, can be added.
RULES = {
    "pytest passing": lambda rows: logs.drop_passing(rows, "pytest"), "pytest progress": logs.drop_test_progress, "pytest output": logs.drop_passes_section, "js suites": logs.drop_suites, "js summary": logs.drop_summary_repeats,
    "go": logs.drop_go_headers, "cargo": lambda rows: logs.drop_passing(rows, "cargo"), "dotnet": lambda rows: logs.drop_passing(rows, "dotnet"), "surefire": logs.drop_surefire, "coverage": logs.drop_covered, "progress": logs.drop_progress,
}


def diagnostic_drops(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(output_id, seq, label: lines of repeated diagnostics; output_id, seq, message, places, base, listed: notes).

    A line that owns diagnostics (a function, a file of eslint's) goes if all of them do, with a blank line after them.
    """
    found = stored(logs.records(lines), "records")
    several = found.groupBy("output_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("output_id")
    found = found.join(several, "output_id", "left_semi")
    labels = stored(logs.diagnostic_labels(found), "labels")
    gone = labels.filter("label is not null").select("output_id", F.explode(F.sequence("seq", "last")).alias("seq"), "label")
    owners = labels.filter("owner is not null").groupBy("output_id", F.col("owner").alias("seq")).agg(F.bool_and(F.col("label").isNotNull()).alias("all"), F.min("label").alias("label"), (F.max("last") + 1).alias("after")).filter("all")
    gaps = lines.filter(F.trim("text") == "").select("output_id", "seq").join(owners.select("output_id", F.col("after").alias("seq"), "label"), ["output_id", "seq"])
    notes = logs.places(found).join(found.select("output_id", F.col("seq").alias("lead"), "end"), ["output_id", "lead"])
    return gone.unionByName(owners.select("output_id", "seq", "label")).unionByName(gaps), notes.select("output_id", F.col("end").alias("seq"), "message", "places", "base", "listed")


def collapsed(rows: DataFrame) -> DataFrame:
    """rows: output_id, at (a number to order by), text, and seq (null for notes). Adds place, size: a line's place in, and the size
    of, its run of lines that stood together and differ in time stamps alone."""
    order = Window.partitionBy("output_id").orderBy("at")
    key = mask_times(F.col("text"))
    rows = rows.withColumn("key", key)
    same = (F.lag("key").over(order) == F.col("key")) & (F.col("key") != "") & (F.lag("at").over(order) == F.col("at") - 1)
    rows = rows.withColumn("run", F.count_if(~F.coalesce(same, F.lit(False))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("output_id", "run")
    return rows.withColumns({"size": F.count(F.lit(1)).over(run), "place": F.row_number().over(run.orderBy("at"))}).drop("key", "run")


def compact_outputs(outputs: DataFrame, trigger: int = TRIGGER) -> DataFrame:
    """outputs: output_id, raw (null is empty). Returns output_id, text, raw_tokens, tokens and stats (JSON of what was dropped).

    A text of at most trigger tokens, and one that would hardly get smaller, is passed on as it is.
    """
    asked = outputs.select(F.col("output_id").cast("string").alias("output_id"), F.coalesce("raw", F.lit("")).alias("raw")).withColumn("raw_tokens", tokens(F.col("raw")))
    asked = stored(asked, "outputs")
    rows = parse.raw_lines(asked.filter(F.col("raw_tokens") > trigger)).select("output_id", "seq", F.col("line").alias("text"))
    rows = stored(rows, "lines")
    claims = [rule(rows).filter("label is not null").select("output_id", "seq", "label", F.lit(i).alias("turn")) for i, rule in enumerate(RULES.values())]
    gone, notes = diagnostic_drops(rows)
    more, warned = logs.warning_notes(rows)
    claims += [gone.withColumn("turn", F.lit(len(RULES))), more.withColumn("turn", F.lit(len(RULES) + 1))]
    labels = reduce(DataFrame.unionByName, claims).groupBy("output_id", "seq").agg(F.min_by("label", "turn").alias("label"))
    labels = stored(labels, "claims")
    under = F.when(F.col("base") != "", F.concat(F.lit(", under "), F.col("base"))).otherwise("")
    said = tagged(number(F.col("places")), " more places with this same diagnostic (", F.col("message"), ")", under, ": ", F.col("listed"))
    notes = notes.select("output_id", "seq", said.alias("text"))
    head = tagged(number(F.col("places")), " more places with this same warning (", F.col("message"), ")", under, ", as path:line test-id | source line:")
    notes = notes.unionByName(warned.select("output_id", "seq", F.concat(head, F.lit("\n"), F.col("listed")).alias("text")))
    kept = rows.join(labels, ["output_id", "seq"], "left_anti").select("output_id", F.col("seq").cast("double").alias("at"), "text", "seq")
    kept = collapsed(kept.unionByName(notes.select("output_id", (F.col("seq") + 0.5).alias("at"), "text", F.lit(None).cast("bigint").alias("seq"))))
    kept = stored(kept.filter(f"size < {LEAST_RUN} or place = 1 or place = size"), "kept")
    marker = F.concat(F.col("text"), F.lit("\n"), tagged(number(F.col("size") - 2), " similar lines not shown"))
    shown = F.when((F.col("size") >= LEAST_RUN) & (F.col("place") == 1), marker).otherwise(F.col("text"))
    body = kept.groupBy("output_id").agg(gathered(["at", "text"], shown).alias("body"), F.sum(F.when((F.col("size") >= LEAST_RUN) & (F.col("place") == 1), F.col("size") - 2)).alias("similar"))
    sums = labels.groupBy("output_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    sums = sums.unionByName(body.filter("similar > 0").select("output_id", F.lit(logs.SIMILAR).alias("label"), F.col("similar").alias("n"), F.lit(1 << 62).alias("first")))
    drops = sums.groupBy("output_id").agg(gathered(["first", "label"], F.concat_ws(" ", "n", "label"), ", ").alias("drops"), F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("first", "label", "n"))), lambda x: F.struct(x["label"], x["n"]))).alias("dropped"))
    out = asked.join(drops, "output_id", "left").join(body, "output_id", "left")
    end = F.when(F.col("raw").endswith("\n"), "\n").otherwise("")
    whole = F.concat(F.when(F.coalesce("body", F.lit("")) == "", "").otherwise(F.concat(F.col("body"), F.lit("\n"))), tagged("not shown: ", F.col("drops"), "."), end)
    out = out.withColumn("whole", whole)
    good = F.col("drops").isNotNull() & (tokens(F.col("whole")) <= F.col("raw_tokens") * (1 - LEAST_SAVING))
    text = F.when(good, F.col("whole")).otherwise(F.col("raw"))
    value = F.when(good, F.to_json(F.struct(F.col("dropped")))).otherwise(F.lit('{"level":"L0"}'))
    return out.select("output_id", text.alias("text"), "raw_tokens", tokens(text).alias("tokens"), value.alias("stats"))


def listed_places(texts: DataFrame) -> DataFrame:
    """texts: output_id, text. output_id, path, pos: every place that the notes on diagnostics list."""
    note = r"^\[linesift\] [0-9]+ more places with this same diagnostic \(.*?\)(?:, under (\S+))?: (.*)$"
    rows = texts.select("output_id", F.explode(F.split("text", "\n")).alias("line")).filter(F.col("line").rlike(note))
    rows = rows.select("output_id", F.regexp_extract("line", note, 1).alias("base"), F.explode(F.split(F.regexp_extract("line", note, 2), "; ")).alias("part"))
    rows = rows.select("output_id", "base", F.split("part", " ").alias("words"))
    return rows.select("output_id", F.concat("base", F.get("words", F.lit(0))).alias("path"), F.explode(F.slice("words", F.lit(2), F.size("words"))).alias("pos"))
