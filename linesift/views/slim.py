"""slim: raw search outputs in, for each the smallest text out that still holds its evidence."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import norm_path, plural, tokens
from ..operators import lines, memory, rank
from ..operators.read import Reading
from ..sources.shared import stored
from . import content, coverage, lists, lossless
from .lists import STATS, stats
from .text import EMERGENCY, LEAST_SAVING, Config, by_directory, gathered, named_files, number, paragraphs, tagged, view_config

TEXTS = ["output_id", "text", "stats"]


def add(**values: Column) -> Column:
    """The stats with further values; a null value is left out."""
    new = stats(**values)
    return F.map_filter(F.map_concat("stats", new), lambda k, v: v.isNotNull())


def lossless_texts(read: Reading, rows: DataFrame, outputs: DataFrame, config: Config) -> DataFrame:
    """output_id, text, stats: the first level that fits (grouped, without context, as names), or the smallest within EMERGENCY
    budgets. Outputs that are shorter as they are get their raw text back; others that don't fit are left out."""
    level = lambda df, name, **more: df.select("output_id", F.lit(name).alias("level"), "text", F.map_concat(stats(**more), F.col("stats")).alias("stats") if "stats" in df.columns else stats(**more).alias("stats"))
    sizes = rows.groupBy("output_id").agg(F.count_if("is_match").alias("n"), F.count_distinct(F.when(F.col("is_match"), F.col("path"))).alias("files"), F.bool_or(~F.col("is_match")).alias("context"))
    grouped = lossless.shortest(rows, config)
    unread = read.unread.groupBy("output_id").agg(gathered(["seq"], "line").alias("unread"))
    grouped = grouped.join(unread, "output_id", "left").select("output_id", paragraphs(F.col("text"), F.col("unread")).alias("text"))
    present = read.present()
    first = level(grouped, "L1", kind=F.lit("content"))
    if "paths" in present:
        first = first.unionByName(level(lists.path_groups(read.paths), "L1"))
    if "count" in present:
        first = first.unionByName(level(lists.count_groups(read.counts), "L1"))
    first = stored(with_frame(first, read).join(outputs.select("output_id", "raw_tokens"), "output_id").withColumn("tokens", tokens(F.col("text"))), "grouped")
    # Further levels are made only of outputs that need them.
    wide = first.filter(F.col("tokens") > config.max_tokens).select("output_id")
    need = rows.join(wide, "output_id", "left_semi")
    bare = need.join(sizes.filter("context"), "output_id", "left_semi").filter("is_match")
    note = tagged("all ", plural(F.col("n"), "match", "matches"), " in ", plural(F.col("files"), "file", "files"), "; context lines left out.")
    bare = lossless.shortest(bare, config).join(sizes, "output_id").join(unread, "output_id", "left").select("output_id", paragraphs(note, F.col("text"), F.col("unread")).alias("text"))
    more = level(bare, "L1-matches", kind=F.lit("content"))
    if not outputs.filter("pattern <> ''").isEmpty():
        names = lossless.projected(need, outputs, config)
        more = more.unionByName(level(names, "L2", kind=F.lit("content"), recogniser=F.col("kind"), names=F.col("names")))
    more = with_frame(more, read).join(outputs.select("output_id", "raw_tokens"), "output_id").withColumn("tokens", tokens(F.col("text")))
    every = first.unionByName(more)
    fits = F.col("tokens") <= config.max_tokens
    place = F.row_number().over(Window.partitionBy("output_id").orderBy(F.desc(fits), F.when(fits, F.col("level")).otherwise(""), "tokens"))
    best = every.withColumn("place", place).filter("place = 1").withColumn("over", F.when(~fits, True))
    best = best.filter(fits | (F.col("tokens") <= EMERGENCY * config.max_tokens) & (F.col("tokens") < F.col("raw_tokens")))
    as_is = first.filter((F.col("raw_tokens") <= config.max_tokens) & (F.col("tokens") > (1 - LEAST_SAVING) * F.col("raw_tokens"))).select("output_id", F.lit(True).alias("same"))
    out = best.join(as_is, "output_id", "left").join(outputs.select("output_id", "raw"), "output_id").join(sizes, "output_id", "left")
    value = add(level=F.when(F.col("same"), "L0").otherwise(F.col("level")), over_budget=F.col("over"), matches_total=F.col("n"), matches_kept=F.col("n"), files_total=F.col("files"))
    return out.withColumn("stats", F.map_filter("stats", lambda k, v: k != "level")).select("output_id", F.when(F.col("same"), F.col("raw")).otherwise(F.col("text")).alias("text"), value.alias("stats"))


def with_frame(texts: DataFrame, read: Reading) -> DataFrame:
    """Puts the header and footer of each output around its text."""
    rows = texts.join(read.frame, "output_id", "left")
    return rows.withColumn("text", paragraphs(F.col("header"), F.col("text"), F.col("footer"))).drop("header", "footer")


def seen_note(before: DataFrame, outputs: DataFrame, config: Config) -> DataFrame:
    """before: matches that were shown before. output_id, seen: where they are."""
    spans = lines.ranges(before).join(before.groupBy("output_id", "path").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("seq")), ["output_id", "path"])
    spans = spans.join(outputs.select("output_id", "default_path"), "output_id")
    name = F.when(F.col("path") != "", F.col("path")).otherwise(F.col("default_path"))
    text = named_files(spans, config, F.concat_ws(":", name, "ranges"))
    n = before.groupBy("output_id").agg(F.count(F.lit(1)).alias("n"))
    return text.join(n, "output_id").select("output_id", tagged(number(F.col("n")), " matching lines already shown: ", F.col("files"), ".").alias("seen"))


def evidence_texts(read: Reading, rows: DataFrame, outputs: DataFrame, config: Config, scorer, seen: DataFrame | None) -> list[DataFrame]:
    """output_id, text, stats for each kind that there is: the notes view, or the coverage view of content."""
    present = read.present()
    views = {"paths": lambda: lists.path_notes(read.paths, config), "count": lambda: lists.count_notes(read.counts, config), "lines": lambda: lists.listing_notes(read.listing, config)}
    out = [with_frame(view(), read).select(TEXTS) for kind, view in views.items() if kind in present]
    return out + [content_texts(read, stored(rows, "rest"), outputs, config, scorer, seen)] if "content" in present else out


def content_texts(read: Reading, rows: DataFrame, outputs: DataFrame, config: Config, scorer, seen: DataFrame | None) -> DataFrame:
    """output_id, text, stats: the notes or the coverage view of content."""
    wide = max(config.max_tokens, config.trigger_tokens)
    budget = F.when((F.col("raw_tokens") <= config.trigger_tokens) & F.lit(config.trigger_tokens > config.max_tokens), config.trigger_tokens).otherwise(config.max_tokens).cast("bigint")
    budgets = outputs.select("output_id", budget.alias("budget"))
    config = replace(config, max_tokens=wide)
    queries = outputs.select("output_id", "intent", "pattern")
    n = read.rows.groupBy("output_id").agg(F.count(F.lit(1)).alias("n"))
    raw = outputs.join(n, "output_id").select("output_id", "n", "default_path")
    shown_before = None
    left = rows
    if seen is not None:
        known = seen.select("output_id", "path", "number", "text", F.lit(True).alias("seen")).distinct()
        big = outputs.join(budgets, "output_id").filter("raw_tokens > budget").select("output_id", F.lit(True).alias("big"))
        split = rows.join(known, ["output_id", "path", "number", "text"], "left").join(big, "output_id", "left").withColumn("seen", F.coalesce(F.col("seen") & F.col("big"), F.lit(False)))
        split = stored(memory.split_seen(split.drop("big")), "seen")
        left, shown_before = split.filter("kept").select(content.ROWS), split.filter("not kept and is_match").select(content.ROWS)
    asks = queries.filter((F.col("intent") != "") | (F.col("pattern") != ""))
    queries = None if asks.isEmpty() else queries
    # The coverage view ranks only what its index leaves room for; whether anything has to go is told without ranks.
    plain, _ = content.evidence(left, budgets, raw, config, None if config.view == "coverage" else queries, scorer)
    unread = read.unread.groupBy("output_id").agg(gathered(["seq"], "line").alias("unread"))
    plain = stored(plain, "evidence")
    count = rows.groupBy("output_id").agg(F.count_distinct("path").alias("files"), F.count_if("is_match").alias("all"))
    facts = dict(kind=F.lit("content"), matches_total=F.col("all"), files_total=F.col("files"))
    found = plain.join(unread, "output_id", "left").join(count, "output_id").select(
        "output_id", "note", paragraphs(F.col("body"), F.col("unread")).alias("text"), stats(**facts, matches_kept=F.col("shown"), steps=F.array_join("steps", ", ")).alias("stats"), "shown", "all"
    )
    if config.view == "coverage":
        cut = found.filter(F.col("shown") < F.col("all")).select("output_id")
        of = lambda df: df.join(cut, "output_id", "left_semi")
        index = coverage.covered(of(rows), budgets, raw, config, queries, scorer, of(left))
        index = index.select("output_id", F.lit("").alias("note"), "text", stats(kind=F.lit("content"), view=F.lit("coverage"), matches_total=F.col("total"), matches_kept=F.col("shown"), files_total=F.col("files")).alias("stats"), "shown", F.col("total").alias("all"))
        found = found.join(cut, "output_id", "left_anti").unionByName(index)
    out = found
    if shown_before is not None:
        out = out.join(seen_note(shown_before, outputs, config), "output_id", "left")
        out = out.withColumn("note", paragraphs(F.col("note"), F.col("seen"))).drop("seen")
    framed = out.join(read.frame, "output_id", "left")
    return framed.select("output_id", paragraphs(F.col("header"), F.col("text"), F.col("footer"), F.col("note")).alias("text"), "stats")


def slim_outputs(outputs: DataFrame, config: Config | None = None, kind: str | None = None, scorer=rank.lexical, seen: DataFrame | None = None) -> DataFrame:
    """outputs: output_id, raw, and any of default_path, intent, subtask, pattern. Null raw is empty.

    Returns output_id, text, raw_tokens, tokens and stats (JSON). A text that can't be read, or is small, is passed on as it
    is. kind: content, paths, count or lines for all outputs; found out if not given. seen: output_id, path, number, text
    of lines that were shown before, which aren't shown again where an output exceeds its budget. scorer: units and
    queries (output_id, intent, pattern) in, units with score out.
    """
    config = config or view_config("lossless")
    text = lambda c: (F.coalesce(c, F.lit("")) if c in outputs.columns else F.lit("")).alias(c)
    asked = outputs.select(F.col("output_id").cast("string").alias("output_id"), F.coalesce("raw", F.lit("")).alias("raw"), *map(text, ("default_path", "intent", "subtask", "pattern")))
    asked = asked.withColumns({"intent": F.trim(F.concat_ws(" ", "intent", "subtask")), "raw_tokens": tokens(F.col("raw"))}).drop("subtask")
    asked = stored(asked, "outputs")
    read = Reading(asked, kind)
    able = read.reliable()
    if config.view == "lossless":
        able = able.join(asked.filter(F.col("raw_tokens") > config.trigger_tokens), "output_id", "left_semi")
    able = stored(able, "able")
    read, outs = read.only(able, "left_semi"), asked.join(able, "output_id", "left_semi")
    rows = stored(lines.dedupe_lines(read.rows.withColumn("path", norm_path(F.col("path")))), "unique")
    parts = []
    if config.view == "lossless":
        done = stored(lossless_texts(read, rows, outs, config), "lossless")
        parts.append(done.select(TEXTS))
        read, rows = read.only(done, "left_anti"), rows.join(done, "output_id", "left_anti")
        config = replace(config, view="coverage", trigger_tokens=0)
    parts += evidence_texts(read, rows, outs, config, scorer, seen)
    texts = reduce(DataFrame.unionByName, parts) if parts else asked.select("output_id", F.lit(None).cast("string").alias("text"), F.lit(None).cast(STATS).alias("stats"))
    out = asked.join(texts, "output_id", "left")
    # A reduced text that is no shorter would only cost its reader the original.
    text = F.when(tokens(F.col("text")) < F.col("raw_tokens"), F.col("text")).otherwise(F.col("raw"))
    value = F.coalesce("stats", F.create_map(F.lit("level"), F.lit("L0")))
    return out.select("output_id", text.alias("text"), "raw_tokens", tokens(text).alias("tokens"), F.to_json(value).alias("stats"))


def response_text(response: Column) -> Column:
    """The text of a tool's JSON response: its content, or its file names by line; null for another shape."""
    names = F.array_join(F.from_json(F.get_json_object(response, "$.filenames"), "array<string>"), "\n")
    return F.coalesce(F.get_json_object(response, "$.content"), names)
