"""What a budget keeps of search results, in order or by rank, and the note on what it left out.

rows: output_id, seq, path, number, text, is_match, one for each place. budgets: output_id, budget (tokens).
Each step is an aggregation that says where it would end; the step that each output needs is chosen from the sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import printed, tokens_of
from ..operators import lines, rank
from ..sources.shared import stored
from .text import Config, gathered, matches, named_files, number, paragraphs, tagged, of_output

ROWS = ["output_id", "seq", "path", "number", "text", "is_match"]
FIXED, EACH_FILE = 60, 15  # tokens that a note takes, and each file that it names


def printed_rows(rows: DataFrame, config: Config) -> DataFrame:
    """Adds block and chars (of the printed line, with its end)."""
    text = printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), config.max_line_chars)
    return lines.with_blocks(rows, config.merge_gap).withColumn("chars", F.char_length(text) + 1)


def flat(rows: DataFrame, config: Config, order: str = "first") -> DataFrame:
    """output_id, body, lines: rows as search tools print them, files in order of their first row, or of a column that says so."""
    if order == "first":
        rows = rows.withColumn("first", F.min("seq").over(Window.partitionBy("output_id", "path")))
    rows = lines.with_blocks(rows, config.merge_gap)
    text = printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), config.max_line_chars)
    blocks = rows.groupBy("output_id", order, "path", "block").agg(gathered(["number"], text).alias("text"), F.bool_or(~F.col("is_match")).alias("context"), F.count(F.lit(1)).alias("n"))
    parts = lambda by: gathered([order, "path", "block"], "text", by)
    body = F.when(F.bool_or("context"), parts("\n--\n")).otherwise(parts("\n"))
    return blocks.groupBy("output_id").agg(body.alias("body"), (F.sum("n") + F.when(F.bool_or("context"), F.count(F.lit(1)) - 1).otherwise(0)).alias("lines"))


def in_order(rows: DataFrame, budgets: DataFrame, config: Config) -> tuple[DataFrame, DataFrame]:
    """The rows that stay, and facts: output_id, total, steps.

    Context goes first, then matches beyond the largest cap on a file that fits, then files from the end.
    """
    rows = stored(printed_rows(rows, config), "printed")
    size = lambda c: F.coalesce(F.sum(F.when(c, F.col("chars"))), F.lit(0)) - 1
    blocks = F.count_distinct(F.struct("path", "block"))
    facts = rows.groupBy("output_id").agg(
        (size(F.lit(True)) + F.when(F.bool_or(~F.col("is_match")), 3 * (blocks - 1)).otherwise(0)).alias("whole"), size(F.col("is_match")).alias("bare"),
        F.bool_or(~F.col("is_match")).alias("context"), F.count_if("is_match").alias("total"), F.count_distinct(F.when(F.col("is_match"), F.col("path"))).alias("files"),
    ).join(budgets, "output_id")
    ranked = stored(lines.with_rank(rows.filter("is_match")), "ranked")
    by_rank = ranked.groupBy("output_id", "rank").agg(F.sum("chars").alias("chars"))
    upto = by_rank.withColumn("size", F.sum("chars").over(of_output().orderBy("rank")) - 1).join(facts, "output_id")
    room = tokens_of(F.col("size")) + FIXED + EACH_FILE * config.note_max_files <= F.col("budget")
    least = F.when(F.col("files") == 1, 1).otherwise(config.max_matches_per_file)
    cap = upto.groupBy("output_id").agg(F.greatest(F.max(F.when(room, F.col("rank"))), F.max(least)).alias("cap"))
    kept = ranked.join(cap, "output_id").filter(F.col("rank") <= F.col("cap"))
    capped = kept.groupBy("output_id").agg((F.sum("chars") - 1).alias("capped"), F.first("cap").alias("cap"), F.count(F.lit(1)).alias("left"))
    file = kept.groupBy("output_id", "path").agg(F.min("seq").alias("first"), (tokens_of(F.sum("chars") - 1) + 1).alias("cost")).join(budgets, "output_id")
    note = F.greatest(F.col("budget") - FIXED - EACH_FILE * config.note_max_files, F.floor(F.col("budget") / 2))
    stay = lines.prefix_budget(file, ["first", "path"], "cost", note, most=config.max_tokens // 2 + 1).filter("kept").select("output_id", "path", F.lit(True).alias("stays"))
    over = lambda c: tokens_of(F.col(c)) > F.col("budget")
    level = F.when(~over("whole"), 0).when(~over("bare"), 1).when(~over("capped"), 2).otherwise(3)
    facts = stored(facts.join(capped, "output_id", "left").withColumn("level", F.when(F.col("capped").isNull(), F.when(over("whole"), 3).otherwise(0)).otherwise(level)), "facts")
    every = rows.join(ranked.select("output_id", "path", "number", "rank"), ["output_id", "path", "number"], "left").join(facts.select("output_id", "level", "cap"), "output_id").join(stay, ["output_id", "path"], "left")
    stays = (F.col("level") == 0) | F.col("is_match") & ((F.col("level") == 1) | (F.col("rank") <= F.col("cap")) & ((F.col("level") == 2) | F.col("stays")))
    shown = every.filter(stays).select(ROWS)
    last = stay.groupBy("output_id").agg(F.count(F.lit(1)).alias("kept_files"))
    steps = F.filter(F.array(
        F.when((F.col("level") >= 1) & F.col("context"), "context lines dropped"), F.when((F.col("level") >= 2) & (F.col("left") < F.col("total")), F.format_string("max %d matches per file", "cap")),
        F.when((F.col("level") == 3) & (F.coalesce("kept_files", F.lit(0)) < F.col("files")), "files dropped from the end"),
    ), lambda s: s.isNotNull())
    return shown, facts.join(last, "output_id", "left").select("output_id", "total", steps.alias("steps"))


def by_rank(rows: DataFrame, budgets: DataFrame, queries: DataFrame, config: Config, scorer=rank.lexical) -> DataFrame:
    """The rows that stay, with best (the rank of a file's best unit, by which files are ordered).

    queries: output_id, intent, pattern. Units of nearby matches are scored, and filled into the budget from the best.
    """
    rows = stored(rank.with_units(rows), "units")
    units = stored(scorer(rank.units_of(rows, config.max_line_chars), queries), "scored")
    units = units.withColumn("rank", F.row_number().over(of_output().orderBy(F.desc(F.round("score", 6)), "first"))).join(budgets, "output_id")
    note = F.greatest(F.col("budget") - FIXED - EACH_FILE * config.note_max_files, F.floor(F.col("budget") / 2)).cast("bigint")
    kept = rank.greedy_fill(units.withColumn("budget", note), "budget").filter("kept is not null")
    best = kept.withColumn("best", F.min("rank").over(Window.partitionBy("output_id", "path")))
    shown = rows.join(best.select("output_id", "path", "block", "unit", "best", "kept"), ["output_id", "path", "block", "unit"])
    return shown.filter("is_match or kept = 'full'").select(*ROWS, "best"), units.select("output_id", "path", "block", "unit", "matches", "rank", "first").join(kept.select("output_id", "rank", "kept"), ["output_id", "rank"], "left")


def left_out(rows: DataFrame, shown: DataFrame) -> DataFrame:
    """output_id, seq, path, n: matches of each file that aren't shown."""
    n = lambda df, name: df.filter("is_match").groupBy("output_id", "path").agg(F.count(F.lit(1)).alias(name), F.min("seq").alias("seq"))
    both = n(rows, "all").join(n(shown, "kept").drop("seq"), ["output_id", "path"], "left")
    return both.select("output_id", "seq", "path", (F.col("all") - F.coalesce("kept", F.lit(0))).alias("n")).filter("n > 0")


def noted(rows: DataFrame, shown: DataFrame, body: DataFrame, facts: DataFrame, raw: DataFrame, config: Config, how: str, ordered: DataFrame | None = None) -> DataFrame:
    """output_id, body, note, shown, total. facts: output_id, total, steps; raw: output_id, n (rows that were read), default_path.

    ordered: output_id, seq, path, n of what is left out, in the order to name it.
    """
    missing = left_out(rows, shown) if ordered is None else ordered
    missing = missing.join(raw.select("output_id", "default_path"), "output_id")
    name = F.when(F.col("path") != "", F.col("path")).when(F.col("default_path") != "", F.col("default_path")).otherwise("this file")
    text = named_files(missing, config, F.concat(name, F.format_string(" (%d)", "n")))
    kept = shown.groupBy("output_id").agg(F.count_if("is_match").alias("shown"), F.count(F.lit(1)).alias("rows"))
    all_ = rows.groupBy("output_id").agg(F.count(F.lit(1)).alias("unique"))
    out = facts.join(raw, "output_id").join(all_, "output_id").join(kept, "output_id", "left").join(body, "output_id", "left").join(text, "output_id", "left").fillna({"shown": 0, "body": "", "lines": 0})
    ranked = how == "ranked"
    said = (F.size("steps") > 0) | (F.col("unique") < F.col("n")) | F.lit(ranked)
    tail = F.lit(", ranked by relevance.") if ranked else F.concat(F.when(F.size("steps") > 0, F.concat(F.lit(", "), F.array_join("steps", "; "))).otherwise(""), F.lit("."))
    lead = tagged(number(F.col("n")), " -> ", number(F.col("lines")), " lines, ", number(F.col("shown")), "/", number(F.col("total")), " matches shown", tail)
    more = F.when(F.col("files").isNotNull(), F.concat(F.lit(" Not shown, most relevant first: " if ranked else " Not shown: "), F.col("files"), F.lit(".")))
    return out.select("output_id", "body", F.when(said, F.concat(lead, F.coalesce(more, F.lit("")))).otherwise("").alias("note"), "shown", "total", "steps")


def evidence(rows: DataFrame, budgets: DataFrame, raw: DataFrame, config: Config, queries: DataFrame | None = None, scorer=rank.lexical) -> tuple[DataFrame, DataFrame]:
    """(output_id, body, note, shown, total, steps; and the rows that are shown).

    Where something has to go and the output has a query, the budget goes to what ranks best; else to what comes first.
    """
    rows = stored(rows.select(ROWS), "rows")
    shown, facts = in_order(rows, budgets, config)
    shown, facts = stored(shown, "shown"), stored(facts, "steps")
    plain = noted(rows, shown, flat(shown, config), facts, raw, config, "plain")
    if queries is None:
        return plain, shown
    plain = stored(plain, "plain")
    asks = queries.filter((F.col("intent") != "") | (F.col("pattern") != ""))
    loses = plain.filter("shown < total").join(asks, "output_id", "left_semi").select("output_id")
    of = lambda df: df.join(loses, "output_id", "left_semi")
    best, units = by_rank(of(rows), budgets, queries, config, scorer)
    best, units = stored(best, "best"), units
    gone = units.filter("kept is null and matches > 0").groupBy("output_id", "path").agg(F.min("rank").alias("seq"), F.sum("matches").alias("n"))
    ranked = noted(of(rows), best, flat(best, config, "best"), of(facts), raw, config, "ranked", gone)
    other = lambda df: df.join(loses, "output_id", "left_anti")
    return other(plain).unionByName(ranked), other(shown).unionByName(best.select(ROWS))
