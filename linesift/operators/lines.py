"""Operators over lines (output_id, seq, path, number, text, is_match).

Windows are over one file of one output, or pre-limited so that what one task sorts is bounded by the token budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import clip, printed, tokens_of

def of_file():
    return Window.partitionBy("output_id", "path")


def dedupe_lines(lines: DataFrame) -> DataFrame:
    """One row for each (path, number). A match beats a context line, and takes the place of the first of either."""
    best = F.min(F.struct((~F.col("is_match")).alias("context"), "seq", "text")).alias("best")
    return lines.groupBy("output_id", "path", "number").agg(F.min("seq").alias("seq"), best).select("output_id", "seq", "path", "number", "best.text", (~F.col("best.context")).alias("is_match"))


def with_blocks(lines: DataFrame, gap: int = 0) -> DataFrame:
    """Adds block: the number of the run of lines, at most gap lines apart, in its file."""
    apart = F.col("number") - F.lag("number").over(of_file().orderBy("number")) > gap + 1
    return lines.withColumn("block", F.sum(F.when(apart, 1).otherwise(0)).over(of_file().orderBy("number").rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))


def blocks(lines: DataFrame, gap: int = 0) -> DataFrame:
    rows = with_blocks(lines, gap).groupBy("output_id", "path", "block")
    return rows.agg(F.min("number").alias("first"), F.max("number").alias("last"), F.count(F.lit(1)).alias("lines"), F.count_if("is_match").alias("matches"))


def ranges(lines: DataFrame) -> DataFrame:
    """output_id, path, ranges: the numbers of each file as text like 1-3,5."""
    runs = with_blocks(lines).groupBy("output_id", "path", "block").agg(F.min("number").alias("a"), F.max("number").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat_ws("-", "a", "b"))
    return runs.groupBy("output_id", "path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a", text.alias("t")))), lambda x: x["t"]), ",").alias("ranges"))


def drop_context(lines: DataFrame) -> DataFrame:
    return lines.filter("is_match")


def with_rank(lines: DataFrame) -> DataFrame:
    """Adds rank: a match's place among its file's matches, in line order (null for context)."""
    return lines.withColumn("rank", F.when(F.col("is_match"), F.count_if("is_match").over(of_file().orderBy("number").rowsBetween(Window.unboundedPreceding, 0))))


def cap_matches(lines: DataFrame, cap: int) -> DataFrame:
    """The first cap matches of each file. In a file that loses some, context stays only in runs that hold a kept match."""
    rows = with_rank(lines).withColumn("over", F.max("rank").over(of_file()) > cap)
    kept = with_blocks(rows.filter(F.coalesce(F.col("rank") <= cap, F.lit(True))))
    whole = F.bool_or("is_match").over(Window.partitionBy("output_id", "path", "block"))
    return kept.withColumn("holds", whole).filter("holds or not coalesce(over, false)").drop("rank", "over", "block", "holds")


def budget_cap(matches: DataFrame, max_tokens: int, note_files: int = 10, floor: int = 8, limit: int = 300) -> DataFrame:
    """output_id, cap: the largest number of matches a file whose rendering fits beside the note; at least the floor (1 for one file).

    Only sums by rank meet: the rows of a file are never gathered.
    """
    rows = with_rank(matches).withColumn("chars", F.char_length(printed(F.col("path"), F.col("number"), F.col("text"), F.lit(True), limit)) + 1)
    of = rows.groupBy("output_id").agg(F.count_distinct("path").alias("files"), F.max("rank").alias("most"))
    by_rank = rows.groupBy("output_id", "rank").agg(F.sum("chars").alias("chars"))
    size = F.sum("chars").over(Window.partitionBy("output_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)) - 1
    lowest = F.when(F.col("files") == 1, F.lit(1)).otherwise(F.lit(floor))
    fits = by_rank.withColumn("size", size).join(of, "output_id")
    good = (tokens_of(F.col("size")) + 60 + 15 * note_files <= max_tokens) & (F.col("rank") <= F.greatest(lowest, F.col("most") - 1))
    return fits.groupBy("output_id").agg(F.greatest(F.max(F.when(good, F.col("rank"))), F.max(lowest)).cast("bigint").alias("cap"))


def prefix_budget(rows: DataFrame, order: list[str], cost: str, budget: Column | int, least_cost: int = 2, most: int | None = None) -> DataFrame:
    """Adds kept: rows of an output stay, in order, while their costs fit; the first always does.

    No more than most = budget / least_cost rows can stay, so all others are cut before the running sum, by a limit
    that also works before the shuffle. Rows beyond it are not returned.
    """
    window = Window.partitionBy("output_id").orderBy(*order)
    most = most or budget // least_cost + 1
    few = rows.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= most)
    total = F.sum(cost).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return few.withColumn("kept", (F.col("place") == 1) | (total <= budget)).drop("place")


def file_costs(lines: DataFrame, limit: int = 300) -> DataFrame:
    """output_id, path, first (its first seq), cost (tokens of its rendering, and one), matches."""
    rows = with_blocks(lines)
    chars = F.sum(F.char_length(printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), limit)) + 1)
    breaks = F.when(F.bool_or(~F.col("is_match")), 3 * F.max("block")).otherwise(0)
    return rows.groupBy("output_id", "path").agg(F.min("seq").alias("first"), (tokens_of(chars - 1 + breaks) + 1).alias("cost"), F.count_if("is_match").alias("matches"))


def file_prefix(lines: DataFrame, max_tokens: int, note_files: int = 10, limit: int = 300) -> DataFrame:
    """The files of each output that stay when files are dropped from its end."""
    budget = max(max_tokens - 60 - 15 * note_files, max_tokens // 2)
    return prefix_budget(file_costs(lines, limit), ["first", "path"], "cost", budget).filter("kept").drop("kept")


def rendered(lines: DataFrame, limit: int = 300) -> DataFrame:
    """output_id, text: rows as search tools print them, files by first seq; -- between blocks if there is any context.

    The result is one text an output, which is what a budget has bounded.
    """
    rows = with_blocks(lines).withColumn("first", F.min("seq").over(of_file()))
    line = printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), limit)
    per_block = rows.groupBy("output_id", "path", "first", "block").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"), F.bool_or(~F.col("is_match")).alias("context")
    )
    every = F.transform(F.array_sort(F.collect_list(F.struct("first", "path", "block", "text"))), lambda x: x["text"])
    return per_block.groupBy("output_id").agg(F.when(F.bool_or("context"), F.array_join(every, "\n--\n")).otherwise(F.array_join(every, "\n")).alias("text"))


def clipped(lines: DataFrame, limit: int) -> DataFrame:
    return lines.withColumn("text", clip(F.col("text"), limit))
