"""Operators that keep every match and take out repetition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import TAG, folder_with_separator, printed, strip

FACTOR_LEAST, FACTOR_CHARS, LINE_CHARS = 3, 16, 1000
SAME_LINE = "matches are this same line: "


def factor_repeats(lines: DataFrame) -> DataFrame:
    """output_id, text, count, files, seq: match texts worth writing once, with their places.

    A text of FACTOR_CHARS or more, on FACTOR_LEAST lines or more, is factored if that is shorter. The places of a text
    are summed as lengths, never gathered.
    """
    rows = lines.filter("is_match").withColumn("key", strip(F.col("text"))).filter(F.char_length("key") >= FACTOR_CHARS)
    number = F.char_length(F.col("number").cast("string"))
    per_file = rows.groupBy("output_id", "key", "path").agg(
        F.count(F.lit(1)).alias("n"), F.sum(number + 1 + F.char_length("text") + 1).alias("plain"), F.sum(number + 1).alias("digits"), F.min("seq").alias("seq")
    )
    # A file's row is two blanks, its path and a colon (if it has a path), and its numbers with commas between.
    row = 1 + 2 + F.when(F.col("path") == "", 0).otherwise(F.char_length("path") + 1) + F.col("digits") - 1
    texts = per_file.groupBy("output_id", "key").agg(
        F.sum("n").alias("count"), F.count(F.lit(1)).alias("files"), F.sum("plain").alias("plain"), F.sum(row - F.char_length("path") - 3).alias("rows"), F.min("seq").alias("seq")
    )
    head = F.lit(len(TAG) + 1) + F.char_length(F.col("count").cast("string")) + 1 + len(SAME_LINE) + F.least(F.char_length("key"), F.lit(LINE_CHARS))
    return texts.filter((F.col("count") >= FACTOR_LEAST) & (head + F.col("rows") < F.col("plain"))).select("output_id", F.col("key").alias("text"), "count", "files", "seq")


def layout_sizes(lines: DataFrame) -> DataFrame:
    """output_id, flat, heading: characters of two layouts, the path on every row, or once above a file's rows."""
    row = F.char_length(printed(F.col("path"), F.col("number"), F.col("text"), F.col("is_match"), LINE_CHARS)) + 1
    per_file = lines.groupBy("output_id", "path").agg(F.sum(row).alias("flat"), F.count(F.lit(1)).alias("n"))
    nested = F.when(F.col("n") == 1, F.col("flat")).otherwise(F.col("flat") - F.col("n") * (F.char_length("path") + 1) + F.char_length("path") + 2)
    return per_file.groupBy("output_id").agg((F.sum("flat") - 1).alias("flat"), (F.sum(nested) - 1).alias("heading"))


def with_names(lines: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """Adds names: what pattern's group reads in a line, each once."""
    return lines.withColumn("names", F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), lambda n: n != "")))


def recognised(lines: DataFrame, rules: list[tuple[str, str]], least: float = 0.5) -> DataFrame:
    """output_id, rule, hits, matches: the rule (name, pattern) that reads most matches of an output, if it reads enough; the first of equals."""
    hits = [F.count_if(F.col("is_match") & F.col("text").rlike(p)).alias(f"h{i}") for i, (_, p) in enumerate(rules)]
    sums = lines.groupBy("output_id").agg(F.count_if("is_match").alias("matches"), *hits)
    best = F.array_max(F.array(*(F.struct(F.col(f"h{i}").alias("hits"), F.lit(-i).alias("i"), F.lit(name).alias("rule")) for i, (name, _) in enumerate(rules))))
    return sums.withColumn("best", best).filter(F.col("best.hits") >= least * F.col("matches")).filter("matches > 0").select("output_id", "best.rule", "best.hits", "matches")


def joined_numbers(column: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(column)), lambda n: n.cast("string")), ",")


def names_by_name(lines: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """output_id, name, path, numbers: the inverted index, a row for each name and file, numbers as 1,2,3."""
    rows = with_names(lines.filter("is_match"), pattern, group).select("output_id", "path", "number", F.explode("names").alias("name"))
    return rows.groupBy("output_id", "name", "path").agg(joined_numbers(F.col("number")).alias("numbers"))


def names_by_file(lines: DataFrame, pattern: str, group: int = 1) -> DataFrame:
    """output_id, path, names: each file with name:line for its matches, by line, then name."""
    rows = with_names(lines.filter("is_match"), pattern, group).select("output_id", "path", "number", F.explode("names").alias("name"))
    each = F.array_sort(F.collect_list(F.struct("number", F.concat_ws(":", "name", "number").alias("t"))))
    return rows.groupBy("output_id", "path").agg(F.array_join(F.transform(each, lambda x: x["t"]), " ").alias("names"))


def grouped_rows(counts: DataFrame) -> DataFrame:
    """counts: output_id, path, seq, count. Adds row: name:count below a directory of several files, else path:count."""
    rows = counts.withColumn("dir", folder_with_separator(F.col("path")))
    many = rows.groupBy("output_id", "dir").agg(F.count(F.lit(1)).alias("files"))
    rows = rows.join(many, ["output_id", "dir"])
    name = F.when((F.col("dir") != "") & (F.col("files") >= 2), F.concat(F.lit("  "), F.expr("substring(path, char_length(dir) + 1)"))).otherwise(F.col("path"))
    return rows.select("output_id", "seq", "path", F.concat_ws(":", name, F.col("count").cast("string")).alias("row"))


def merge_counts(counts: DataFrame, how: str) -> DataFrame:
    """counts: output_id, path, seq, count. One row a path without ./: the largest count ('max') or the one that came first ('first')."""
    of = F.max("count") if how == "max" else F.min_by("count", "seq")
    return counts.groupBy("output_id", F.regexp_replace("path", r"^\./", "").alias("path")).agg(of.alias("count"), F.min("seq").alias("seq"))
