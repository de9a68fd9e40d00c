"""Pieces of text that views are put together from, a row an output."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TAG, plural, tokens
from ..operators import paths


@dataclass(frozen=True)
class Config:
    """max_tokens: the budget. trigger_tokens: texts of fewer tokens are left alone (lossless), or get that budget."""

    view: str = "notes"
    max_tokens: int = 2000
    trigger_tokens: int = 0
    merge_gap: int = 0
    max_matches_per_file: int = 8
    max_line_chars: int = 300
    note_max_files: int = 10


#: Budget and trigger that suit a view.
DEFAULTS = {"lossless": (4800, 1000), "coverage": (2000, 6000), "notes": (2000, 6000)}
LEAST_SAVING, EMERGENCY, FULL_LINE, INDENT = 0.15, 3, 1000, "  "


def of_output():
    return Window.partitionBy("output_id")


def view_config(view: str, **more) -> Config:
    budget, trigger = DEFAULTS[view]
    return Config(**{"view": view, "max_tokens": budget, "trigger_tokens": trigger} | more)


def paragraphs(*parts: Column, by: str = "\n") -> Column:
    """The parts that aren't null or empty, joined."""
    return F.array_join(F.filter(F.array(*parts), lambda x: F.coalesce(x != "", F.lit(False))), by)


def gathered(order: list[str], text: str | Column, by: str = "\n") -> Column:
    """An aggregate: the texts of a group in order, joined. A group is (part of) one output."""
    value = F.col(text) if isinstance(text, str) else text
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, value.alias("_text")))), lambda x: x["_text"]), by)


def cost(rows: DataFrame, text: str = "text") -> DataFrame:
    """output_id, cost: what the rows' lines take together."""
    return rows.groupBy("output_id").agg(F.sum(tokens(F.col(text)) + 1).alias("cost"))


def dirs_text(groups: DataFrame) -> DataFrame:
    """groups: output_id, place, dir, n (see rollup_dirs). output_id, dirs: their list; absolute ones below one base name it once."""
    real = ~F.col("dir").startswith("+")
    names = F.collect_list(F.when(real, F.split("dir", "/")))
    common = F.aggregate("names", F.get("names", F.lit(0)), lambda acc, x: F.slice(acc, F.lit(1), F.when(F.slice(x, F.lit(1), F.size(acc)) == acc, F.size(acc)).otherwise(
        F.greatest(F.array_position(F.transform(F.sequence(F.lit(0), F.size(acc) - 1), lambda i: F.coalesce(F.get(acc, i) == F.get(x, i), F.lit(False))), False).cast("int") - 1, F.lit(0)))))
    of = groups.groupBy("output_id").agg(names.alias("names"), F.bool_and(F.when(real, F.col("dir").rlike("^(/|[A-Za-z]:/)"))).alias("rooted"))
    base = F.array_join(common, "/")
    of = of.withColumn("base", F.when(F.col("rooted") & (F.size("names") > 1), base).otherwise(""))
    of = of.select("output_id", F.when((F.char_length("base") >= 12) & ~F.array_contains(F.transform("names", lambda x: F.array_join(x, "/")), F.col("base")), F.col("base")).otherwise("").alias("base"))
    rows = groups.join(of, "output_id")
    short = F.when(F.col("base") == "", F.col("dir")).otherwise(F.expr("substring(dir, char_length(base) + 2)"))
    item = F.concat(F.when(real, F.concat(short, F.lit("/"))).otherwise(F.col("dir")), F.format_string(" (%d)", "n"))
    out = rows.groupBy("output_id", "base").agg(gathered(["place"], item, ", ").alias("dirs"))
    return out.select("output_id", F.when(F.col("base") == "", F.col("dirs")).otherwise(F.concat(F.lit("under "), F.col("base"), F.lit("/: "), F.col("dirs"))).alias("dirs"))


def by_directory(files: DataFrame, limit: int) -> DataFrame:
    """files: output_id, seq, path, n. output_id, dirs."""
    return dirs_text(paths.rollup_dirs(files.select("output_id", "seq", "path", F.col("n").cast("bigint").alias("n")), limit))


def named_files(files: DataFrame, config: Config, item: Column, default: DataFrame | None = None) -> DataFrame:
    """files: output_id, seq, path, n. output_id, files: the first by name (item), the others by directory."""
    rows = files.withColumn("place", F.row_number().over(of_output().orderBy("seq", "path")))
    head = rows.filter(F.col("place") <= config.note_max_files).groupBy("output_id").agg(gathered(["place"], item, ", ").alias("head"))
    rest = rows.filter(F.col("place") > config.note_max_files)
    sizes = rest.groupBy("output_id").agg(F.count(F.lit(1)).alias("more"))
    out = rows.select("output_id").distinct().join(head, "output_id", "left").join(sizes, "output_id", "left").join(by_directory(rest, config.note_max_files), "output_id", "left")
    more = F.when(F.col("more").isNotNull(), F.concat(F.col("more").cast("string"), F.lit(" more files by directory: "), F.col("dirs")))
    return out.select("output_id", paragraphs(F.col("head"), more, by="; ").alias("files"))


def tagged(*parts: Column | str) -> Column:
    return F.concat(F.lit(TAG + " "), *(F.lit(p) if isinstance(p, str) else p for p in parts))


def matches(n: Column) -> Column:
    return plural(n, "match", "matches")


def files(n: Column) -> Column:
    return plural(n, "file", "files")


def number(n: Column) -> Column:
    return n.cast("string")
