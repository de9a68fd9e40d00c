"""Views of path lists, count lists and listings. Each returns output_id, text (without header and footer) and stats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clip, norm_path, tokens
from ..operators import lines, lossless, paths
from .text import INDENT, Config, by_directory, gathered, number, paragraphs, tagged, of_output

STATS = "map<string,string>"


def stats(**values: Column) -> Column:
    return F.create_map(*(x for k, v in values.items() for x in (F.lit(k), v.cast("string")))).cast(STATS)


def path_notes(found: DataFrame, config: Config) -> DataFrame:
    """found: output_id, seq, path. The paths that fit, and where the others are."""
    unique = paths.distinct_paths(found)
    n = found.groupBy("output_id").agg(F.count(F.lit(1)).alias("input")).join(unique.groupBy("output_id").agg(F.count(F.lit(1)).alias("unique")), "output_id")
    cost = unique.withColumn("cost", tokens(F.col("path")) + 1)
    kept = lines.prefix_budget(cost, ["seq", "path"], "cost", F.lit(config.max_tokens - 60), most=config.max_tokens // 2 + 1).filter("kept").select("output_id", "seq", "path")
    shown = kept.groupBy("output_id").agg(gathered(["seq", "path"], "path").alias("body"), F.count(F.lit(1)).alias("kept"))
    rest = by_directory(unique.join(kept, ["output_id", "seq", "path"], "left_anti").withColumn("n", F.lit(1)), config.note_max_files)
    rows = n.join(shown, "output_id").join(rest, "output_id", "left")
    note = F.when(F.col("kept") < F.col("unique"), tagged(number(F.col("kept")), "/", number(F.col("unique")), " paths shown. Not shown, by directory: ", F.col("dirs"), ".")).when(
        F.col("unique") < F.col("input"), tagged(number(F.col("input") - F.col("unique")), " duplicate paths removed.")
    )
    return rows.select("output_id", paragraphs(F.col("body"), note).alias("text"), stats(kind=F.lit("paths"), input=F.col("input"), unique=F.col("unique"), kept=F.col("kept")).alias("stats"))


def count_notes(found: DataFrame, config: Config) -> DataFrame:
    """found: output_id, seq, path, count. The files that fit, and how many matches the others have."""
    merged = lossless.merge_counts(found, "max").withColumn("row", F.concat_ws(":", "path", "count"))
    kept = lines.prefix_budget(merged.withColumn("cost", tokens(F.col("row")) + 1), ["seq", "path"], "cost", F.lit(config.max_tokens - 40), most=config.max_tokens // 2 + 1).filter("kept")
    shown = kept.groupBy("output_id").agg(gathered(["seq", "path"], "row").alias("body"), F.count(F.lit(1)).alias("kept"), F.sum("count").alias("seen"))
    rows = merged.groupBy("output_id").agg(F.count(F.lit(1)).alias("unique"), F.sum("count").alias("total")).join(shown, "output_id")
    note = F.when(F.col("kept") < F.col("unique"), tagged(number(F.col("kept")), "/", number(F.col("unique")), " files shown; ", number(F.col("unique") - F.col("kept")), " files with ", number(F.col("total") - F.col("seen")), " matches not shown."))
    return rows.select("output_id", paragraphs(F.col("body"), note).alias("text"), stats(kind=F.lit("count"), unique=F.col("unique"), kept=F.col("kept")).alias("stats"))


def path_groups(found: DataFrame) -> DataFrame:
    """found: output_id, seq, path. Each path once, files of one directory under a line for it."""
    rows = paths.grouped_paths(paths.distinct_paths(found))
    of = rows.groupBy("output_id").agg(gathered(["dir_seq", "seq", "row"], "row").alias("text"), F.count_if(F.col("seq") > 0).alias("n"))
    return of.select("output_id", "text", stats(kind=F.lit("paths"), level=F.lit("L1"), kept=F.col("n")).alias("stats"))


def count_groups(found: DataFrame) -> DataFrame:
    """found: output_id, seq, path, count. Each file's first count, files of one directory under a line for it."""
    merged = lossless.merge_counts(found, "first")
    rows = paths.grouped_paths(merged.withColumn("path", F.concat_ws(":", "path", "count")))
    of = rows.groupBy("output_id").agg(gathered(["dir_seq", "seq", "row"], "row").alias("text"), F.count_if(F.col("seq") > 0).alias("n"))
    return of.select("output_id", "text", stats(kind=F.lit("count"), level=F.lit("L1"), kept=F.col("n")).alias("stats"))


def _largest(groups: DataFrame, config: Config, more: str) -> DataFrame:
    """groups: output_id, owner, n. output_id, owners: the largest by name, the others as a sum."""
    rows = groups.withColumn("place", F.row_number().over(of_output().orderBy(F.desc("n"), "owner")))
    few = F.col("place") <= config.note_max_files
    head = gathered(["place"], F.concat(F.col("owner"), F.lit("/ ("), number(F.col("n")), F.lit(")")), ", ")
    top = rows.filter(few).groupBy("output_id").agg(head.alias("head"))
    rest = rows.filter(~few).groupBy("output_id").agg(F.format_string(f"+%d {more} (%d)", F.count(F.lit(1)), F.sum("n")).alias("rest"))
    return top.join(rest, "output_id", "left").select("output_id", paragraphs(F.col("head"), F.col("rest"), by=", ").alias("owners"))


def listing_notes(found: DataFrame, config: Config) -> DataFrame:
    """found: output_id, seq, text. What fits: the levels of a tree or of recursive sections, else the first lines."""
    rows = found.withColumn("filled", F.trim("text") != "")
    size = rows.groupBy("output_id").agg(tokens_sum(), F.count(F.lit(1)).alias("rows"), F.count_if("filled").alias("filled"))
    budget = config.max_tokens - 40 - 12 * config.note_max_files
    small = size.filter(F.col("size") <= config.max_tokens)
    big = rows.join(small, "output_id", "left_anti").select("output_id", "seq", "text")
    tree = paths.tree_levels(big, budget)
    shown = tree.filter(F.col("level").isNotNull()).groupBy("output_id", "level").agg(
        gathered(["seq"], F.when(F.col("depth") <= F.col("level"), F.col("text"))).alias("body"), F.count_if(F.col("depth") <= F.col("level")).alias("kept"), F.count(F.lit(1)).alias("rows")
    )
    trees = shown.join(_largest(paths.tree_hidden(big, budget), config, "more dirs"), "output_id", "left")
    note = tagged(number(F.col("kept")), "/", number(F.col("rows")), " lines shown: ", number(F.col("rows") - F.col("kept")), " entries deeper than level ", number(F.col("level")), " not shown (under ", F.coalesce("owners", F.lit("")), ").")
    trees = trees.select("output_id", paragraphs(F.col("body"), note).alias("text"), F.concat(F.lit("tree depth "), number(F.col("level"))).alias("how"), "kept")
    other = big.join(trees, "output_id", "left_anti")
    found_levels = paths.ls_levels(other, budget)
    parts = paths.ls_sections(other).join(found_levels.select("output_id", "level", "sections", "entries"), "output_id")
    names = F.split(F.regexp_replace("name", "/+$", ""), "/")
    owner = F.array_join(F.slice(names, F.lit(1), F.greatest(F.size(names) - (F.col("depth") - F.col("level") - 1), F.lit(1)).cast("int")), "/")
    hidden = parts.filter("depth > level").groupBy("output_id", owner.alias("owner")).agg(F.count_if(~F.col("head") & (F.trim("text") != "")).alias("n"))
    shown = parts.groupBy("output_id", "level", "sections", "entries").agg(
        F.rtrim(gathered(["seq"], F.when(F.col("depth") <= F.col("level"), F.col("text")))).alias("body"), F.count_if("head").alias("all"), F.count_if((F.col("depth") <= F.col("level")) & (F.trim("text") != "")).alias("kept")
    )
    trimmed = F.regexp_replace("body", r"\n+$", "")
    sections = shown.join(_largest(hidden, config, "other dirs"), "output_id", "left")
    note = tagged(number(F.col("all") - F.col("sections")), "/", number(F.col("all")), " directories listed; ", number(F.col("sections")), " deeper directories not listed (", number(F.col("entries")), " entries), by directory: ", F.coalesce("owners", F.lit("")), ".")
    sections = sections.select("output_id", paragraphs(trimmed, note).alias("text"), F.concat(F.lit("ls depth "), number(F.col("level"))).alias("how"), "kept")
    rest = other.join(sections, "output_id", "left_anti")
    kept = lines.prefix_budget(rest.withColumn("cost", tokens(clip(F.col("text"), 300)) + 1), ["seq"], "cost", F.lit(budget), least_cost=1, most=max(budget, 1) + 1).filter("kept")
    first = kept.groupBy("output_id").agg(gathered(["seq"], clip(F.col("text"), 300)).alias("body"), F.count_if(F.trim("text") != "").alias("kept")).join(size, "output_id")
    note = tagged(number(F.col("kept")), "/", number(F.col("filled")), " lines shown; the last ", number(F.col("filled") - F.col("kept")), " lines not shown.")
    first = first.select("output_id", paragraphs(F.col("body"), note).alias("text"), F.lit("prefix").alias("how"), "kept")
    whole = rows.join(small, "output_id", "left_semi").groupBy("output_id").agg(gathered(["seq"], "text").alias("text"), F.lit("all").alias("how"), F.count_if("filled").alias("kept"))
    every = whole.unionByName(trees).unionByName(sections).unionByName(first)
    return every.select("output_id", "text", stats(kind=F.lit("lines"), steps=F.col("how"), kept=F.col("kept")).alias("stats"))


def tokens_sum() -> Column:
    return F.floor((F.sum(F.char_length("text") + 1) + 2) / 4).alias("size")


