"""Operators over paths: directory roll-up, grouping, listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import folder, folder_with_separator, group_path, tokens


def rollup_dirs(paths: DataFrame, limit: int = 10) -> DataFrame:
    """paths: output_id, seq, path, n. Returns output_id, place (from 1), dir, n: at most limit directories that cover all paths.

    The deepest directories move up to their parents until few enough are left; that is the same as cutting all
    directories to the depth where it stops, so each depth is one aggregation and the depth is chosen by rule.
    Where cutting would leave one or two of many, or depth 0 is still too much, the rest is lumped as +K other dirs.
    """
    limit = max(limit, 2)
    dirs = paths.select("output_id", "seq", "n", folder(group_path(F.col("path"))).alias("dir"))
    dirs = dirs.groupBy("output_id", "dir").agg(F.sum("n").alias("n"), F.min("seq").alias("seq"))
    parts = F.split("dir", "/", -1)
    deepest = dirs.groupBy("output_id").agg(F.max(F.size(parts) - 1).alias("deepest"))
    cuts = dirs.join(deepest, "output_id").select("output_id", "seq", "n", parts.alias("parts"), F.explode(F.sequence(F.lit(0), F.col("deepest"))).alias("depth"))
    cuts = cuts.select("output_id", "depth", F.array_join(F.slice("parts", F.lit(1), F.col("depth") + 1), "/").alias("dir"), "n", "seq")
    groups = cuts.groupBy("output_id", "depth", "dir").agg(F.sum("n").alias("n"), F.min("seq").alias("seq"))
    counts = groups.groupBy("output_id", "depth").agg(F.count(F.lit(1)).alias("groups"))
    up = F.lag("groups").over(Window.partitionBy("output_id").orderBy("depth"))
    counts = counts.withColumn("up", up).withColumn("big", F.col("groups") > limit)
    stops = counts.filter(~F.col("big") | (F.col("depth") == 0) | ((F.col("up") < 3) & (F.col("groups") > 3)))
    stop = stops.groupBy("output_id").agg(F.max_by(F.struct("depth", "big"), "depth").alias("s")).select("output_id", "s.*")
    chosen = groups.join(stop, ["output_id", "depth"])
    by_size = F.when(F.col("big") & (F.col("depth") > 0), -F.col("n")).otherwise(F.lit(0))
    order = Window.partitionBy("output_id").orderBy(by_size, "seq", "dir")
    placed = chosen.withColumn("place", F.row_number().over(order))
    head = F.when(F.col("big"), F.least("place", F.lit(limit))).otherwise(F.col("place"))
    out = placed.groupBy("output_id", head.alias("place")).agg(F.min_by("dir", "seq").alias("dir"), F.sum("n").alias("n"), F.max("big").alias("big"), F.count(F.lit(1)).alias("k"))
    rest = F.col("big") & (F.col("place") == limit)
    return out.select("output_id", F.col("place").cast("bigint").alias("place"), F.when(rest, F.concat(F.lit("+"), F.col("k").cast("string"), F.lit(" other dirs"))).otherwise(F.col("dir")).alias("dir"), "n")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """output_id, path, seq: each path once, without a leading ./, where it stood first."""
    return paths.groupBy("output_id", F.regexp_replace("path", r"^\./", "").alias("path")).agg(F.min("seq").alias("seq"))


def grouped_paths(paths: DataFrame) -> DataFrame:
    """output_id, dir_seq, seq, row: files of one directory under a dir/ line (seq 0), names indented; others flat."""
    rows = paths.withColumn("dir", folder_with_separator(F.col("path"))).withColumn("entry", F.col("dir") == F.col("path"))
    size = rows.filter("not entry").groupBy("output_id", "dir").agg(F.count(F.lit(1)).alias("files"))
    first = rows.groupBy("output_id", "dir").agg(F.min("seq").alias("dir_seq"))
    rows = rows.join(first, ["output_id", "dir"]).join(size, ["output_id", "dir"], "left")
    grouped = (F.col("dir") != "") & (F.coalesce("files", F.lit(0)) >= 2)
    rows = rows.withColumn("grouped", grouped)
    named = rows.select("output_id", "dir_seq", "seq", F.when(F.col("grouped") & ~F.col("entry"), F.concat(F.lit("  "), F.expr("substring(path, char_length(dir) + 1)"))).otherwise(F.col("path")).alias("row"))
    heads = rows.filter("grouped").select("output_id", "dir_seq", F.lit(0).cast("bigint").alias("seq"), F.col("dir").alias("row")).distinct()
    return named.unionByName(heads)


def tree_levels(rows: DataFrame, budget: int) -> DataFrame:
    """rows: output_id, seq, text of tree output. Adds depth, and level: the deepest level whose rows fit (null: none does, or no tree)."""
    entry = r"^((?:[│|]\s{3}|\s{4})*)(?:├──|└──|\|--|`--)\s"
    depth = F.when(F.col("text").rlike(entry), F.floor(F.char_length(F.regexp_extract("text", entry, 1)) / 4) + 1).otherwise(0).cast("bigint")
    rows = rows.withColumn("depth", depth)
    cost = rows.groupBy("output_id", "depth").agg(F.sum(tokens(F.col("text")) + 1).alias("cost"), F.count(F.lit(1)).alias("rows"))
    of = rows.groupBy("output_id").agg(F.max("depth").alias("deepest"), (F.count_if(F.col("depth") > 0) * 2 >= F.count(F.lit(1)) - 1).alias("tree"))
    total = F.sum("cost").over(Window.partitionBy("output_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    fit = cost.withColumn("total", total).join(of, "output_id").filter(F.col("tree") & (F.col("total") <= budget) & (F.col("depth") >= 1) & (F.col("depth") < F.col("deepest")))
    level = fit.groupBy("output_id").agg(F.max("depth").alias("level"))
    return rows.join(level, "output_id", "left")


def tree_hidden(rows: DataFrame, budget: int) -> DataFrame:
    """output_id, owner, n: the rows below the level that fits, under the kept entry that they belong to, as a path.

    Only kept rows, as many as the budget holds, are gathered: a walk over them, in order, gives each one's path. A row
    below belongs to the kept one before it.
    """
    entry = r"^(?:[│|]\s{3}|\s{4})*(?:├──|└──|\|--|`--)\s"
    rows = tree_levels(rows, budget).filter("level is not null").withColumn("name", F.trim(F.regexp_replace("text", entry, "")))
    kept = rows.filter("depth > 0 and depth <= level").groupBy("output_id").agg(F.array_sort(F.collect_list(F.struct("seq", "depth", "name"))).alias("kept"))
    start = F.struct(F.array().cast("array<string>").alias("at"), F.array().cast("array<struct<seq:bigint,owner:string>>").alias("out"))

    def step(acc, x):
        at = F.concat(F.slice(acc["at"], F.lit(1), x["depth"].cast("int") - 1), F.array(x["name"]))
        return F.struct(at.alias("at"), F.concat(acc["out"], F.array(F.struct(x["seq"].cast("bigint").alias("seq"), F.array_join(at, "/").alias("owner")))).alias("out"))

    owners = kept.select("output_id", F.explode(F.aggregate("kept", start, step)["out"]).alias("o")).select("output_id", "o.seq", "o.owner")
    up_to = Window.partitionBy("output_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(owners, ["output_id", "seq"], "left").withColumn("owner", F.coalesce(F.last("owner", ignorenulls=True).over(up_to), F.lit("")))
    return rows.filter("depth > level").groupBy("output_id", "owner").agg(F.count(F.lit(1)).alias("n"))


def ls_sections(rows: DataFrame) -> DataFrame:
    """rows: output_id, seq, text of ls -R output. Adds section (seq of its head), name, and depth below the first section."""
    order = Window.partitionBy("output_id").orderBy("seq")
    head = F.col("text").endswith(":") & (F.coalesce(F.trim(F.lag("text").over(order)), F.lit("")) == "")
    rows = rows.withColumn("head", head).withColumn("section", F.last(F.when(F.col("head"), F.col("seq")), ignorenulls=True).over(order))
    rows = rows.withColumn("name", F.last(F.when(F.col("head"), F.expr("substring(text, 1, char_length(text) - 1)")), ignorenulls=True).over(order))
    slashes = lambda c: F.char_length(F.regexp_replace(F.regexp_replace(c, "/+$", ""), "[^/]", ""))
    first = F.first("name", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("depth", (slashes(F.col("name")) - slashes(first)).cast("bigint"))


def ls_levels(rows: DataFrame, budget: int) -> DataFrame:
    """output_id, level, sections, entries: the deepest level of ls -R sections that fits, and what is not listed."""
    rows = ls_sections(rows)
    cost = rows.groupBy("output_id", "depth").agg(F.sum(tokens(F.col("text")) + 1).alias("cost"))
    deepest = rows.groupBy("output_id").agg(F.max("depth").alias("deepest"))
    total = F.sum("cost").over(Window.partitionBy("output_id").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))
    level = cost.withColumn("total", total).join(deepest, "output_id").filter(F.col("total") <= budget).filter("depth < deepest").groupBy("output_id").agg(F.max("depth").alias("level"))
    hidden = rows.join(level, "output_id").filter("depth > level")
    return hidden.groupBy("output_id", "level").agg(F.count_if("head").alias("sections"), F.count_if(~F.col("head") & (F.trim("text") != "")).alias("entries"))
