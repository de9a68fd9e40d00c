"""Views that keep every match: what repeats in paths and texts is written once, and where that is not enough, only names are kept.

Each returns output_id, text (without header and footer) and, where it differs, further columns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import recognise
from ..functions.text import clip, folder_with_separator
from ..operators import lines, lossless
from ..operators.read import stands_alone
from .text import FULL_LINE, INDENT, Config, files, gathered, matches, number, paragraphs, tagged, of_output


def layout(rows: DataFrame, config: Config) -> DataFrame:
    """output_id, text: rows in the shortest of the layouts that read back.

    A file stands flat (its path on each row) or as a heading above its rows; files of one directory, if there are
    several, stand below a line for the directory, again flat or headed, by their names. Flat files come first.
    """
    limit = max(config.max_line_chars, FULL_LINE)
    rows = lines.with_blocks(rows, config.merge_gap)
    context = F.bool_or(~F.col("is_match")).over(of_output())
    rows = rows.withColumn("context", context)
    sep = F.when(F.col("is_match"), ":").otherwise("-")
    rows = rows.withColumn("bare", F.concat(F.col("number").cast("string"), sep, clip(F.col("text"), limit))).withColumn("sep", sep)
    dir_ = folder_with_separator(F.col("path"))
    per = rows.groupBy("output_id", "path", "context").agg(
        F.min("seq").alias("first"), F.count(F.lit(1)).alias("n"),
        F.array_sort(F.collect_list(F.struct("number", "block", "sep", "bare"))).alias("rows"),
    ).withColumn("dir", dir_)
    name = F.char_length("path") - F.char_length("dir")
    nested = F.least(name + 3 + 4 * F.col("n"), (name + 2) * F.col("n"))
    able = (F.col("dir") != "") & stands_alone(F.col("path")) & stands_alone(F.concat(F.col("dir"), F.lit("x"))) & ((F.col("n") == 1) | (nested < F.char_length("path") + 1))
    per = per.withColumn("able", able)
    several = F.count_if("able").over(Window.partitionBy("output_id", "dir")) >= 2
    per = per.withColumn("group", F.when(F.col("able") & several, F.col("dir")).otherwise(""))
    name = F.char_length("path") - F.char_length("group")
    flat = F.when(F.col("path") == "", True).when(F.col("group") == "", (F.col("n") == 1) | ~stands_alone(F.col("path"))).otherwise((F.col("n") == 1) | ((name + 2) * F.col("n") < name + 3 + 4 * F.col("n")))
    per = per.withColumns({"flat": flat, "name": F.expr("substring(path, char_length(group) + 1)")})
    indent = F.when(F.col("group") == "", F.lit("")).when(F.col("flat"), F.lit(INDENT)).otherwise(F.lit(2 * INDENT))

    def row(x: Column, i: Column) -> Column:
        text = F.concat(indent, F.when(F.col("flat") & (F.col("path") != ""), F.concat("name", x["sep"])).otherwise(""), x["bare"])
        cut = F.col("context") & (i > 0) & (F.get(F.col("rows"), i - 1)["block"] != x["block"])
        return F.when(cut, F.concat(indent, F.lit("--\n"), text)).otherwise(text)

    body = F.array_join(F.transform("rows", row), "\n")
    head = F.when(~F.col("flat"), F.concat(F.when(F.col("group") == "", "").otherwise(INDENT), F.col("name"), F.lit("\n"))).otherwise("")
    per = per.withColumn("text", F.concat(head, body))
    # Files without a group are paragraphs of their own, but for flat ones, which are one; a group is one.
    key = F.when(F.col("group") != "", F.col("group")).when(F.col("flat"), F.lit("")).otherwise(F.col("path"))
    kind = F.when(F.col("group") != "", 2).when(F.col("flat"), 0).otherwise(1)
    parts = per.groupBy("output_id", kind.alias("kind"), key.alias("key")).agg(F.min("first").alias("first"), gathered(["first", "path"], "text").alias("text"))
    parts = parts.withColumn("text", F.when(F.col("kind") == 2, F.concat("key", F.lit("\n"), "text")).otherwise(F.col("text")))
    return parts.groupBy("output_id").agg(gathered(["kind", "first", "key"], "text", "\n\n").alias("text"))


def numbers(order: str = "number") -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(order)), number), ",")


def places(rows: DataFrame) -> Column:
    return F.when(F.col("path") == "", F.col("numbers")).otherwise(F.concat_ws(":", "path", "numbers"))


def shortest(rows: DataFrame, config: Config) -> DataFrame:
    """output_id, text: layout(), or with repeated texts written once, whichever is shorter."""
    limit = max(config.max_line_chars, FULL_LINE)
    plain = layout(rows, config)
    alone = rows.groupBy("output_id").agg(F.bool_and("is_match").alias("alone")).filter("alone").select("output_id")
    bare = rows.join(alone, "output_id", "left_semi").withColumn("key", lossless.strip(F.col("text")))
    once = lossless.factor_repeats(bare).select("output_id", F.col("text").alias("key"), "count", F.col("seq").alias("lead"))
    held = bare.join(once, ["output_id", "key"])
    per = held.groupBy("output_id", "key", "count", "lead", "path").agg(numbers().alias("numbers"), F.min("seq").alias("seq"))
    texts = per.groupBy("output_id", "key", "count", "lead").agg(gathered(["seq"], F.concat(F.lit(INDENT), places(per))).alias("rows"))
    head = tagged(number(F.col("count")), " " + lossless.SAME_LINE, clip(F.col("key"), limit))
    groups = texts.groupBy("output_id").agg(gathered(["lead", "key"], F.concat(head, F.lit("\n"), F.col("rows"))).alias("groups"))
    rest = layout(bare.join(once, ["output_id", "key"], "left_anti").drop("key"), config).withColumnRenamed("text", "rest")
    both = groups.join(rest, "output_id", "left").select("output_id", paragraphs(F.col("rest"), F.col("groups")).alias("other"))
    out = plain.join(both, "output_id", "left")
    return out.select("output_id", F.when(F.char_length("other") < F.char_length("text"), F.col("other")).otherwise(F.col("text")).alias("text"))


def projected(rows: DataFrame, queries: DataFrame, config: Config) -> DataFrame:
    """Matches as the names that they hold, with every place; output_id, text, kind, names. Outputs whose search asks for no kind,
    or where no kind reads half of the matches, are left out. queries: output_id, pattern."""
    found = rows.filter("is_match").join(queries.select("output_id", F.lower("pattern").alias("_pattern")).filter("_pattern <> ''"), "output_id")
    words = recognise.asking_words()
    asks = lambda kind: reduce(lambda a, b: a | b, (F.col("_pattern").contains(w) for w in words[kind]))
    read = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(kind).alias("kind"), F.when(asks(kind), recognise.names_in(F.col("text"), kind)).alias("names")) for i, kind in enumerate(words)))
    each = found.select("output_id", "seq", "path", "number", "text", "is_match", F.explode(read).alias("k")).select("output_id", "seq", "path", "number", "text", "is_match", "k.*").filter("names is not null")
    sums = each.groupBy("output_id", "i", "kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("names") > 0).alias("hits"))
    best = sums.filter("hits > 0 and 2 * hits >= n").groupBy("output_id").agg(F.max_by(F.struct("kind", "n", "hits"), F.struct("hits", -F.col("i"))).alias("b")).select("output_id", "b.*")
    mine = each.join(best, ["output_id", "kind"])
    named = mine.select("output_id", "path", "number", "seq", F.posexplode("names").alias("p", "name"))
    rest = layout(mine.filter(F.size("names") == 0).select("output_id", "seq", "path", "number", "text", "is_match"), config).withColumnRenamed("text", "rest")
    per = named.groupBy("output_id", "name", "path").agg(numbers().alias("numbers"), F.min("seq").alias("seq"))
    per = per.withColumn("low", F.lower("name"))
    by_name = per.groupBy("output_id", "low", "name").agg(gathered(["seq"], places(per), " ").alias("at"))
    by_name = by_name.groupBy("output_id").agg(gathered(["low", "name"], F.concat(F.lit(INDENT), "name", F.lit("  "), "at")).alias("a"), F.count(F.lit(1)).alias("names"), gathered(["low", "name"], "name", ", ").alias("all"))
    by_file = named.groupBy("output_id", "path").agg(gathered(["number", "p"], F.concat_ws(":", "name", "number"), " ").alias("at"), F.min("seq").alias("seq"))
    by_file = by_file.withColumn("dir", folder_with_separator(F.col("path")))
    several = (F.col("dir") != "") & (F.count(F.lit(1)).over(Window.partitionBy("output_id", "dir")) >= 2)
    row = F.concat(F.when(several, F.concat(F.lit(INDENT), F.expr("substring(path, char_length(dir) + 1)"))).when(F.col("path") == "", "(file)").otherwise(F.col("path")), F.lit("  "), F.col("at"))
    by_file = by_file.withColumns({"row": F.concat(F.lit(INDENT), row), "group": F.when(several, F.col("dir")).otherwise(F.concat(F.lit("\0"), "path"))})
    by_file = by_file.groupBy("output_id", "group").agg(gathered(["seq"], "row").alias("rows"), F.min("seq").alias("seq"))
    by_file = by_file.withColumn("rows", F.when(F.col("group").startswith("\0"), F.col("rows")).otherwise(F.concat(F.lit(INDENT), F.col("group"), F.lit("\n"), F.col("rows"))))
    by_file = by_file.groupBy("output_id").agg(gathered(["seq"], "rows").alias("b"))
    file_count = found.groupBy("output_id").agg(F.count_distinct("path").alias("files"))
    out = best.join(by_name, "output_id").join(by_file, "output_id").join(file_count, "output_id").join(rest, "output_id", "left")
    lead = tagged(matches(F.col("n")), " in ", files(F.col("files")), ". ", number(F.col("hits")), " matching lines read as ", number(F.col("names")), " ", F.col("kind"), " names")
    tail = F.when(F.col("hits") < F.col("n"), F.format_string("; the other %d matching lines below.", F.col("n") - F.col("hits"))).otherwise(".")
    a = F.concat(lead, F.lit(", each with every place it is used (path:lines)"), tail, F.lit("\n"), F.col("a"))
    b = F.concat(lead, F.lit("; each file with name:line for its matches, all names listed at the end"), tail, F.lit("\n"), F.col("b"))
    end = tagged("all ", number(F.col("names")), " ", F.col("kind"), " names: ", F.col("all"))
    first = F.char_length(a) <= F.char_length(b)
    return out.select("output_id", paragraphs(F.when(first, a).otherwise(b), F.col("rest"), F.when(~first, end)).alias("text"), "kind", "names")
