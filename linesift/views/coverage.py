"""The coverage view: an index of every file with matches, then evidence in what is left of the budget."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import tokens
from ..operators import coverage, paths
from ..operators import rank
from ..sources.shared import stored
from . import content
from .text import INDENT, Config, files, gathered, matches, number, paragraphs, tagged, of_output

SHARE = 0.35
#: Directories that files beyond the index's share are rolled up to.
ROLLED = 6


def index_text(index: DataFrame, shown: DataFrame, room: DataFrame) -> DataFrame:
    """output_id, index: a row a file while they fit room (output_id, room); else the files that are shown, as far as they fit
    half of it, and the others by directory. index: output_id, path, row, matches, seq; shown: output_id, path, shown."""
    rows = index.join(shown, ["output_id", "path"], "left").fillna({"shown": 0})
    mark = F.when(F.col("shown") >= F.col("matches"), " [all expanded]").when(F.col("shown") > 0, F.format_string(" [%d expanded]", "shown")).otherwise("")
    rows = stored(rows.withColumn("row", F.concat(F.lit(INDENT), F.col("row"), mark)).withColumn("cost", tokens(F.col("row")) + 1).join(room, "output_id"), "index")
    size = rows.groupBy("output_id").agg(F.sum("cost").alias("cost"), F.count(F.lit(1)).alias("n"), F.first("room").alias("room"))
    fits = size.filter((F.col("cost") <= F.col("room")) | (F.col("n") <= 3)).select("output_id")
    whole = rows.join(fits, "output_id", "left_semi").groupBy("output_id").agg(gathered(["seq", "path"], "row").alias("index"))
    wide = rows.join(fits, "output_id", "left_anti")
    total = F.sum("cost").over(of_output().orderBy(F.col("shown") == 0, "seq", "path"))
    wide = wide.withColumn("named", (F.col("shown") > 0) & (total * 2 <= F.col("room")))
    named = wide.filter("named").groupBy("output_id").agg(gathered(["seq", "path"], "row").alias("named"))
    rest = wide.filter("not named")
    per = lambda n, name: paths.rollup_dirs(rest.select("output_id", "seq", "path", n.cast("bigint").alias("n")), ROLLED).select("output_id", "place", "dir", F.col("n").alias(name))
    groups = per(F.col("matches"), "m").join(per(F.lit(1), "f").drop("place"), ["output_id", "dir"], "left")
    row = F.concat(F.lit(INDENT), F.col("dir"), F.when(F.col("dir").startswith("+"), "").otherwise("/"), F.lit(": "), F.coalesce(number(F.col("f")), F.lit("some")), F.lit(" files, "), number(F.col("m")), F.lit(" matches"))
    rolled = groups.groupBy("output_id").agg(gathered(["place"], row).alias("rolled"))
    return whole.unionByName(rolled.join(named, "output_id", "left").select("output_id", paragraphs(F.col("named"), F.col("rolled")).alias("index")))


def covered(rows: DataFrame, budgets: DataFrame, raw: DataFrame, config: Config, queries: DataFrame | None, scorer=rank.lexical, left: DataFrame | None = None) -> DataFrame:
    """output_id, text, shown, total. left: the rows that weren't shown before (all, if not given)."""
    names = raw.select("output_id", F.col("default_path"))
    index = coverage.file_index(rows).join(rows.filter("is_match").groupBy("output_id", "path").agg(F.min("seq").alias("seq")), ["output_id", "path"]).join(names, "output_id")
    label = F.when(F.col("file") != "", F.col("file")).when(F.col("default_path") != "", F.col("default_path")).otherwise("this file")
    index = coverage.index_rows(index.withColumnRenamed("path", "file").withColumn("path", label))
    index = stored(index.select("output_id", F.col("file").alias("path"), "row", "matches", "seq"), "files")
    most = F.floor(F.col("budget") * SHARE).cast("bigint")
    widest = F.char_length("row") + len(INDENT) + len(" [all expanded]")
    plan = index.groupBy("output_id").agg(F.sum(F.floor((widest + 3) / 4) + 1).cast("bigint").alias("cost"), F.sum("matches").alias("all"), F.count(F.lit(1)).alias("files")).join(budgets, "output_id")
    plan = stored(plan.withColumn("planned", F.least("cost", most)).withColumn("room", F.greatest(F.col("planned"), most)), "plan")
    inner = plan.select("output_id", F.greatest(F.col("budget") - F.col("planned") - 60, F.floor(F.col("budget") / 2)).cast("bigint").alias("budget"))
    found, shown = content.evidence(rows if left is None else left, inner, raw, Config(**vars(config) | {"note_max_files": 0}), queries, scorer)
    per_file = shown.filter("is_match").groupBy("output_id", "path").agg(F.count(F.lit(1)).alias("shown"))
    text = index_text(index, per_file, plan.select("output_id", "room"))
    out = plan.join(text, "output_id").join(found.select("output_id", "body", "shown"), "output_id", "left").fillna({"shown": 0, "body": ""})
    lead = tagged(matches(F.col("all")), " in ", files(F.col("files")), "; ", number(F.col("shown")), " shown below.")
    return out.select("output_id", paragraphs(lead, F.col("index"), F.col("body")).alias("text"), "shown", F.col("all").alias("total"), "files")
