"""Parsers of tool output: raw (output_id, raw) to typed rows, without Python on the executors.

Lines of one output are walked in order by windows over that output; an output is one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import looks_like_path
from ..sources.corpus import split_lines

MATCH = r"^(.+?):([0-9]+):(.*)$"
CONTEXT = r"^(.+?)-([0-9]+)-(.*)$"
BARE = r"^([0-9]+)([:-])(.*)$"
COUNT = r"^(.+):([0-9]+)$"
FRAMING = r"^(?:Found [0-9]+ .+|No (?:files|matches) found\.?|\(Results are truncated[^)]*\)\.?|\[Showing results with pagination[^\]]*\])$"
SELECT_STRING = r"^(> |  )(\S.*?):([0-9]+):(.*)$"

def in_order():
    return Window.partitionBy("output_id").orderBy("seq")


def up_to():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


def raw_lines(outputs: DataFrame) -> DataFrame:
    """output_id, seq (from 1), line."""
    rows = outputs.select("output_id", F.posexplode(split_lines(F.col("raw"))).alias("p", "line"))
    return rows.select("output_id", (F.col("p") + 1).cast("bigint").alias("seq"), "line")


def blank(line: Column) -> Column:
    return F.trim(line) == ""


def detect_kind(rows: DataFrame) -> DataFrame:
    """output_id, kind: content, paths or count, from the shape of the lines that are neither blank nor separators."""
    use = rows.filter(~blank(F.col("line")) & (F.col("line") != "--"))
    nxt, prev = F.lead("line").over(in_order()), F.lag("line").over(in_order())
    name = F.regexp_extract("line", r"^  (.*)$", 1)
    indented = F.col("line").startswith("  ")
    opens = F.col("line").rlike(r"[/\\]$")
    row_ok = F.when(indented, name.rlike(COUNT) & F.coalesce(F.col("prev").rlike(r"[/\\]$") | F.col("prev").startswith("  "), F.lit(False))).otherwise(
        F.col("line").rlike(COUNT) | (opens & F.coalesce(F.col("nxt").startswith("  "), F.lit(False)))
    )
    use = use.withColumn("nxt", nxt).withColumn("prev", prev)
    event = F.get_json_object("line", "$.type").isin("begin", "match", "context", "end", "summary")
    of = use.groupBy("output_id").agg(
        F.max_by(F.col("line").startswith("{") & F.coalesce(event, F.lit(False)), -F.col("seq")).alias("json"), F.bool_and(F.col("line").rlike(COUNT)).alias("counts"),
        (F.bool_and(row_ok) & F.bool_or(indented)).alias("grouped"), F.bool_or(F.col("line").rlike(MATCH) | F.col("line").rlike(BARE)).alias("content"),
    )
    kind = F.when(F.col("json"), "content").when(F.col("counts") | F.col("grouped"), "count").when(F.col("content"), "content").otherwise("paths")
    return rows.select("output_id").distinct().join(of.select("output_id", kind.alias("kind")), "output_id", "left").select("output_id", F.coalesce("kind", F.lit("paths")).alias("kind"))


def with_framing(rows: DataFrame) -> DataFrame:
    """Adds part: header, body or footer. Framing lines and blanks at either end are no body; blank ones get null."""
    frame = blank(F.col("line")) | F.trim("line").rlike(FRAMING)
    rows = rows.withColumn("frame", frame)
    head = F.bool_and("frame").over(up_to())
    foot = F.bool_and("frame").over(in_order().rowsBetween(0, Window.unboundedFollowing))
    part = F.when(F.col("head"), F.lit("header")).when(F.col("foot"), F.lit("footer")).otherwise(F.lit("body"))
    rows = rows.withColumn("head", head).withColumn("foot", foot)
    return rows.withColumn("part", F.when((part != "body") & blank(F.col("line")), F.lit(None)).otherwise(part)).drop("frame", "head", "foot")


def flat_content(rows: DataFrame) -> DataFrame:
    """Rows of path:N:text and path-N-text, where a context line's path is the longest prefix that some match line names.

    Adds path, number, text, is_match; null where the line is neither.
    """
    match = F.col("line").rlike(MATCH)
    known = rows.filter(match).select("output_id", F.regexp_extract("line", MATCH, 1).alias("path")).distinct()
    # Every place where "-digits-" could end a path; only those whose prefix is known are left by the join.
    cut = F.filter(F.sequence(F.lit(1), F.char_length("line")), lambda i: (F.substring(F.col("line"), i, F.lit(1)) == "-") & F.substring(F.col("line"), i, F.char_length("line")).rlike(r"^-[0-9]+-"))
    cuts = rows.filter(~match & F.col("line").contains("-")).select("output_id", "seq", "line", F.explode(cut).alias("i")).filter("i > 1")
    cuts = cuts.withColumn("path", F.expr("substring(line, 1, i - 1)"))
    best = cuts.join(known, ["output_id", "path"]).groupBy("output_id", "seq").agg(F.max("i").alias("i"))
    rows = rows.join(best, ["output_id", "seq"], "left")
    rest = F.expr("substring(line, i)")
    first = F.regexp_extract("line", CONTEXT, 1)
    guess = F.col("i").isNull() & F.col("line").rlike(CONTEXT) & looks_like_path(first)
    is_match = F.when(match, F.lit(True)).when(F.col("i").isNotNull() | guess, F.lit(False))
    return rows.select(
        "output_id", "seq", "line", F.when(match, F.regexp_extract("line", MATCH, 1)).when(F.col("i").isNotNull(), F.expr("substring(line, 1, i - 1)")).when(guess, first).alias("path"),
        F.when(match, F.regexp_extract("line", MATCH, 2)).when(F.col("i").isNotNull(), F.regexp_extract(rest, r"^-([0-9]+)-", 1)).when(guess, F.regexp_extract("line", CONTEXT, 2)).try_cast("bigint").alias("number"),
        F.when(match, F.regexp_extract("line", MATCH, 3)).when(F.col("i").isNotNull(), F.regexp_replace(rest, r"^-[0-9]+-", "")).when(guess, F.regexp_extract("line", CONTEXT, 3)).alias("text"), is_match.alias("is_match"),
    )


def headed_content(rows: DataFrame) -> DataFrame:
    """Rows under headings: a path line, then N:text or N-text; a blank line ends a heading."""
    bare = F.col("line").rlike(BARE)
    head = F.when(blank(F.col("line")), F.lit("")).when(~bare & (F.col("line") != "--") & looks_like_path(F.col("line")), F.col("line"))
    rows = rows.withColumn("path", F.last(head, ignorenulls=True).over(up_to()))
    return rows.filter(bare).select("output_id", "seq", F.coalesce("path", F.lit("")).alias("path"), F.regexp_extract("line", BARE, 1).try_cast("bigint").alias("number"), F.regexp_extract("line", BARE, 3).alias("text"), (F.regexp_extract("line", BARE, 2) == ":").alias("is_match"))


def same_line_groups(rows: DataFrame, head: str) -> DataFrame:
    """Rows of a line text found at several places: a head line with the text, then rows of "  path:1,2,3"."""
    text = F.when(F.col("line").rlike(head), F.regexp_extract("line", head, 1)).when(~F.col("line").rlike(r"^  (?:.+:)?[0-9]+(?:,[0-9]+)*$"), F.lit("\0"))
    rows = rows.withColumn("text", F.last(text, ignorenulls=True).over(up_to())).filter((F.col("text") != "\0") & ~F.col("line").rlike(head))
    place = r"^  (?:(.+):)?([0-9]+(?:,[0-9]+)*)$"
    numbers = F.split(F.regexp_extract("line", place, 2), ",").try_cast("array<bigint>")
    return rows.select("output_id", "seq", F.regexp_extract("line", place, 1).alias("path"), F.explode(numbers).alias("number"), "text", F.lit(True).alias("is_match"))


def select_string(rows: DataFrame) -> DataFrame:
    """Rows of Select-String -Context; an output with any other line, or without a match, has none."""
    use = rows.filter(~blank(F.col("line")))
    ok = use.groupBy("output_id").agg((F.bool_and(F.col("line").rlike(SELECT_STRING)) & F.bool_or(F.col("line").rlike(r"^> \S"))).alias("ok")).filter("ok")
    part = lambda i: F.regexp_extract("line", SELECT_STRING, i)
    return use.join(ok, "output_id").select("output_id", "seq", part(2).alias("path"), part(3).try_cast("bigint").alias("number"), part(4).alias("text"), (part(1) == "> ").alias("is_match"))


EVENT = "struct<type:string,data:struct<path:struct<text:string>,lines:struct<text:string>,line_number:bigint>>"


def json_events(rows: DataFrame) -> DataFrame:
    """Rows of ripgrep's JSON events; texts of several lines become consecutive rows, and lines that are no JSON are left out."""
    e = F.from_json("line", EVENT)
    rows = rows.select("output_id", "seq", e.alias("e")).filter(F.col("e.type").isin("match", "context"))
    text = F.regexp_replace(F.coalesce("e.data.lines.text", F.lit("<non-utf8>")), r"\n+\z", "")
    rows = rows.select("output_id", "seq", F.coalesce("e.data.path.text", F.lit("<non-utf8>")).alias("path"), F.col("e.data.line_number").alias("n"), F.posexplode(F.split(text, "\n", -1)).alias("p", "text"), (F.col("e.type") == "match").alias("is_match"))
    return rows.select("output_id", "seq", "path", (F.col("n") + F.col("p")).alias("number"), "text", "is_match")


def listed_entries(rows: DataFrame) -> DataFrame:
    """Rows of a path list or count list, with names below dir/ lines spelt out: output_id, seq, entry."""
    nxt = F.coalesce(F.lead("line").over(in_order()), F.lit(""))
    inside = F.col("line").startswith("  ") & ~blank(F.col("line"))
    opens = ~F.col("line").startswith(" ") & F.col("line").rlike(r"[/\\]$") & F.col("nxt").startswith("  ") & ~blank(F.col("nxt"))
    rows = rows.withColumn("nxt", nxt).withColumn("opens", opens)
    here = F.when(F.col("opens"), F.col("line")).when(~inside, F.lit(""))
    rows = rows.withColumn("dir", F.coalesce(F.last(here, ignorenulls=True).over(up_to()), F.lit("")))
    rows = rows.filter(~F.col("opens") & ~blank(F.col("line")))
    return rows.select("output_id", "seq", F.when((F.col("dir") != "") & inside, F.concat("dir", F.trim("line"))).otherwise(F.trim("line")).alias("entry"))


def parse_counts(rows: DataFrame) -> DataFrame:
    e = listed_entries(rows).filter(F.col("entry").rlike(COUNT))
    return e.select("output_id", "seq", F.regexp_extract("entry", COUNT, 1).alias("path"), F.regexp_extract("entry", COUNT, 2).try_cast("bigint").alias("count"))


def reliable(rows: DataFrame, parsed: DataFrame) -> DataFrame:
    """output_id, reliable: whether a content parse accounts for the output: some match, and at most 2 or 5 % of its lines unparsed."""
    use = rows.filter(~blank(F.col("line")) & (F.col("line") != "--"))
    rows = use.join(parsed.select("output_id", "seq", "is_match"), ["output_id", "seq"], "left")
    of = rows.groupBy("output_id").agg(F.count(F.lit(1)).alias("n"), F.count("is_match").alias("parsed"), F.count_if(F.coalesce("is_match", F.lit(False))).alias("hits"))
    left = F.col("n") - F.col("parsed")
    return of.select("output_id", (((F.col("parsed") == 0) | (F.col("hits") > 0)) & (left <= F.greatest(F.lit(2.0), F.col("n") * 0.05))).alias("reliable"))
