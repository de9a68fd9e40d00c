"""Raw tool output to typed rows: framing, kind, and the rows of any layout, also where one output mixes several.

An output is one text; its lines are walked by windows over that output. What a line means is told by its own shape and
by the nearest line above that opens or closes a context: a heading, a directory, a text that is written once.
"""

from __future__ import annotations

from copy import copy

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TAG, looks_like_path, norm_path
from ..sources.shared import stored
from . import parse
from .lossless import SAME_LINE

GROUP = r"^\Q" + TAG + r"\E [0-9]+ \Q" + SAME_LINE + r"\E(.*)$"
PLACES = r"^  (?:(.+):)?([0-9]+(?:,[0-9]+)*)$"
#: Places of one line are numbered within its step.
STEP = 1_000_000
ROWS = ["output_id", "seq", "path", "number", "text", "is_match"]


def framed(outputs: DataFrame) -> DataFrame:
    """output_id, seq, line, part: header, body or footer; the blank lines beside header and footer are left out.

    An output without header and footer is all body.
    """
    rows = parse.raw_lines(outputs)
    frame = parse.blank(F.col("line")) | F.trim("line").rlike(parse.FRAMING)
    rows = rows.withColumn("frame", frame)
    whole = Window.partitionBy("output_id")
    rows = rows.withColumns({"a": F.min(F.when(~F.col("frame"), F.col("seq"))).over(whole), "b": F.max(F.when(~F.col("frame"), F.col("seq"))).over(whole)})
    place = F.when(F.col("a").isNull() | (F.col("seq") < F.col("a")), "header").when(F.col("seq") > F.col("b"), "footer").otherwise("body")
    rows = rows.withColumn("part", place)
    some = F.bool_or((F.col("part") != "body") & ~parse.blank(F.col("line"))).over(whole)
    rows = rows.withColumn("some", some).withColumn("part", F.when(~F.col("some"), "body").otherwise(F.col("part")))
    return rows.filter((F.col("part") == "body") | ~parse.blank(F.col("line"))).select("output_id", "seq", "line", "part")


def stands_alone(path: Column) -> Column:
    """Whether a path on a line of its own reads back as a heading."""
    first = F.regexp_extract(path, parse.CONTEXT, 1)
    return looks_like_path(path) & ~path.rlike(parse.MATCH) & ~path.rlike(parse.BARE) & ~path.rlike(GROUP) & ~(path.rlike(parse.CONTEXT) & looks_like_path(first))


def mixed_rows(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: output_id, seq, line. Returns the typed rows (see ROWS), and the lines that are none (output_id, seq, line).

    Rows are flat, under a heading, under a file of a directory, bare, or the places of a text that is written once.
    A blank line ends a heading, and so does a line at the left margin that is no row of it.
    """
    line, step = F.col("line"), parse.up_to()
    text = F.when(line.rlike(GROUP), F.regexp_extract(line, GROUP, 1)).when(~line.rlike(PLACES), F.lit("\0"))
    rows = rows.withColumn("once", F.coalesce(F.last(text, ignorenulls=True).over(step), F.lit("\0")))
    rows = rows.withColumn("place", (F.col("once") != "\0") & ~line.rlike(GROUP))
    bare, sep, gap = line.rlike(parse.BARE), line == "--", parse.blank(line)
    flat = lambda df, name: parse.flat_content(df.select("output_id", "seq", "line")).select("output_id", "seq", F.struct("path", "number", "text", "is_match").alias(name))
    rows = rows.join(flat(rows.filter(~F.col("place")), "margin"), ["output_id", "seq"], "left")
    head = stands_alone(line) & F.col("margin.is_match").isNull()
    opens = F.when(gap | line.rlike(GROUP), F.lit("")).when(F.col("place") | sep | bare | line.startswith("  "), F.lit(None)).when(head, line).otherwise("")
    opened = F.when(opens.isNotNull(), F.struct("seq", opens.alias("path")))
    rows = rows.withColumn("head", F.last(opened, ignorenulls=True).over(step))
    heading = F.coalesce("head.path", F.lit(""))
    below = heading.rlike(r"[/\\]$") & line.startswith("  ") & ~F.col("place") & ~gap
    rows = rows.withColumns({"heading": heading, "below": below, "deep": below & line.startswith("    "), "is_head": F.coalesce(F.col("head.seq") == F.col("seq"), F.lit(False)) & (heading != "")})
    use = F.when(F.col("below") & ~F.col("deep"), F.concat("heading", F.expr("substring(line, 3)"))).when(F.col("deep"), F.expr("substring(line, 5)")).otherwise(line)
    rows = rows.withColumn("raw", line).withColumn("line", use)
    rows = rows.join(flat(rows.filter(F.col("below") & ~F.col("deep")), "inner"), ["output_id", "seq"], "left")
    rows = rows.withColumn("flat", F.when(F.col("below"), F.col("inner")).when(~F.col("is_head"), F.col("margin")))
    # A name below a directory that is no row opens a file; it holds while its directory does.
    shallow = F.col("below") & ~F.col("deep") & F.col("flat.is_match").isNull() & looks_like_path(line)
    file = F.last(F.when(shallow, F.struct("seq", line.alias("path"))), ignorenulls=True).over(step)
    rows = rows.withColumn("file", file).withColumn("file", F.when(F.col("file.seq") > F.col("head.seq"), F.col("file.path")))
    number, said, colon = (F.regexp_extract(line, parse.BARE, i) for i in (1, 3, 2))
    owner = F.when(F.col("deep"), F.col("file")).when(~F.col("heading").rlike(r"[/\\]$"), F.col("heading")).otherwise("")
    under = line.rlike(parse.BARE) & ~F.col("place") & (~F.col("below") | F.col("deep")) & owner.isNotNull()
    found = F.when(F.col("flat.is_match").isNotNull() & ~F.col("raw").rlike(parse.BARE), F.col("flat")).when(under, F.struct(owner.alias("path"), number.try_cast("bigint").alias("number"), said.alias("text"), (colon == ":").alias("is_match")))
    rows = rows.withColumns({"found": found, "shallow": shallow})
    # A heading that nothing followed was none.
    used = F.bool_or((F.col("found").isNotNull() & ~F.col("is_head")) | F.col("shallow")).over(Window.partitionBy("output_id", "head.seq"))
    used = F.col("is_head") & used
    rows = stored(rows.withColumn("used", used).select("output_id", "seq", "raw", "place", "once", "found", "used", "shallow"), "walked")
    typed = rows.filter("found is not null").select("output_id", (F.col("seq") * STEP).alias("seq"), "found.*")
    numbers = F.split(F.regexp_extract("raw", PLACES, 2), ",").try_cast("array<bigint>")
    once = rows.filter("place").select("output_id", "seq", F.regexp_extract("raw", PLACES, 1).alias("path"), F.posexplode(numbers).alias("i", "number"), F.col("once").alias("text"), F.lit(True).alias("is_match"))
    typed = typed.unionByName(once.withColumn("seq", F.col("seq") * STEP + F.col("i")).drop("i"))
    left = rows.filter(~F.col("place") & F.col("found").isNull() & ~F.col("used") & ~F.col("shallow") & ~F.col("raw").rlike(GROUP) & ~parse.blank(F.col("raw")) & (F.trim("raw") != "--"))
    return typed.select(ROWS), left.select("output_id", "seq", F.col("raw").alias("line"))


def content(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Typed rows and unread lines of content outputs: JSON events, Select-String -Context, or the mixed layouts. Layouts that no
    output has are left out of the plans."""
    use = rows.filter(~parse.blank(F.col("line")))
    first = use.groupBy("output_id").agg(F.min_by("line", "seq").alias("first"), F.bool_and(F.col("line").rlike(parse.SELECT_STRING)).alias("marked"), F.bool_or(F.col("line").rlike(r"^> \S")).alias("hit"))
    event = F.coalesce(F.get_json_object("first", "$.type").isin("begin", "match", "context", "end", "summary"), F.lit(False))
    how = F.when(F.col("first").startswith("{") & event, "events").when(F.col("marked") & F.col("hit"), "marked").otherwise("mixed")
    first = stored(first.select("output_id", how.alias("how")), "layouts")
    present = {r["how"] for r in first.select("how").distinct().collect()}
    rows = rows.join(first, "output_id")
    of = lambda h: rows.filter(F.col("how") == h).select("output_id", "seq", "line")
    typed, left = mixed_rows(of("mixed"))
    step = lambda df: df.withColumn("seq", F.col("seq") * STEP).select(ROWS)
    if "events" in present:
        left = left.unionByName(of("events").filter(~parse.blank(F.col("line")) & F.try_parse_json("line").isNull()))
        order = Window.partitionBy("output_id", "seq").orderBy("number")
        events = parse.json_events(of("events"))
        typed = typed.unionByName(events.withColumn("seq", F.col("seq") * STEP + F.row_number().over(order)).select(ROWS))
    if "marked" in present:
        typed = typed.unionByName(step(parse.select_string(of("marked"))))
    return typed, left


class Reading:
    """What outputs (output_id, raw) hold. kind: content, paths, count or lines for all of them; found out if not given.

    kinds: output_id, kind. rows: see ROWS. paths: output_id, seq, path. counts: output_id, seq, path, count.
    listing: output_id, seq, text. unread: output_id, seq, line. frame: output_id, header, footer.
    """

    def __init__(self, outputs: DataFrame, kind: str | None = None):
        outputs = outputs.select("output_id", F.coalesce("raw", F.lit("")).alias("raw"))
        lines = stored(framed(outputs) if kind != "lines" else parse.raw_lines(outputs).withColumn("part", F.lit("body")), "framed")
        ends = lambda part: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("part") == part, F.struct("seq", "line")))), lambda x: x["line"]), "\n")
        self.frame = lines.filter("part <> 'body'").groupBy("output_id").agg(ends("header").alias("header"), ends("footer").alias("footer"))
        body = lines.filter("part = 'body'").select("output_id", "seq", "line")
        found = parse.detect_kind(body) if kind is None else outputs.select("output_id", F.lit(kind).alias("kind"))
        self.kinds = stored(outputs.select("output_id").join(found, "output_id", "left").select("output_id", F.coalesce("kind", F.lit("paths")).alias("kind")), "kinds")
        of = lambda k: body.join(self.kinds.filter(F.col("kind") == k), "output_id", "left_semi")
        rows, unread = content(of("content"))
        self.rows = rows
        self.paths = parse.listed_entries(of("paths")).select("output_id", "seq", F.col("entry").alias("path"))
        counted = parse.listed_entries(of("count"))
        self.counts = parse.parse_counts(of("count"))
        self.unread = unread.unionByName(counted.filter(~F.col("entry").rlike(parse.COUNT)).select("output_id", "seq", F.col("entry").alias("line")))
        self.listing = of("lines").select("output_id", "seq", F.col("line").alias("text"))

    def only(self, outputs: DataFrame, how: str) -> Reading:
        """What some outputs hold: a left_semi or left_anti join with output_id."""
        other = copy(self)
        for name in ("kinds", "rows", "unread", "paths", "counts", "listing"):
            setattr(other, name, getattr(self, name).join(outputs, "output_id", how))
        return other

    def present(self) -> set[str]:
        """The kinds that any output has."""
        return {r["kind"] for r in self.kinds.select("kind").distinct().collect()}

    def reliable(self) -> DataFrame:
        """output_id of the outputs whose reading accounts for the text; the others should be passed on as they are."""
        rows = self.rows.groupBy("output_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_match").alias("hits"))
        left = self.unread.groupBy("output_id").agg(F.count(F.lit(1)).alias("left"))
        colon = self.paths.groupBy("output_id").agg(F.bool_or(F.regexp_replace("path", "^[A-Za-z]:", "").contains(":")).alias("colon"))
        of = self.kinds.join(rows, "output_id", "left").join(left, "output_id", "left").join(colon, "output_id", "left").fillna({"n": 0, "hits": 0, "left": 0, "colon": False})
        read = ((F.col("n") == 0) | (F.col("hits") > 0)) & (F.col("left") <= F.greatest(F.lit(2.0), (F.col("n") + F.col("left")) * 0.05))
        return of.filter(F.when(F.col("kind") == "paths", ~F.col("colon")).when(F.col("kind") == "content", read).otherwise(F.lit(True))).select("output_id")


def locations(outputs: DataFrame) -> DataFrame:
    """output_id, path, number: the places of all matches that a text shows, in any layout but the projections by name."""
    rows, _ = content(parse.raw_lines(outputs.select("output_id", "raw")))
    return rows.filter("is_match").select("output_id", norm_path(F.col("path")).alias("path"), "number").distinct()
