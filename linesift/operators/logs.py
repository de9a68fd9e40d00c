"""Compaction of test and build logs: lines (output_id, seq, text), where seq counts from 1 in each output.

What tools print is written as examples. A rule adds label: why a line need not be shown, or null. Rules look at
neighbours through windows over one log, all with the same partitioning, so a log is shuffled and sorted once.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import mask_times
from ..sources.shared import stored

def of_log():
    return Window.partitionBy("output_id")



def in_order():
    return of_log().orderBy("seq")


def up_to():
    return in_order().rowsBetween(Window.unboundedPreceding, 0)


# --- what tools print ----------------------------------------------------------------------

#: What the capitalised words of an example stand for. A blank is one or more, "~" an indent or none.
PARTS = {"ANY": r".+", "REST": r".*", "WORD": r"\S+", "NUM": r"[0-9]+", "SIZE": r"[0-9.,]+", "TIME": r"[0-9.]+ ?m?s", "PCT": r"\[\s*[0-9]+%\]", "EQ": r"=+", "US": r"_+", "CAP": r"(\S+)", "TITLE": r"(.+?)", "~": r"\s*", " ": r"\s+"}


def shape(*examples: str) -> str:
    """One regular expression for whole lines like any of the examples."""
    split = re.compile("(" + "|".join(sorted(map(re.escape, PARTS), key=len, reverse=True)) + ")")
    return "^(?:" + "|".join("".join(PARTS.get(x, re.escape(x)) for x in split.split(e)) for e in examples) + ")$"


@dataclass(frozen=True)
class Runner:
    """A test runner's own marks (lines that only it prints), and its lines for tests that passed or were skipped."""

    mark: str
    passing: str


def _good(before: str, after: str = "") -> list[str]:
    return [f"{before}{word}{after}" for word in ("PASSED", "SKIPPED")]


PYTEST_ENDS = ("passed", "failed", "error", "errors", "skipped", "no tests ran")
# The printed forms of each runner.
RUNNERS = {
    "cargo": Runner(shape("test result: ANY"), shape("test ANY ... ok", "test ANY ... ignored", "test ANY ... ignored, ANY")),
    "dotnet": Runner(shape("Passed! - REST", "Failed! - REST", "Passed!  - REST", "Total tests: REST", "~Test Run Successful.REST", "~Test Run Failed.REST"), shape("  Passed ANY", " Passed ANY", " Skipped ANY")),
    "go": Runner(shape("~--- PASS: ANY", "~--- FAIL: ANY", "~--- SKIP: ANY", *(f"{w} WORD {t}REST" for w in ("ok", "FAIL") for t in ("(cached)", "TIME"))), shape("~--- PASS: ANY", "~--- SKIP: ANY", "ok WORD (cached)REST", "ok WORD TIMEREST", "? WORD [no test files]")),
    "pytest": Runner(
        shape("EQ test session starts EQ", *(f"EQ {a}{w}{b} in TIMEREST EQ" for w in PYTEST_ENDS for a in ("", "REST ") for b in ("", ",REST"))),
        shape(*_good("WORD::ANY "), *_good("WORD::ANY ", " PCT"), *_good("WORD::ANY ", " (REST) PCT"), *_good("PCT ", " WORD::ANY"), *_good("[gwNUM] PCT ", " WORD::ANY"), "PASSED WORD::ANY"),
    ),
    "js": Runner(shape("Tests: NUMREST", "Test Suites: NUMREST", "~Test Files NUMREST", " NUM passing (REST"), shape(*(f"~{sign} REST" for sign in "✓✔√↓○"))),
}
PROGRESS = {
    "cargo progress lines": shape(*(f" {verb} WORD {v}NUMREST" for verb in "Compiling Checking Downloaded Downloading Fresh Locking Adding Updating Documenting Installing Installed Unpacking".split() for v in ("", "v"))),
    "pip progress lines": shape(
        "~Requirement already satisfied: ANY", *(f"~{verb} WORDREST" for verb in ("Collecting", "Downloading", "Obtaining", "Using cached")),
        *(f"~{start}REST" for start in ("Building wheel", "Created wheel", "Stored in directory:", "Preparing metadata", "Getting requirements", "Installing build dependencies", "━")),
    ),
    "maven progress lines": shape(*(f"{info}Download{end} from WORD: REST" for info in ("", "[INFO] ") for end in ("ing", "ed"))),
    "gradle progress lines": shape("> Task :WORD", *(f"> Task :WORD {state}" for state in ("UP-TO-DATE", "NO-SOURCE", "FROM-CACHE", "SKIPPED"))),
    "bundle asset lines": shape(*(f"WORD SIZE {unit}{end}" for unit in ("B", "kB") for end in ("", " │ REST")), *(f"asset WORD SIZE {unit} REST" for unit in ("bytes", "KiB", "MiB"))),
    "dotnet build progress lines": shape(" Determining projects to restoreREST", " All projects are up-to-dateREST", " Restored ANY", " WORD -> WORD.dll", " WORD -> WORD.exe"),
}
GO_HEADER = shape(*(f"~=== {word} REST" for word in ("RUN", "PAUSE", "CONT", "NAME")))
SUREFIRE = [info + "Tests run: NUM, Failures: {f}, Errors: {f}, Skipped: NUM" for info in ("", "[INFO] ")]
SUREFIRE_MARK = shape(*(s.format(f="NUM") + end for s in SUREFIRE for end in ("", ", Time elapsed: REST")))
SUREFIRE_PASS = shape(*(s.format(f="0") + ", Time elapsed: REST - in WORD" for s in SUREFIRE))
SUREFIRE_RUNNING = shape("Running WORD", "[INFO] Running WORD")
#: Coverage tables: the head, a fully covered row, the total row.
TABLES = [(shape("~File~|~% Stmts~|REST"), r"^[^|]*\S[^|]*(\|\s*100\s*){4}\|\s*\|?\s*$", shape("~All filesREST")), (shape("Name Stmts MissREST"), r"^\S+(\s+[0-9]+)+\s+100%\s*$", shape("TOTALREST"))]
SECTION, TEST_HEADER = shape("EQ TITLE EQ"), shape("US ANY US")
SUITE = shape("~PASS WORDREST", "~FAIL WORDREST")
TROUBLE = "(?i)(" + "|".join(("error", "fail", "exception", "traceback", "panic", "warn", "assert")) + ")"

PASSING, PASSING_OUTPUT, PASSING_SUITE = "passing/skipped test lines", "passing test output lines", "passing suite lines"
ALL_PASS, LISTED, REPEATED_FAILURE, COVERED = "all-pass progress lines", "progress lines (failures listed in the summary)", "failure lines repeated in the summary", "fully covered coverage rows"
DUPLICATE, REPEATED, WARNINGS, SIMILAR = "duplicate diagnostic lines", "repeated diagnostic lines", "repeated warning lines", "similar repeated lines"


def text() -> Column:
    return F.col("text")


def like(pattern: str) -> Column:
    return text().rlike(pattern)


def has(pattern: str) -> Column:
    """Whether any line of the log is like that."""
    return F.bool_or(like(pattern)).over(of_log())


def title() -> Column:
    """The name of a section's header line, null elsewhere."""
    return F.when(like(SECTION), F.trim(F.regexp_extract("text", SECTION, 1)))


def labelled(lines: DataFrame, when: Column, label: str) -> DataFrame:
    return lines.withColumn("label", F.when(when, F.lit(label)))


# --- tests ---------------------------------------------------------------------------------


def drop_passing(lines: DataFrame, runner: str) -> DataFrame:
    """Passing lines of logs that show the runner's mark."""
    r = RUNNERS[runner]
    return labelled(lines, has(r.mark) & like(r.passing), PASSING)


def drop_progress(lines: DataFrame, families=PROGRESS, least: int = 10) -> DataFrame:
    """Progress lines of the first family that has at least so many lines in the log."""
    enough = lambda p: (F.count_if(like(p)).over(of_log()) >= least) & like(p)
    return lines.withColumn("label", F.coalesce(*(F.when(enough(p), F.lit(name)) for name, p in families.items())))


def with_section(lines: DataFrame) -> DataFrame:
    """Adds section: the name of the last header line up to here ('' before the first)."""
    return lines.withColumn("section", F.coalesce(F.last(title(), ignorenulls=True).over(up_to()), F.lit("")))


def drop_groups(lines: DataFrame, inside: Column, opens: Column, outer: Column, label: str) -> DataFrame:
    """Groups of lines inside, each from a line that opens it on: lines that mention trouble stay, with their group's opening
    line, and with that of an outer group if any inner one keeps a line."""
    rows = lines.withColumns({"inside": inside, "opens": inside & opens})
    rows = rows.withColumns({"outer": rows["opens"] & outer, "trouble": rows["inside"] & ~rows["opens"] & like(TROUBLE), "group": F.count_if("opens").over(up_to())})
    own, any_ = F.bool_or("trouble").over(Window.partitionBy("output_id", "group")), F.bool_or("trouble").over(of_log())
    rows = rows.withColumns({"own": own, "any": any_})
    stays = F.col("trouble") | F.col("opens") & (F.col("own") | F.col("outer") & F.col("any"))
    return rows.withColumn("label", F.when(F.col("inside") & ~stays, F.lit(label))).select(*lines.columns, "label")


def drop_passes_section(lines: DataFrame) -> DataFrame:
    """The captured output of passing tests."""
    rows = with_section(lines)
    return drop_groups(rows, F.col("section") == "PASSES", like(SECTION) | like(TEST_HEADER), like(SECTION), PASSING_OUTPUT).select(*lines.columns, "label")


def drop_go_headers(lines: DataFrame) -> DataFrame:
    """Passing lines of go test, and test headers that nothing but another header or a result follows."""
    go = RUNNERS["go"]
    after = F.coalesce(F.lead("text").over(in_order()), F.lit(""))
    rows = lines.withColumn("after", after)
    empty = like(GO_HEADER) & (F.col("after").rlike(GO_HEADER) | F.col("after").rlike(go.passing) | F.col("after").rlike(go.mark))
    return labelled(rows, has(go.mark) & (like(go.passing) | empty), PASSING).drop("after")


def drop_surefire(lines: DataFrame) -> DataFrame:
    """Passing classes of surefire, each with the Running line just before it."""
    last = lambda c: F.element_at(F.split(c, r"\s+"), -1)
    rows = lines.withColumn("after", F.coalesce(F.lead("text").over(in_order()), F.lit("")))
    starts = like(SUREFIRE_RUNNING) & F.col("after").rlike(SUREFIRE_PASS) & (last(text()) == last(F.col("after")))
    return labelled(rows, has(SUREFIRE_MARK) & (like(SUREFIRE_PASS) | starts), PASSING).drop("after")


def drop_covered(lines: DataFrame) -> DataFrame:
    """Rows of fully covered files in coverage tables, never the totals."""
    full = [has(head) & like(row) & ~like(total) for head, row, total in TABLES]
    return labelled(lines, full[0] | full[1], COVERED)


DOTS = r"^(?:\S+\.py )?([.sxXFE]+)(?:\s+\[\s*[0-9]+%\])?$"


def drop_test_progress(lines: DataFrame) -> DataFrame:
    """pytest's progress lines: those without a failure, and all of them if the summary lists every failure and error that
    their letters count."""
    rows = with_section(lines).withColumn("letters", F.when((F.col("section") == "test session starts") & like(DOTS) & (F.trim("text") != ""), F.regexp_extract("text", DOTS, 1)))
    count = lambda c: F.coalesce(F.sum(F.char_length(F.regexp_replace("letters", f"[^{c}]", ""))).over(of_log()), F.lit(0))
    listed = lambda w: F.count_if((F.col("section") == "short test summary info") & like(shape(f"{w} WORD::REST"))).over(of_log())
    rows = rows.withColumns({"f": count("F"), "e": count("E"), "failed": listed("FAILED"), "error": listed("ERROR")})
    told = (F.col("f") + F.col("e") > 0) & (F.col("f") == F.col("failed")) & (F.col("e") == F.col("error"))
    clean = has(RUNNERS["pytest"].mark) & ~F.col("letters").rlike("[XFE]")
    label = F.when(F.col("letters").isNotNull(), F.when(clean, ALL_PASS).when(told, LISTED))
    return rows.withColumn("label", label).select(*lines.columns, "label")


def failing_progress(lines: DataFrame) -> DataFrame:
    """The progress lines that go as the summary lists their failures."""
    rows = drop_test_progress(lines)
    return rows.withColumn("label", F.when(F.col("label") == LISTED, F.col("label")))


def with_suite(lines: DataFrame) -> DataFrame:
    """Adds suite (seq of the PASS or FAIL header that a line stands under, null outside), passed, and is_head.

    A suite ends at the next header, or before a line that is indented no deeper than its header.
    """
    indent = F.char_length("text") - F.char_length(F.ltrim("text"))
    head = F.when(like(SUITE), F.struct("seq", indent.alias("indent"), F.ltrim("text").startswith("PASS").alias("passed")))
    rows = lines.withColumns({"is_head": like(SUITE), "indent": indent, "head": F.last(head, ignorenulls=True).over(up_to())})
    ends = ~F.col("is_head") & (F.trim("text") != "") & (F.col("indent") <= F.col("head.indent"))
    ended = F.bool_or(F.coalesce(ends, F.lit(False))).over(Window.partitionBy("output_id", "head.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("ended", ended)
    inside = F.col("head").isNotNull() & ~F.col("ended")
    return rows.select(*lines.columns, "is_head", F.when(inside, F.col("head.seq")).alias("suite"), (inside & F.col("head.passed")).alias("passed"))


def drop_suites(lines: DataFrame) -> DataFrame:
    """What passing suites of jest and the like print, with their headers, in logs that show such a runner's mark; and their
    passing tests anywhere."""
    js = RUNNERS["js"]
    rows = with_suite(lines).withColumn("on", has(js.mark))
    passed = F.col("on") & F.coalesce("passed", F.lit(False)) & ~like(js.passing)
    rows = drop_groups(rows, passed, F.col("is_head"), F.lit(False), PASSING_SUITE)
    return rows.withColumn("label", F.when(F.col("on") & like(js.passing), F.lit(PASSING)).otherwise(F.col("label"))).select(*lines.columns, "label")


SUMMARY, SUMMARY_END = "Summary of all failing tests", "Test Suites:"


def drop_summary_repeats(lines: DataFrame) -> DataFrame:
    """Failures in jest's closing summary that stand above word for word: their lines below the header.

    Blocks are compared by equal headers; each block is gathered as an array of its own lines.
    """
    start = F.min(F.when(text() == SUMMARY, F.col("seq"))).over(of_log())
    rows = lines.withColumn("start", start).filter("start is not null")
    end = F.min(F.when((F.col("seq") > F.col("start")) & text().startswith(SUMMARY_END), F.col("seq"))).over(of_log())
    rows = rows.withColumn("end", end).filter("end is null or seq < end")
    head = F.when(like(SUITE), F.struct("seq", text().alias("text")))
    rows = rows.withColumn("head", F.last(head, ignorenulls=True).over(up_to())).filter("head is not null and head.seq < seq")
    late = F.col("head.seq") > F.col("start")
    rows = rows.filter(late | (F.col("seq") < F.col("start")))
    blocks = rows.groupBy("output_id", F.col("head.seq").alias("at"), F.col("head.text").alias("head"), late.alias("late")).agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("body"))
    filled = F.aggregate(F.transform("body", lambda x, i: F.when(F.trim(x["text"]) != "", i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
    blocks = blocks.withColumn("body", F.slice("body", F.lit(1), filled)).filter(F.size("body") > 0)
    said = F.transform("body", lambda x: x["text"])
    above = blocks.filter("not late").select("output_id", "head", said.alias("above"))
    below = blocks.filter("late").select("output_id", "head", "at", "body", said.alias("said"))
    same = below.join(above, ["output_id", "head"]).filter(F.slice("above", F.lit(1), F.size("said")) == F.col("said"))
    gone = same.select("output_id", F.explode(F.transform("body", lambda x: x["seq"])).alias("seq")).distinct()
    return lines.join(gone.withColumn("label", F.lit(REPEATED_FAILURE)), ["output_id", "seq"], "left").select(*lines.columns, "label")


# --- repeats -------------------------------------------------------------------------------


def repeat_runs(lines: DataFrame, least: int = 5) -> DataFrame:
    """Adds run_size and run_place: each line's run of neighbours (consecutive seq) that differ in time stamps alone.

    What is shown of a run of at least `least` lines: its first, a marker, its last.
    """
    rows = lines.withColumn("key", mask_times(text()))
    same = (F.lag("key").over(in_order()) == F.col("key")) & (F.col("key") != "") & (F.lag("seq").over(in_order()) == F.col("seq") - 1)
    rows = rows.withColumn("run", F.sum(F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1)).over(up_to()))
    run = Window.partitionBy("output_id", "run")
    rows = rows.withColumns({"run_size": F.count(F.lit(1)).over(run), "run_place": F.row_number().over(run.orderBy("seq")).cast("bigint")})
    hidden = (F.col("run_size") >= least) & (F.col("run_place") > 1) & (F.col("run_place") < F.col("run_size"))
    return labelled(rows, hidden, SIMILAR).drop("key", "run")


def counters(rows: DataFrame) -> DataFrame:
    """output_id, label, n, first: what was dropped."""
    return rows.filter("label is not null").groupBy("output_id", "label").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))


# --- diagnostics ---------------------------------------------------------------------------

SEVERITIES = ("fatal error", "error", "warning", "info", "information", "message", "note", "hint", "remark")
SAYS = "(?:" + "|".join(SEVERITIES) + r")\b.*"
FILE, CODE = r"([^\s:(][^:(]*?)", r"[A-Z]{1,5}[0-9]{2,5}\b.*"
#: Heads of compiler messages by style, as (how it is printed, what follows it): file, position, message.
STYLES = {
    "dash": (rf"^\s*{FILE}:([0-9]+:[0-9]+) - ({SAYS})$", "frame"),
    "paren": (rf"^\s*{FILE}\(([0-9]+(?:,[0-9]+){{0,3}})\)\s?:\s*({SAYS})$", "alone"),
    "colon": (rf"^\s*{FILE}:([0-9]+(?::[0-9]+)?):\s?({SAYS}|{CODE})$", "lines"),
    "go": (r"^\s*([^\s:(][^:(]*?\.go):([0-9]+(?::[0-9]+)?):\s?(\S.*)$", "lines"),
}
RUST_HEAD, RUST_PLACE = r"^(?:error|warning)(?:\[\w+\])?: \S.*$", rf"^\s*--> {FILE}:([0-9]+:[0-9]+)$"
ESLINT = r"^\s+([0-9]+:[0-9]+)\s+((?:error|warning)\s+\S.*)$"
OWNER = shape("# WORD", *(f"WORDREST: {where}REST:" for where in ("In function", "In member function", "In constructor", "In destructor", "At top level", "In instantiation of")))
GUTTER, QUOTED = r"^\s*[0-9]*\s*\|", r"^(\s*[0-9]+\s*\||[0-9]+ )"
COLUMN_MARKS = r"[~^]+|-{2,}\^?"


def heads(lines: DataFrame) -> DataFrame:
    """Adds path, pos, message, style of lines that are heads of diagnostics (null elsewhere), and owner: the line above that a
    gcc or go message, or an eslint row, belongs to (seq)."""
    after = F.coalesce(F.lead("text").over(in_order()), F.lit(""))
    rows = lines.withColumn("after", after)
    rows = rows.withColumn("rust", like(RUST_HEAD) & F.col("after").rlike(RUST_PLACE))
    title_ = F.col("after").rlike(ESLINT) & (F.trim("text") != "") & ~like(r"^\s")
    opened = F.when(title_, F.struct("seq", text().alias("text"), F.lit(True).alias("rows"))).when(like(OWNER), F.struct("seq", text().alias("text"), F.lit(False).alias("rows"))).when(
        ~like(r"^\s") & ~_any_head() & ~F.col("rust") | (F.trim("text") == ""), F.struct("seq", F.lit(None).cast("string").alias("text"), F.lit(False).alias("rows")))
    rows = rows.withColumn("above", F.last(opened, ignorenulls=True).over(up_to()))
    row = like(ESLINT) & F.coalesce("above.rows", F.lit(False)) & F.col("above.text").isNotNull()

    def field(k: int, own: Column, placed: Column) -> Column:
        out = F.when(row, own).when(F.col("rust"), placed)
        for p, _ in STYLES.values():
            out = out.when(like(p), F.regexp_extract("text", p, k))
        return out

    place = lambda k: F.regexp_extract("after", RUST_PLACE, k)
    message = field(3, F.regexp_replace(F.trim(F.regexp_extract("text", ESLINT, 2)), r"\s{2,}", "  "), text())
    style = F.when(row, "alone").when(F.col("rust"), "frame")
    for name, (p, follows) in STYLES.items():
        typed = F.when(F.regexp_extract("text", p, 3).rlike(r"^(error|warning) TS[0-9]+:"), "lines").otherwise(follows) if name == "paren" else F.lit(follows)
        style = style.when(like(p), typed)
    rows = rows.withColumns({"path": field(1, F.trim("above.text"), place(1)), "pos": field(2, F.regexp_extract("text", ESLINT, 1), place(2)), "message": message, "style": style})
    known = F.col("path").rlike(r"[\\/]|\.[A-Za-z]\w*$")
    only = lambda c: F.when(known, F.col(c)).alias(c)
    return rows.select(*lines.columns, *map(only, ("path", "pos", "message", "style")), F.when(known & F.col("above.text").isNotNull(), F.col("above.seq")).alias("owner"))


def _any_head() -> Column:
    out = F.lit(False)
    for p, _ in STYLES.values():
        out = out | like(p)
    return out


def diagnostics(lines: DataFrame) -> DataFrame:
    """output_id, seq, text, path, pos, message: the lines that are heads of diagnostics."""
    return heads(lines).filter("path is not null").select("output_id", "seq", "text", "path", "pos", "message")


def records(lines: DataFrame) -> DataFrame:
    """output_id, seq, text, path, pos, message, key, last, chars, owner: each diagnostic with the lines that go on with it.

    A code frame goes on over indented lines, lines with a gutter, and a blank line before more of them; other styles
    over indented lines and gutters, paren styles not at all. Notes go on with what they are about. key tells messages
    apart: the message, and what its further lines say besides quoted source and column marks. last is the last line's
    seq, with a blank one after several.
    """
    rows = heads(lines.withColumn("text", F.regexp_replace("text", "\x1b\\[[0-9;]*[A-Za-z]", "")))
    note = F.col("message").startswith("note")
    rows = rows.withColumns({"is_head": F.col("path").isNotNull() & ~F.coalesce(note, F.lit(False)), "note": F.coalesce(note, F.lit(False))})
    follows = (like(r"^\s+\S") | like(GUTTER) | F.col("note")) & ~F.col("is_head") & ~like(RUST_HEAD)
    frame_line = follows | like(r"^[0-9]+ ") & F.coalesce(F.lead("text").over(in_order()).rlike(r"^\s"), F.lit(False))
    rows = rows.withColumns({"follows": follows, "frame_line": frame_line, "blank": F.trim("text") == ""})
    rows = rows.withColumn("head", F.last(F.when(F.col("is_head"), F.struct("seq", "style")), ignorenulls=True).over(up_to())).filter("head is not null")
    nxt = F.coalesce(F.lead("frame_line").over(Window.partitionBy("output_id", "head.seq").orderBy("seq")), F.lit(False))
    goes_on = F.col("is_head") | F.when(F.col("head.style") == "frame", F.col("frame_line") | F.col("blank") & nxt).when(F.col("head.style") == "lines", F.col("follows")).otherwise(False)
    rows = rows.withColumn("goes_on", goes_on)
    held = F.bool_and("goes_on").over(Window.partitionBy("output_id", "head.seq").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    after = F.lag("held").over(Window.partitionBy("output_id", "head.seq").orderBy("seq"))
    rows = rows.withColumn("held", held).withColumn("tail", ~F.col("held") & F.coalesce(after, F.lit(False)) & F.col("blank"))
    rows = rows.filter("held or tail")
    shown = F.trim(F.regexp_replace(F.regexp_replace("text", GUTTER, ""), COLUMN_MARKS, "^"))
    said = F.when(F.col("held") & ~F.col("is_head") & ~like(QUOTED) & ~like(RUST_PLACE) & ~shown.rlike(r"^[\^|\s-]*$"), F.struct("seq", shown.alias("said")))
    of = rows.groupBy("output_id", F.col("head.seq").alias("first")).agg(
        F.max(F.when(F.col("is_head"), F.struct("text", "path", "pos", "message", "owner"))).alias("h"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n").alias("more"),
        F.max(F.when(F.col("held"), F.col("seq"))).alias("end"), F.max("seq").alias("tail"), F.sum(F.when(F.col("held"), F.char_length("text") + 1)).alias("chars"),
    )
    last = F.when(F.col("end") > F.col("first"), F.col("tail")).otherwise(F.col("end"))
    return of.select("output_id", F.col("first").alias("seq"), "h.text", "h.path", "h.pos", "h.message", F.concat_ws("\n", "h.message", "more").alias("key"), last.alias("last"), "end", "chars", "h.owner")


def groups(found: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """found: output_id, seq, text, path, pos, message, and key, chars if messages go on. Returns the first record of each
    (path, pos, key), and the groups that are worth a note: output_id, key, lead, places.

    A message is grouped only if the list of its other places is shorter than their lines. All sums are of the first
    records; nothing is gathered.
    """
    if "key" not in found.columns:
        found = found.withColumns({"key": F.col("message"), "chars": F.char_length("text") + 1})
    first = stored(found.groupBy("output_id", "path", "pos", "key").agg(F.min("seq").alias("first"), F.min_by("chars", "seq").alias("chars"), F.min("message").alias("message")), "first")
    per_path = first.groupBy("output_id", "key", "path").agg(F.min("first").alias("lead"), F.count(F.lit(1)).alias("n"), F.sum("chars").alias("chars"), F.sum(F.char_length("pos") + 1).alias("pos_chars"), F.min("message").alias("message"))
    sums = per_path.groupBy("output_id", "key").agg(F.min("lead").alias("lead"), F.sum("n").alias("places"), F.sum("chars").alias("chars"), (F.sum("pos_chars") + F.sum(F.char_length("path") + 2)).alias("list"), F.min("message").alias("message"))
    return first, sums.filter((F.col("places") >= least) & (F.col("list") + F.char_length("message") + 60 < F.col("chars"))).select("output_id", "key", "lead", "places")


def diagnostic_labels(found: DataFrame, least: int = 3) -> DataFrame:
    """Adds label: exact duplicates (path, position, message), and repeats of a message at `least` places or more, but for the
    first place; and lead, places of the group."""
    if "key" not in found.columns:
        found = found.withColumns({"key": F.col("message"), "chars": F.char_length("text") + 1})
    first, grouped = groups(found, least)
    rows = found.join(first.drop("chars", "message"), ["output_id", "path", "pos", "key"]).join(grouped, ["output_id", "key"], "left")
    label = F.when(F.col("seq") != F.col("first"), F.lit(DUPLICATE)).when(F.col("lead").isNotNull() & (F.col("seq") != F.col("lead")), F.lit(REPEATED))
    return rows.withColumn("label", label)


def places(found: DataFrame, least: int = 3) -> DataFrame:
    """output_id, message, key, lead, places, base, listed: where each repeated message stands besides its first place, by path in
    order of appearance. base: the directory that all paths share, if it is long; listed is the text of one note."""
    first, grouped = groups(found, least)
    rows = first.join(grouped.drop("places"), ["output_id", "key"]).filter("first <> lead")
    per_path = rows.groupBy("output_id", "key", "lead", "message", "path").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", "pos"))), lambda x: x["pos"]), " ").alias("at"))
    ends = per_path.groupBy("output_id", "key").agg(F.min("path").alias("a"), F.max("path").alias("b"), F.count(F.lit(1)).alias("paths"))
    common = shared_folder(F.col("a"), F.col("b"))
    ends = ends.select("output_id", "key", F.when((F.col("paths") > 1) & (F.char_length(common) > 12), common).otherwise("").alias("base"))
    listed = F.concat_ws(" ", F.expr("substring(path, char_length(base) + 1)"), "at")
    of = per_path.join(ends, ["output_id", "key"]).groupBy("output_id", "key", "lead", "message", "base")
    return of.agg(F.sum("n").alias("places"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", listed.alias("t")))), lambda x: x["t"]), "; ").alias("listed"))


def shared_folder(a: Column, b: Column) -> Column:
    """The folders, with the last separator, that the first and the last of some sorted paths (and so all of them) start with."""
    folders = lambda p: F.filter(F.transform(F.sequence(F.lit(1), F.char_length(p)), lambda i: F.when(F.substring(p, i, F.lit(1)).isin("/", "\\"), F.substring(p, F.lit(1), i))), lambda x: x.isNotNull())
    return F.coalesce(F.element_at(F.array_union(F.array(F.lit("")), F.array_sort(F.array_intersect(folders(a), folders(b)))), -1), F.lit(""))


# --- pytest's warnings ---------------------------------------------------------------------


def warning_blocks(lines: DataFrame) -> DataFrame:
    """output_id, first, last, tests, path, line, message, source: the blocks of pytest's warnings summary.

    A block is test ids at the margin, then an indented place and message, then one line of source. A log whose
    section holds anything else has no blocks.
    """
    rows = with_section(lines)
    inside = F.col("section").contains("warnings summary") & ~like(SECTION)
    docs = F.bool_or(inside & text().startswith("-- Docs: ")).over(up_to())
    rows = rows.withColumns({"inside": inside, "docs": docs}).filter("inside and not docs")
    shape_ = F.when(F.trim("text") == "", "b").when(~like(r"^\s"), "t").when(like(r"^  \S.*?:[0-9]+: \w*Warning\b.*$"), "w").otherwise("s")
    rows = rows.withColumn("shape", shape_)
    before = F.coalesce(F.lag("shape").over(in_order()), F.lit("b"))
    rows = rows.withColumn("opens", (F.col("shape") == "t") & (before != "t")).withColumn("block", F.count_if("opens").over(up_to()))
    place = r"^  (\S.*?):([0-9]+): (\w*Warning\b.*)$"
    pick = lambda s: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shape") == s, F.struct("seq", "text")))), lambda x: x["text"]), "\n")
    blocks = rows.groupBy("output_id", "block").agg(
        F.min(F.when(F.col("shape") != "b", F.col("seq"))).alias("first"), F.max(F.when(F.col("shape") != "b", F.col("seq"))).alias("end"), F.max("seq").alias("last"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "shape"))), lambda x: x["shape"]), "").alias("shape"), pick("t").alias("tests"), pick("w").alias("place"), pick("s").alias("source"),
    )
    blocks = blocks.filter("shape not rlike '^b*$'")
    good = F.bool_and(F.col("shape").rlike("^t+ws+b*$")).over(of_log())
    part = lambda i: F.regexp_extract("place", place, i)
    return blocks.withColumn("good", good).filter("good").select("output_id", "first", "end", "last", "tests", part(1).alias("path"), part(2).alias("line"), part(3).alias("message"), "source")


def warning_notes(lines: DataFrame, least: int = 3) -> tuple[DataFrame, DataFrame]:
    """(output_id, seq, label: lines of repeated warnings; output_id, seq, message, places, base, listed: a note after the first)."""
    blocks = warning_blocks(lines)
    chars = F.char_length("tests") + F.char_length("path") + F.char_length("line") + F.char_length("message") + F.char_length("source") + 12
    simple = ~F.col("source").contains("\n")
    of = blocks.groupBy("output_id", "message").agg(F.count(F.lit(1)).alias("n"), F.min_by("end", "first").alias("lead_end"), F.min("first").alias("lead"), F.bool_and(simple).alias("simple"))
    rest = blocks.join(of.filter((F.col("n") >= least) & F.col("simple")), ["output_id", "message"]).filter("first <> lead")
    ends = rest.groupBy("output_id", "message").agg(F.min("path").alias("a"), F.max("path").alias("b"))
    ends = ends.select("output_id", "message", F.when(F.col("a") != F.col("b"), shared_folder(F.col("a"), F.col("b"))).otherwise("").alias("base"))
    rest = rest.join(ends, ["output_id", "message"])
    own = F.transform(F.split("tests", "\n"), lambda t: F.when(F.concat(F.lit("/"), F.col("path")).endswith(F.concat(F.lit("/"), F.split(t, "::")[0])) & t.contains("::"), F.regexp_replace(t, "^[^:]*(?=::)", "")).otherwise(t))
    row = F.concat(F.lit("  "), F.expr("substring(path, char_length(base) + 1)"), F.lit(":"), F.col("line"), F.lit(" "), F.array_join(own, " "), F.lit(" | "), F.trim("source"))
    notes = rest.groupBy("output_id", "message", "base", "lead_end").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first", row.alias("t")))), lambda x: x["t"]), "\n").alias("listed"), F.count(F.lit(1)).alias("places"), F.sum(chars).alias("chars"))
    notes = notes.filter(F.char_length("listed") + F.char_length("message") + F.char_length("base") + 90 < F.col("chars"))
    gone = rest.join(notes.select("output_id", "message"), ["output_id", "message"], "left_semi")
    gone = gone.select("output_id", F.explode(F.sequence("first", "last")).alias("seq"), F.lit(WARNINGS).alias("label"))
    return gone, notes.select("output_id", F.col("lead_end").alias("seq"), "message", "places", "base", "listed")
