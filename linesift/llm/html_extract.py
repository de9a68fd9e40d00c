"""Main text of HTML pages by nearest-URL page differencing.

A page is parsed to lines, one a block. Pages of a host are brought in the order of their URL paths, and each is paired
with the nearer of its two neighbours, passing over pages with the same lines. The lines of both are aligned by longest
common subsequence, and shared lines are deleted: what pages of a site repeat is no article. Mark-up guards this: lines
inside an article or main element stay, as pages of one host may well share a paragraph; lines that mark-up names as
menus, headers, footers, sidebars, forms, adverts and the like go even where they differ; and on a page that marks its
article nothing outside it counts.

Range partitioning by (host, path, id) cuts a host of any size. Only hashes of lines are ordered and aligned. Pages at
the edge of a partition get their neighbour from the partition beyond, so the partitioning changes no result.
"""

from __future__ import annotations

import bisect
import html
import re
from collections.abc import Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, row_hash, same_row, stored
from .url_filter import url_parts

# Names of HTML elements, by what they do.
RAW = {"script", "style", "noscript", "template", "textarea", "iframe", "svg", "math", "title", "object", "canvas"}
DROPPED = {"head", "nav", "aside", "footer", "form", "button", "select", "dialog", "menu"}
MAIN = {"article", "main"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CELLS, ROW, PARTS = {"td", "th"}, {"tr"}, {"thead", "tbody", "tfoot"}
#: By the element that starts: which open elements that ends, and within which it doesn't look for them.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dd": ({"dd", "dt"}, {"dl"}), "dt": ({"dd", "dt"}, {"dl"}), "option": ({"option"}, {"select"})}
ENDS |= {x: (CELLS, {"tr", "table"}) for x in CELLS} | {"tr": (CELLS | ROW, {"table"})} | {x: (CELLS | ROW | PARTS, {"table"}) for x in PARTS}
ENDS |= {x: (HEADINGS, BLOCKS - HEADINGS) for x in HEADINGS}
#: What no implied end reaches out of.
CLOSED = {"table", "td", "th", "caption", "button", "object"}
#: Blocks that don't end an open paragraph.
IN_PARAGRAPH = CELLS | ROW | PARTS | {"body", "html", "head", "caption", "option", "legend"}

#: Names, as a class or id or joined to one by words of PLACES, of what is no part of an article; and roles.
CHROME = set(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer ad ads adv advert adverts advertisement advertisements banner sponsor sponsored promo promotion "
    "cookie cookies consent notice gdpr popup modal overlay comment comments disqus share sharing social related recommended newsletter subscribe signup login search pagination pager masthead".split()
)
PLACES = set("bar bottom box block button buttons container form global group holder inner item items left link links list main outer page panel right section site slot top unit widget wrap wrapper".split())
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert", "menu", "menubar"}

# A quote opens a value only after an equals sign; a tag that isn't ended runs to the end of the page.
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""(?<![^\s"'/])([^\s"'>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
PART = re.compile(r"[a-z]+")

PLAIN, NAMED, OWN = 0, 1, 2


def names_chrome(value: str) -> bool:
    """Whether one of the names of a class or id says what is no part of an article: all its words do, or say where it stands."""
    return any(CHROME & words and words <= CHROME | PLACES for words in (set(PART.findall(name)) for name in value.split()))


def is_chrome(attributes: str) -> bool:
    for m in ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), html.unescape((m[2] or "").strip("\"'")).lower()
        if name == "hidden" or name == "role" and ROLES & set(value.split()) or name in ("class", "id") and names_chrome(value):
            return True
    return False


def parse(page: str) -> list[tuple[str, int]]:
    """The page's lines in order, each PLAIN, NAMED (in an element that mark-up names as no article) or OWN (in an article
    or main element and not so named).

    Elements end with an end tag, with a start tag that implies their end, or with the element around them.
    """
    lines: list[tuple[str, int]] = []
    stack: list[tuple[str, bool, bool]] = []  # name, named, main
    text: list[str] = []

    def flush() -> None:
        line = " ".join("".join(text).split())
        text.clear()
        if line:
            _, named, main = stack[-1] if stack else ("", False, False)
            lines.append((line, NAMED if named else OWN if main else PLAIN))

    def end(names: set[str], within: set[str]) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in names:
                del stack[i:]
                return
            if stack[i][0] in within:
                return

    at, size = 0, len(page)
    while at < size:
        m = TAG.search(page, at)
        text.append(html.unescape(page[at : m.start() if m else size]))
        if not m:
            break
        at = m.end()
        name = (m[2] or "").lower()
        if not name:
            continue
        if name in BLOCKS or name in RAW:
            flush()
        elif name == "br":
            text.append(" ")
        if m[1]:
            # An inline end tag doesn't close the blocks that were opened after its start.
            end({name}, CLOSED - {name} if name in BLOCKS else BLOCKS)
        elif name in RAW:
            close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(page, at)
            at = close.end() if close else size
        else:
            if name in ENDS:
                found, within = ENDS[name]
                end(found, within | (CLOSED - found))
            if name in BLOCKS and name not in IN_PARAGRAPH:
                end({"p"}, CLOSED)
            if name not in VOID and not (name not in BLOCKS and m[3].rstrip().endswith("/")):
                _, named, main = stack[-1] if stack else ("", False, False)
                main = main or name in MAIN
                named = named or name in DROPPED or name == "header" and not main or name not in ("html", "body", *MAIN) and is_chrome(m[3])
                stack.append((name, named, main))
    flush()
    return lines


def common(a: list, b: list) -> set[int]:
    """The places in a of one longest common subsequence of a and b (Hunt and Szymanski: time goes with the equal pairs)."""
    start = 0
    while start < min(len(a), len(b)) and a[start] == b[start]:
        start += 1
    stop = 0
    while stop < min(len(a), len(b)) - start and a[-1 - stop] == b[-1 - stop]:
        stop += 1
    where: dict = {}
    for j in range(start, len(b) - stop):
        where.setdefault(b[j], []).append(j)
    ends: list[int] = []
    last: list[tuple] = []
    for i in range(start, len(a) - stop):
        for j in reversed(where.get(a[i], ())):
            k = bisect.bisect_left(ends, j)
            link = (i, last[k - 1] if k else None)
            if k == len(ends):
                ends.append(j)
                last.append(link)
            elif j < ends[k]:
                ends[k], last[k] = j, link
    out, link = {*range(start), *range(len(a) - stop, len(a))}, last[-1] if last else None
    while link:
        out.add(link[0])
        link = link[1]
    return out


def alike(a: str, b: str) -> int:
    n = 0
    for x, y in zip(a, b):
        if x != y:
            break
        n += 1
    return n


def hash_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The hashes of each page's lines."""
    for pdf in batches:
        lines = [[xxhash.xxh3_64_intdigest(x.encode("utf-8", "surrogatepass")) - (1 << 63) for x, _ in parse(page)] if page else [] for page in pdf["html"]]
        yield pdf.drop(columns="html").assign(hashes=lines)


def text_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """own: the text inside a marked article, or null without one; then plain: the other lines that no mark-up rules out, with
    their places among all lines."""
    for pdf in batches:
        out = []
        for page in pdf["html"]:
            lines = parse(page) if page else []
            own = [x for x, mark in lines if mark == OWN]
            plain = [] if own else [(x, i) for i, (x, mark) in enumerate(lines) if mark == PLAIN]
            out.append(("\n\n".join(own) if own else None, [x for x, _ in plain], [i for _, i in plain]))
        yield pdf[["id", "url", "row"]].assign(own=[x[0] for x in out], plain=[x[1] for x in out], places=[x[2] for x in out])


def align_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Which lines a page shares with its nearer neighbour (the one before, if both are as near)."""
    for pdf in batches:
        out = []
        for row in pdf.itertuples(index=False):
            sides = [x for x in ((row.before_path, row.before_id, row.before_hashes), (row.after_path, row.after_id, row.after_hashes)) if x[2] is not None]
            _, neighbour, hashes = max(sides, key=lambda x: alike(x[0], row.path), default=(None, None, []))
            shared = common(list(row.hashes), list(hashes))
            out.append((row.id, row.row, neighbour, [i in shared for i in range(len(row.hashes))]))
        yield pd.DataFrame(out, columns=["id", "row", "neighbour", "shared"]).astype({"id": object, "neighbour": object})


by_value(__name__)

ORDER = ["host", "path", "id", "digest"]


def _beyond(rows: DataFrame, name: str, window: WindowSpec) -> DataFrame:
    """Adds the page before each page's run of equal pages, in the window's order within a part: null where the run meets the part's edge."""
    rows = rows.withColumn("_next", F.lag("page").over(window))
    edge = F.col("_next").isNull() | (F.col("_next.host") != F.col("host")) | (F.col("_next.digest") != F.col("digest"))
    carried = F.last(F.when(edge, F.struct(F.col("_next").alias("x"))), ignorenulls=True).over(window.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, carried["x"]).drop("_next")


def _reach(parts: list[tuple]) -> list[tuple[int, int, bool]]:
    """For parts in an order: where each one's first run finds the page before it, if anywhere.

    parts: number, first run, last run (host and digest), whether one run fills the part. Returns (part, other part,
    whether it is that part's last page; else the page before the last run there).
    """
    out: dict[int, tuple[int, bool]] = {}
    for (p, _, last, filled), (n, first, _, _) in zip(parts, parts[1:]):
        if last != first:
            out[n] = (p, True)
        elif not filled:
            out[n] = (p, False)
        elif p in out:
            out[n] = out[p]
    return [(n, *x) for n, x in out.items()]


def neighbours(pages: DataFrame) -> DataFrame:
    """pages: id, row, host, path, hashes. Adds before and after: the next page of the host on either side whose lines
    differ (id, path, hashes), or null. Pages are ordered by path, id and lines, and
    those that are equal in all of them have the same neighbours.

    The driver sees two runs of each partition, as host and digest.
    """
    page = F.struct("id", "path", "hashes", "host", "digest")
    pages = pages.withColumn("digest", F.xxhash64("hashes", F.size("hashes")))
    rows = stored(pages.repartitionByRange(*ORDER).withColumn("part", F.spark_partition_id()), "ordered").withColumn("page", page)
    forth = Window.partitionBy("part").orderBy(*ORDER)
    back = Window.partitionBy("part").orderBy(*(F.desc(c) for c in ORDER))
    rows = _beyond(_beyond(rows, "before", forth), "after", back)
    place = F.struct(*ORDER)
    ends = rows.groupBy("part").agg(
        F.min_by(F.struct("page", F.col("after").alias("next")), place).alias("first"), F.max_by(F.struct("page", F.col("before").alias("next")), place).alias("last")
    )
    ends = stored(ends, "edges")
    run = lambda c: F.struct(F.col(f"{c}.page.host"), F.col(f"{c}.page.digest"))
    runs = ends.select("part", run("first").alias("first"), run("last").alias("last"), F.col("last.next").isNull().alias("forth"), F.col("first.next").isNull().alias("back"))
    runs = sorted(runs.collect())
    reach = {"before": ("last", _reach([(p, first, last, filled) for p, first, last, filled, _ in runs])), "after": ("first", _reach([(p, last, first, filled) for p, first, last, _, filled in reversed(runs)]))}
    for side, (end, links) in reach.items():
        links = pages.sparkSession.createDataFrame(links, "part int, other int, edge boolean")
        halo = links.join(ends.select(F.col("part").alias("other"), end), "other").select("part", F.when(F.col("edge"), F.col(f"{end}.page")).otherwise(F.col(f"{end}.next")).alias("halo"))
        rows = rows.join(halo.hint("shuffle_hash"), "part", "left").withColumn(side, F.coalesce(side, "halo")).drop("halo")
    own = lambda c, f: F.when(F.col(f"{c}.host") == F.col("host"), F.col(f"{c}.{f}")).alias(f"{c}_{f}")
    return rows.select("id", "row", "path", "hashes", *(own(c, f) for c in ("before", "after") for f in ("id", "path", "hashes")))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per row: the id, url, text (blocks joined by two newlines, empty if none), n_chars (its code points), neighbour (the
    id of the page that it was aligned with) and n_shared (how many of its lines that page shares).

    Null html is empty. A page whose url is null, or has no host, has no neighbour, and neither has one without another
    page of its host whose lines differ. A page of which differencing would leave nothing keeps all that no mark-up
    rules out. Repeated rows stay repeated, with equal results. An empty table gives no rows; of pages only the three
    columns are read.
    """
    bounded_batches(pages.sparkSession)
    kind = pages.schema[id_col].dataType.simpleString()
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("row", row_hash("id", "url", "html"))
    host, path = url_parts(F.col("url"))
    placed = rows.select("id", "row", host.alias("host"), path.alias("path"), "html").filter("host <> ''")
    light = placed.mapInPandas(hash_rows, f"id {kind}, row bigint, host string, path string, hashes array<bigint>")
    aligned = neighbours(light).mapInPandas(align_rows, f"id {kind}, row bigint, neighbour {kind}, shared array<boolean>").dropDuplicates(["id", "row"])
    # Pages are parsed again rather than stored: only what can be text is moved, once.
    texts = rows.mapInPandas(text_rows, f"id {kind}, url string, row bigint, own string, plain array<string>, places array<int>")
    both = same_row(texts, aligned, "left")
    unshared = F.filter("plain", lambda _, i: ~F.coalesce(F.get("shared", F.get("places", i)), F.lit(False)))
    both = both.withColumn("unshared", unshared)
    both = both.withColumn("text", F.coalesce("own", F.array_join(F.when(F.size("unshared") > 0, F.col("unshared")).otherwise(F.col("plain")), "\n\n")))
    return both.select(
        F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"),
        "neighbour", F.coalesce(F.size(F.filter("shared", lambda x: x)), F.lit(0)).cast("bigint").alias("n_shared"),
    )
