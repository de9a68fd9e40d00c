"""Scalar functions over text and paths, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Starts every line that the engine adds.
TAG = "[linesift]"

# Words that are no terms, and the suffixes that are cut.
STOP_WORDS = (
    "a an and are as at be by can do does find for from how if in into is it its of on or should so that the then this to up use used uses using "
    "when where which who why will with without not some all any fix bug add make get set new file files code line lines function method class"
).split()
SUFFIXES = ("ing", "ed", "es", "s", "e")


def tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the code points, rounded up."""
    return tokens_of(F.char_length(text))


def tokens_of(chars: Column) -> Column:
    return F.floor((chars + 3) / 4).cast("bigint")


def clip(text: Column, limit: int) -> Column:
    return F.when(F.char_length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("…[+"), (F.char_length(text) - limit).cast("string"), F.lit(" chars]")))


def strip(text: Column) -> Column:
    """Without white space at both ends (trim() knows blanks only)."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def norm_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^\./", "")


def group_path(path: Column) -> Column:
    """The spelling by which paths are grouped: slashes, and no leading ./"""
    return F.regexp_replace(F.translate(path, "\\", "/"), r"^(\./+)+", "")


def folder(path: Column) -> Column:
    """The directory of a path without its last slash, '.' if it has none."""
    found = F.regexp_extract(path, r"^(.*)/[^/]*$", 1)
    return F.when(found == "", F.lit(".")).otherwise(found)


def folder_with_separator(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*[/\\])", 1)


def looks_like_path(text: Column) -> Column:
    return ~text.rlike(r"^[ \t]") & text.rlike(r"[/\\.]") & ~strip(text).contains(" ")


def stem(word: Column) -> Column:
    out = F.when(F.lit(False), word)
    for s in SUFFIXES:
        out = out.when(F.endswith(word, F.lit(s)) & (F.char_length(word) >= len(s) + 3), F.substring(word, F.lit(1), F.char_length(word) - len(s)))
    return out.otherwise(word)


def terms(text: Column) -> Column:
    """Search terms: words and the parts of camel-case words, lower-cased, without stop words, stemmed; repeats stay."""
    words = F.regexp_extract_all(text, F.lit(r"[A-Za-z][A-Za-z0-9]*"), F.lit(0))
    pieces = lambda w: F.concat(F.array(w), F.filter(F.regexp_extract_all(w, F.lit(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"), F.lit(0)), lambda p: p != w))
    every = F.transform(F.flatten(F.transform(words, pieces)), F.lower)
    return F.transform(F.filter(every, lambda w: (F.char_length(w) > 1) & ~w.isin(STOP_WORDS)), stem)


def mask_times(text: Column) -> Column:
    """Time stamps as T, so lines that differ in them alone are equal; blank lines become empty."""
    stamp = r"\d{4}-\d\d-\d\d([T ]\d\d:\d\d(:\d\d)?([.,]\d+)?(Z|[+-]\d\d:?\d\d)?)?|\d\d:\d\d:\d\d([.,]\d+)?"
    return F.when(strip(text) == "", F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(text, r"\s+$", ""), stamp, "T"))


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, F.lit(one)).otherwise(F.lit(many)))


def printed(path: Column, number: Column, text: Column, is_match: Column, limit: int = 300) -> Column:
    """A row as search tools print it: path:N:text for a match, path-N-text for context; no path, no prefix."""
    sep = F.when(is_match, F.lit(":")).otherwise(F.lit("-"))
    return F.concat(F.when(path == "", F.lit("")).otherwise(F.concat(path, sep)), number.cast("string"), sep, clip(text, limit))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once a row, however often body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)
