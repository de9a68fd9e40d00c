"""A corpus of documents as files of lines, and native grep over it.

Both work inside each document's row: nothing is shuffled, and lines that no search wants are never made rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let

#: More lines than a file has, so seq orders by file, then line.
FILE_LINES = 1_000_000


def split_lines(text: Column) -> Column:
    """The lines of a text; a line break at the end opens no further line."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(F.regexp_replace(text, r"\n\z", ""), "\n", -1))


def files(docs: DataFrame) -> DataFrame:
    """output_id, doc_id, path, lines: documents as files lang/source/doc_id.txt; one search output for each source."""
    return docs.filter(F.col("text").isNotNull()).select(
        F.coalesce("source", F.lit("")).alias("output_id"), "doc_id",
        F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), split_lines(F.col("text")).alias("lines"),
    )


def corpus_lines(docs: DataFrame) -> DataFrame:
    """output_id, seq, path, number (from 1), text."""
    rows = files(docs).select("output_id", "doc_id", "path", F.posexplode("lines").alias("p", "text"))
    return rows.select("output_id", (F.col("doc_id") * FILE_LINES + F.col("p") + 1).alias("seq"), "path", (F.col("p") + 1).cast("bigint").alias("number"), "text")


def grep(docs: DataFrame, pattern: str, before: int = 0, after: int = 0, ignore_case: bool = False) -> DataFrame:
    """Lines that match, with context: output_id, seq, path, number, text, is_match."""
    pattern = ("(?i)" if ignore_case else "") + pattern
    def keep(rows: Column) -> Column:
        if not (before or after):
            return F.filter(rows, lambda x: x["is_match"])
        # A line is context if a match lies up to `after` lines above it, or `before` below.
        first = lambda i: F.greatest(i - after, F.lit(0))
        return F.filter(rows, lambda x, i: F.exists(F.slice(rows, first(i) + 1, i - first(i) + before + 1), lambda y: y["is_match"]))

    marked = F.transform("lines", lambda x, i: F.struct((i + 1).cast("bigint").alias("number"), x.alias("text"), x.rlike(pattern).alias("is_match")))
    rows = files(docs).withColumn("kept", let(marked, keep))
    rows = rows.select("output_id", "doc_id", "path", F.explode("kept").alias("x"))
    return rows.select("output_id", (F.col("doc_id") * FILE_LINES + F.col("x.number")).alias("seq"), "path", "x.number", "x.text", "x.is_match")


def grep_text(docs: DataFrame, pattern: str) -> DataFrame:
    """Multi-line search: output_id, path, hits of a pattern on whole texts, where . matches line breaks."""
    hits = F.regexp_count("text", F.lit("(?s)" + pattern)).cast("bigint")
    rows = docs.filter(F.col("text").isNotNull()).withColumn("hits", hits).filter("hits > 0")
    return rows.select(F.coalesce("source", F.lit("")).alias("output_id"), F.concat_ws("/", "lang", "source", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), "hits")
