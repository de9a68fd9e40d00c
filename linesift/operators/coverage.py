"""The index of every file that a search found."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import plural

# The words that start a definition, those that may stand before them; group 1 is the name.
DEFINERS = "def class func fn function struct enum trait impl interface type module const let var".split()
BEFORE_DEFINERS = "export pub async".split()
DEFINITION = rf"^\s*(?:(?:{'|'.join(BEFORE_DEFINERS)})(?:\([a-z]+\))?\s+)*(?:{'|'.join(DEFINERS)})\b(?:\s*\([^)]*\))?\s*\*?\s*([A-Za-z_]\w*)?"


def file_index(lines: DataFrame, definition: str = DEFINITION) -> DataFrame:
    """output_id, path, matches, first, last, defined: files with matches; defined is the first match that is a definition."""
    rows = lines.filter("is_match").groupBy("output_id", "path")
    return rows.agg(
        F.count(F.lit(1)).alias("matches"), F.min("number").alias("first"), F.max("number").alias("last"),
        F.min(F.when(F.col("text").rlike(definition), F.col("number"))).alias("defined"),
    )


def index_rows(index: DataFrame) -> DataFrame:
    """Adds row: the index line of a file."""
    span = F.when(F.col("first") == F.col("last"), F.concat(F.lit("line "), F.col("first").cast("string"))).otherwise(
        F.concat(F.lit("lines "), F.col("first").cast("string"), F.lit("-"), F.col("last").cast("string"))
    )
    defined = F.when(F.col("defined").isNull(), F.lit("")).otherwise(F.concat(F.lit(", def "), F.col("defined").cast("string")))
    return index.withColumn("row", F.concat(F.col("path"), F.lit(": "), plural(F.col("matches"), "match", "matches"), F.lit(", "), span, defined))
