"""Session memory in batch: what has been shown already, and what of it still holds.

Every doubt makes a line look unseen; none hides one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .lines import with_blocks


def line_key(path: str, number: str, text: str):
    return F.sha2(F.concat_ws("\0", F.regexp_replace(path, r"^\./", ""), F.col(number).cast("string"), F.coalesce(text, F.lit(""))), 256)


def latest(rows: DataFrame, key: list[str], value: str, ns: str) -> DataFrame:
    """The value of each key with the largest ns (of equals, the largest value)."""
    return rows.groupBy(*key).agg(F.max(F.struct(ns, value)).alias("m")).select(*key, f"m.{value}", f"m.{ns}")


def still_seen(shown: DataFrame, edits: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """shown: session, file, key, digest, ns; edits: session, file, ns. What was shown after its file's last edit.

    A key without a file is tied to none. current (session, file, digest), if given, must hold the digest that was
    shown. Edits and fingerprints are reduced to one row a file before they are joined.
    """
    last = edits.groupBy("session", "file").agg(F.max("ns").alias("edited"))
    rows = shown.join(last, ["session", "file"], "left").filter((F.col("ns") > F.coalesce("edited", F.lit(-1))))
    if current is not None:
        rows = rows.join(current.withColumnRenamed("digest", "now"), ["session", "file"], "left").filter(F.col("file").isNull() | F.col("digest").isNull() | (F.col("digest") == F.col("now")))
    return rows.select("session", "file", "key").distinct()


def unseen(lines: DataFrame, seen: DataFrame, key: list[str]) -> DataFrame:
    return lines.join(seen.select(*key).distinct(), key, "left_anti")


def split_seen(lines: DataFrame) -> DataFrame:
    """lines with seen. Adds kept: unseen rows, and with an unseen context row all rows up to its nearest match in the run.

    Of two matches as near, the earlier counts. Rows without a path are never seen.
    """
    rows = with_blocks(lines.withColumn("seen", F.col("seen") & (F.col("path") != "")))
    run = Window.partitionBy("output_id", "path", "block").orderBy("number")
    at = F.when(F.col("is_match"), F.col("number"))
    rows = rows.withColumn("p", F.last(at, ignorenulls=True).over(run.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("n", F.first(at, ignorenulls=True).over(run.rowsBetween(0, Window.unboundedFollowing)))
    anchor = F.when(F.col("n").isNull() | (F.col("number") - F.col("p") <= F.col("n") - F.col("number")), F.col("p")).otherwise(F.coalesce("n", "p"))
    wants = F.when(~F.col("seen") & ~F.col("is_match"), anchor)
    # A row is kept if some unseen context row and its anchor lie on either side of it: running extremes tell.
    rows = rows.withColumn("w", wants)
    up = F.min(F.when(F.col("w") < F.col("number"), F.col("w"))).over(run.rowsBetween(0, Window.unboundedFollowing))
    down = F.max(F.when(F.col("w") > F.col("number"), F.col("w"))).over(run.rowsBetween(Window.unboundedPreceding, 0))
    kept = ~F.col("seen") | F.coalesce(up <= F.col("number"), F.lit(False)) | F.coalesce(down >= F.col("number"), F.lit(False))
    return rows.withColumn("kept", kept).drop("p", "n", "w", "block")


