"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the text. A batch is reduced to one row per digest
before anything is joined; a sort-merge anti-join with the index finds the new ones, which are appended. The
index side of each join needs no shuffle. No Python runs on the executors.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucketed import BucketedTable
from .common import join_keys, new_path, stored


class DigestIndex:
    """A bucketed table of the digests seen so far: digest binary, keep_id, group_size, batch.

    path: where the table lies (by default a new folder in the shared folder). An existing one is opened again, with
    the number of buckets that it was made with.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None, id_type: str = "bigint"):
        self.spark, self.path = spark, path or new_path(spark, "digests")
        self.columns, self.buckets = f"digest BINARY, keep_id {id_type}, group_size BIGINT, batch STRING", buckets

    def open(self) -> BucketedTable:
        return BucketedTable(self.spark, self.path, self.columns, "digest", self.buckets)

    def ingest(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Decide about each row of a batch, and append its new digests.

        Returns, per row: the id, keep_id, group_size (rows of the batch that first brought the text), kept and
        text_sha256. Of equal texts in one batch the largest id stays; a text that an earlier batch brought keeps
        that batch's row. Null text counts as empty. A null id stays only if no row of its group has an id. Rows
        that repeat an id and its text are equal in everything, and so are all kept or all dropped. An empty batch
        gives no rows; other columns of the batch are not read. The result is written before this returns, so later
        batches don't change it.
        """
        rows = stored(batch.select(F.col(id_col).alias("id"), F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("digest")), "batch")
        # Written first: an anti-join right above the aggregate would be moved below it, and meet every row.
        groups = stored(rows.groupBy("digest").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")), "groups")
        with self.open() as index:
            fresh = groups.hint("merge").join(index.rows().select("digest"), "digest", "left_anti")
            index.append(fresh.select("digest", "keep_id", "group_size", F.lit(uuid.uuid4().hex).alias("batch")))
            # One row a digest of the batch, with how many rows of the batch have it.
            known = index.rows().select("digest", "keep_id", F.col("group_size").alias("first_size"))
            known = stored(groups.select("digest", F.col("group_size").alias("m")).hint("merge").join(known, "digest"), "known")
        found = join_keys(rows, known, ["digest"], "m", rows.count())
        out = found.select("id", "keep_id", F.col("first_size").alias("group_size"), F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))
        return out.withColumnRenamed("id", id_col)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None) -> DataFrame:
    """DigestIndex.ingest of one batch, into a new index unless one is given."""
    index = index or DigestIndex(docs.sparkSession, id_type=docs.schema[id_col].dataType.simpleString())
    return index.ingest(docs, id_col, text_col)
