"""Tables that are bucketed and sorted by one column, kept at a path and opened again by later sessions."""

from __future__ import annotations

import uuid
from types import TracebackType

from pyspark.sql import DataFrame, SparkSession

from .common import read_if_there


class BucketedTable:
    """An append-only table at a path; joins on its key need no shuffle of it.

    The number of buckets is written beside the rows (below _layout) when the table is made, and is taken from there
    whenever it is opened again, whatever buckets or spark.sql.shuffle.partitions say by then. The catalog knows the
    table only while it is open: close() takes its name out, and leaves the files.
    """

    def __init__(self, spark: SparkSession, path: str, columns: str, key: str, buckets: int | None = None):
        self.spark, self.path, self.key = spark, path, key
        layout = read_if_there(spark, f"{path}/_layout", "buckets int")
        if layout is None:
            self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
            spark.createDataFrame([(self.buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/_layout")
        else:
            self.buckets = layout.first()[0]
        self.name = f"bucketed_{uuid.uuid4().hex}"
        spark.sql(f"CREATE TABLE {self.name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({key}) INTO {self.buckets} BUCKETS LOCATION '{path}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def append(self, rows: DataFrame) -> None:
        rows = rows.repartition(self.buckets, self.key).sortWithinPartitions(self.key)
        rows.write.mode("append").format("parquet").bucketBy(self.buckets, self.key).sortBy(self.key).option("path", self.path).saveAsTable(self.name)

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def __enter__(self) -> BucketedTable:
        return self

    def __exit__(self, kind: type[BaseException] | None, error: BaseException | None, trace: TracebackType | None) -> None:
        self.close()
