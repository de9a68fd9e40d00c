"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: str | None = None


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. A local run without it takes a temporary folder; on a cluster that is an error, as each executor would write to its own disk."""
    global _own
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        _own = _own or tempfile.mkdtemp(prefix="linesift-")
        folder = f"file://{_own}"
    return folder.rstrip("/")


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Write df and read it back: cuts the lineage, and survives the loss of executors."""
    path = f"{shared_dir(df.sparkSession)}/linesift/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
