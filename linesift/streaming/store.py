"""Session memory as tables of part files: what each session has been shown, edits, and fingerprints of files.

Every write adds part files, and readers take their union, so writers need no lock. Times only ever make a line look
unseen: merged parts keep the oldest time of a line, so an edit that raced the merge still applies.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import memory
from ..operators.read import Reading
from .session import IDLE_MS

#: Characters of an output that its reader sees whole, and of the preview of a longer one.
VISIBLE_CHARS, PREVIEW_CHARS = 30_000, 1_800
#: Part files from which a session's shown lines are merged; nanoseconds for which a file's time may still hide a write.
MOST_PARTS, RACY_NS = 64, 2_000_000_000

SHOWN = "session string, file string, key string, digest string, ns long"
EDITS = "session string, file string, ns long"
FILES = "file string, size long, mtime long, digest string"


def visible_part(text: Column, limit: int = VISIBLE_CHARS) -> Column:
    """All of a text up to limit characters; of a longer one its preview, up to the last whole line."""
    head = F.substring(text, 1, PREVIEW_CHARS)
    return F.when(F.char_length(text) <= limit, text).when(head.contains("\n"), F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise("")


def absolute(path: Column, cwd: Column) -> Column:
    """A path seen from a folder, with . and .. taken out; an empty one stays empty."""
    joined = F.when(path.rlike(r"^(/|[A-Za-z]:[\\/])"), path).otherwise(F.concat_ws("/", cwd, path))
    parts = F.filter(F.split(F.translate(joined, "\\", "/"), "/"), lambda p: (p != "") & (p != "."))
    kept = F.aggregate(parts, F.array().cast("array<string>"), lambda at, p: F.when(p == "..", F.slice(at, F.lit(1), F.greatest(F.size(at) - 1, F.lit(0)))).otherwise(F.concat(at, F.array(p))))
    root = F.when(F.translate(joined, "\\", "/").startswith("/"), "/").otherwise("")
    return F.when(path == "", "").otherwise(F.concat(root, F.array_join(kept, "/")))


def session_key(session: Column, agent: Column) -> Column:
    """Sub-agents see other texts than their session, so each has a memory of its own."""
    return F.when(F.coalesce(agent, F.lit("")) == "", session).otherwise(F.concat_ws("-", session, agent))


class SessionStore:
    """Tables shown, edits and files below a path that driver and executors share. Sessions are partitions, so one session is
    read, merged, cleared or pruned without the others."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _read(self, name: str, schema: str) -> DataFrame:
        """The union of a table's part files; an empty table before the first."""
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        return self.spark.createDataFrame([], schema)

    def _add(self, name: str, rows: DataFrame, schema: str) -> None:
        names = [c.split()[0] for c in schema.split(", ")]
        writer = rows.select(names).write.mode("append")
        (writer.partitionBy("session") if "session" in names else writer).parquet(f"{self.path}/{name}")

    def shown(self) -> DataFrame:
        return self._read("shown", SHOWN)

    def edits(self) -> DataFrame:
        return self._read("edits", EDITS)

    def files(self) -> DataFrame:
        """The last known fingerprint of each file."""
        rows = self._read("files", FILES)
        return rows.groupBy("file").agg(F.max_by(F.struct("size", "mtime", "digest"), F.struct("mtime", "size", "digest")).alias("f")).select("file", "f.*")

    def record_outputs(self, outputs: DataFrame, ns: int) -> None:
        """outputs: session, raw, and cwd perhaps: what was shown now. Only the visible part counts; it is read as content."""
        cwd = F.col("cwd") if "cwd" in outputs.columns else F.lit("")
        rows = outputs.select("session", cwd.alias("cwd"), visible_part(F.coalesce("raw", F.lit(""))).alias("raw")).withColumn("output_id", F.xxhash64("session", "cwd", "raw").cast("string"))
        rows = rows.dropDuplicates(["output_id"])
        read = Reading(rows.select("output_id", "raw"), "content").rows.join(rows.select("output_id", "session", "cwd"), "output_id")
        self.record_lines(read.select("session", absolute(F.col("path"), F.col("cwd")).alias("path"), "number", "text"), ns)

    def record_lines(self, lines: DataFrame, ns: int) -> None:
        """lines: session, path, number, text; shown now, with the fingerprint that their file has by now, if one is known."""
        rows = lines.select("session", F.col("path").alias("file"), memory.line_key("path", "number", "text").alias("key")).distinct()
        self._add("shown", rows.join(self.files().select("file", "digest"), "file", "left").withColumn("ns", F.lit(ns).cast("bigint")), SHOWN)

    def record_keys(self, keys: DataFrame, ns: int) -> None:
        """keys: session, key; tied to no file, so only clearing forgets them."""
        none = F.lit(None).cast("string")
        self._add("shown", keys.select("session", none.alias("file"), "key", none.alias("digest"), F.lit(ns).cast("bigint").alias("ns")), SHOWN)

    def invalidate(self, edits: DataFrame, ns: int) -> None:
        """edits: session, file: the file changed; what was shown of it until now no longer counts."""
        self._add("edits", edits.withColumn("ns", F.lit(ns).cast("bigint")), EDITS)

    def seen(self) -> DataFrame:
        """session, file, key of what still counts: shown after its file's last edit, with the fingerprint that the file has now."""
        now = self.files().select("file", "digest")
        sessions = self.shown().select("session", "file").filter("file is not null").distinct()
        return memory.still_seen(self.shown().filter("key <> ''"), self.edits(), sessions.join(now, "file"))

    def fingerprint(self, folder: str, pattern: str = "*", now_ns: int = 0) -> int:
        """Fingerprint the files of a folder (name and all folders below), and return how many had to be read.

        The hash of a file whose size and time are known is taken from the table, unless that time was so recent when
        it was hashed that a later write may share it.
        """
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(folder)
        light = found.select(F.regexp_replace("path", "^file:/+", "/").alias("file"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime"))
        known = self.files().withColumnsRenamed({"size": "s", "mtime": "m"})
        old = light.join(known, "file").filter((F.col("size") == F.col("s")) & (F.col("mtime") == F.col("m")) & (F.col("mtime") < now_ns - RACY_NS)).select("file")
        fresh = found.withColumn("file", F.regexp_replace("path", "^file:/+", "/")).join(old, "file", "left_anti")
        fresh = fresh.select("file", F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime"), F.sha2("content", 256).alias("digest"))
        count = light.join(old, "file", "left_anti").count()
        if count:
            self._add("files", fresh, FILES)
        return count

    def _replace(self, name: str, rows: DataFrame, schema: str) -> None:
        """Rewrite a table's sessions that rows holds, and no others: rows is written first, then takes their place."""
        path = f"{self.path}/_new-{uuid.uuid4().hex}"
        rows.write.parquet(path)
        names = [c.split()[0] for c in schema.split(", ")]
        kept = self.spark.read.schema(rows.schema).parquet(path).select(names)
        kept.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session").parquet(f"{self.path}/{name}")

    def merge_parts(self, most: int = MOST_PARTS) -> list[str]:
        """Merge the shown lines of sessions with that many part files; returns the sessions.

        A line keeps its oldest time: whatever edit came after any of its writings still hides it.
        """
        rows = self.shown()
        parts = rows.select("session", F.input_file_name().alias("part")).distinct().groupBy("session").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= most)
        sessions = [r["session"] for r in parts.select("session").collect()]  # sessions with many parts, each merged now
        if sessions:
            merged = rows.filter(F.col("session").isin(sessions)).groupBy("session", "file", "key", "digest").agg(F.min("ns").alias("ns")).coalesce(1)
            self._replace("shown", merged, SHOWN)
        return sessions

    def clear(self, sessions: list[str], ns: int) -> None:
        """Forget all that sessions were shown (their context was compacted); an empty key marks that they were. Fingerprints stay:
        they are of files."""
        empty = self.shown().filter(F.col("session").isin(sessions))
        gone = empty.groupBy("session").agg(F.min("key").alias("key")).select("session", F.lit(None).cast("string").alias("file"), F.lit("").alias("key"), F.lit(None).cast("string").alias("digest"), F.lit(ns).cast("bigint").alias("ns"))
        self._replace("shown", gone, SHOWN)

    def prune(self, now_ns: int, idle_ms: int = IDLE_MS) -> list[str]:
        """Forget sessions without a line or edit for so long; returns them."""
        last = self.shown().select("session", "ns").unionByName(self.edits().select("session", "ns")).groupBy("session").agg(F.max("ns").alias("ns"))
        idle = [r["session"] for r in last.filter(F.col("ns") < now_ns - idle_ms * 1_000_000).select("session").collect()]  # idle sessions alone
        if idle:
            self.clear(idle, 0)
        return idle
