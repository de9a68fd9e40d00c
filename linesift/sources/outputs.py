"""Sources of raw output: files, JSON transcripts, task files, and commands; and sinks."""

from __future__ import annotations

import shlex
import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

EVENT = "type string, message struct<role:string,content:string>"


def read_outputs(spark: SparkSession, path: str) -> DataFrame:
    """output_id (the file's path), raw: each file is one output; bytes that are no UTF-8 become replacement marks."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.col("path").alias("output_id"), F.try_validate_utf8("content").alias("raw"), "content").select("output_id", F.coalesce("raw", F.make_valid_utf8("content")).alias("raw"))


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """output_id, seq, path: files that match a glob, without reading them."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path")
    return rows.select(F.lit(path).alias("output_id"), F.xxhash64("path").alias("seq"), "path")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """transcript, seq, type, role, text: plain-text messages; lines that are no JSON are left out."""
    rows = spark.read.text(path).select(F.input_file_name().alias("transcript"), F.monotonically_increasing_id().alias("seq"), "value")
    e = F.from_json("value", "type string, message string")
    rows = rows.withColumn("e", e).filter(F.col("e.type").isNotNull())
    content = F.get_json_object("e.message", "$.content")
    texts = F.filter(F.from_json(content, "array<struct<type:string,text:string>>"), lambda x: x["type"] == "text")
    text = F.when(content.startswith("["), F.array_join(F.transform(texts, lambda x: x["text"]), "\n")).otherwise(content)
    return rows.select("transcript", "seq", F.col("e.type").alias("type"), F.get_json_object("e.message", "$.role").alias("role"), text.alias("text")).filter("text is not null and text <> ''")


def query_of(transcripts: DataFrame) -> DataFrame:
    """transcript, intent (the last user text), subtask (the last assistant text)."""
    last = lambda who: F.max(F.when(F.col("type") == who, F.struct("seq", "text")))
    rows = transcripts.groupBy("transcript").agg(last("user").alias("u"), last("assistant").alias("a"))
    return rows.select("transcript", F.coalesce("u.text", F.lit("")).alias("intent"), F.coalesce("a.text", F.lit("")).alias("subtask"))


def tool_calls(events: DataFrame) -> DataFrame:
    """events: run, seq, line (stream-json of an agent's run). run, id, name, input, result: calls joined to their results by id."""
    block = "struct<type:string,id:string,name:string,input:string,tool_use_id:string,content:string>"
    content = F.from_json(F.get_json_object("line", "$.message.content"), f"array<{block}>")
    rows = events.select("run", "seq", F.explode(content).alias("b"))
    uses = rows.filter("b.type = 'tool_use'").select("run", "seq", "b.id", "b.name", "b.input")
    results = rows.filter("b.type = 'tool_result'").select("run", F.col("b.tool_use_id").alias("id"), F.col("b.content").alias("result"))
    return uses.join(results, ["run", "id"], "left")


def read_tasks(spark: SparkSession, path: str) -> DataFrame:
    """id, repo, intent, subtask and evidence of a task file."""
    rows = spark.read.option("multiLine", "true").json(path)
    return rows.select(F.explode("tasks").alias("t")).select("t.*")


def resolve_refs(rows: DataFrame, tasks: DataFrame) -> DataFrame:
    """rows: ref. Joined to tasks by id; an unknown ref is an error."""
    unknown = rows.join(tasks.select(F.col("id").alias("ref")), "ref", "left_anti")
    checked = rows.join(tasks.withColumnRenamed("id", "ref"), "ref")
    if unknown.limit(1).count():
        raise ValueError(f"unknown ref: {unknown.first()['ref']}")
    return checked


def write_outputs(reduced: DataFrame, path: str) -> None:
    """Texts with their statistics, one JSON object a line."""
    reduced.write.mode("overwrite").json(path)


def shaped(response, text):
    """A tool's JSON response with its text replaced: content, or filenames as a list."""
    as_list = F.to_json(F.struct(F.split(text, "\n").alias("filenames")))
    return F.when(F.get_json_object(response, "$.filenames").isNotNull(), as_list).otherwise(F.to_json(F.struct(text.alias("content"))))


class Command(InputPartition):
    def __init__(self, command: str):
        super().__init__(command)
        self.command = command


class CommandReader(DataSourceReader):
    def __init__(self, options):
        self.commands = [c for c in options.get("commands", "").split("\n") if c.strip()]
        self.timeout, self.cwd = float(options.get("timeout", 20)), options.get("cwd")

    def partitions(self):
        return [Command(c) for c in self.commands]

    def read(self, partition):
        """Runs the command without a shell. Exit codes 0 and 1 are results; a missing program is 127, a timeout null."""
        try:
            run = subprocess.run(shlex.split(partition.command), cwd=self.cwd, capture_output=True, timeout=self.timeout)
            yield partition.command, run.stdout.decode("utf-8", "replace"), run.returncode
        except FileNotFoundError:
            yield partition.command, "", 127
        except subprocess.TimeoutExpired:
            yield partition.command, None, None


class CommandSource(DataSource):
    """spark.read.format("command").option("commands", "...\\n...").load(): output_id, raw, code."""

    @classmethod
    def name(cls) -> str:
        return "command"

    def schema(self) -> str:
        return "output_id string, raw string, code int"

    def reader(self, schema):
        return CommandReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(CommandSource)
