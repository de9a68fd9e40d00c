"""A corpus pipeline: each stage takes the documents that the stage before it kept.

Language ID, exact dedup, near dedup and decontamination return the columns of documents; packing returns pieces.
A stage's columns are numbered while it works, so extra columns may have any names. Null text has no words and no
letters; a row with a null doc_id is judged by its own text, as is each of several rows that share a doc_id; rows equal
in doc_id and text share their fate, and keep their number. An empty table gives no rows. Texts may be of any length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linesift.llm import decontam, exact_dedup, lang_id, near_dedup, packing
from linesift.llm.common import row_hash, same_row, stored
from linesift.llm.queries import tokenizer_path


#: Words that a Python worker remembers while it packs; the same worker has held the models of the stages before.
REMEMBERED = 200_000


def _numbered(docs: DataFrame) -> tuple[DataFrame, str, str, str]:
    """docs with columns c0, c1, ..., and those of doc_id, text and lang."""
    at = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*at.values()), at["doc_id"], at["text"], at["lang"]


def _among(docs: DataFrame, key: str, kept: DataFrame) -> DataFrame:
    """The rows of docs whose key is in kept, a table of one column; null is in it if kept has it. No text is sorted."""
    kept = kept.toDF("_kept").distinct().hint("shuffle_hash")
    return docs.join(kept, docs[key].eqNullSafe(kept["_kept"]), "left_semi")


def _judged(docs: DataFrame, id_: str, text: str, kept: DataFrame) -> DataFrame:
    """The rows of docs that are in kept, a table of ids and rows. Each row goes by its own text, also where others share its id, or lack one too."""
    rows = docs.withColumns({"id": F.col(id_), "row": row_hash(id_, text)})
    return same_row(rows, kept.select("id", "row").distinct(), "left_semi").drop("id", "row")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is rejected go: those without letters (null and empty texts among them), and those that fit
    no language's model. Without any labelled row nothing is learned, and every document goes."""
    rows, id_, text, lang = _numbered(docs)
    found = lang_id.identify(rows, lang_id.fit(rows, id_, text, lang), keep=rows.columns, text_col=text)
    return found.filter(~F.col("rejected")).select(rows.columns).toDF(*docs.columns)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal texts (null is empty), the one with the largest doc_id stays, with all rows that repeat it; one
    without a doc_id stays only if no document of its text has one."""
    rows, id_, text, _ = _numbered(docs)
    kept = exact_dedup.exact_dedup(rows, id_, text).filter("kept").select(F.struct(F.col(id_).alias("id"), "text_sha256"))
    key = F.struct(F.col(id_).alias("id"), F.sha2(F.coalesce(F.col(text), F.lit("")), 256).alias("text_sha256"))
    return _among(rows.withColumn("key", key), "key", kept).drop("key").toDF(*docs.columns)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five words, similarity 0.8), the document with the smallest doc_id stays. Documents
    without words, and rows without a doc_id, are copies of nothing."""
    rows, id_, text, _ = _numbered(docs)
    return _judged(rows, id_, text, near_dedup.verdicts(rows, id_, text).filter("kept")).toDF(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of any benchmark item go: here one item is enough. Items without an id or words hold
    nothing; an empty benchmark keeps all documents."""
    rows, id_, text, _ = _numbered(docs)
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    clean = decontam.PositionalIndex(rows, bench, id_, text).verdicts(least_items=1).filter(~F.col("contaminated"))
    return _judged(rows, id_, text, clean).toDF(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens with their places in sequences; null text is the end token alone, and no row is left out."""
    return packing.pack(docs, tokenizer_path(), remembered=REMEMBERED)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("decontamination", decontamination),
    ("packing", pack),
]

#: SQL can't express the first stage, nor the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
