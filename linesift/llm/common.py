"""Helpers shared by the training-data operators."""

from __future__ import annotations

import sys
import uuid
from functools import reduce

from pyspark import cloudpickle
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_dir, stored  # noqa: F401  the operators take stored() from here

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The six ASCII white-space characters, \x20 and \x09 to \x0D.
BLANKS = " \t\n\x0b\x0c\r"


def by_value(name: str) -> None:
    """Ship the functions of this module with each task, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[name])


def integral(df: DataFrame, id_col: str) -> str:
    """The type of an id column, which has to be integral: components and smallest ids are kept as bigint."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{id_col} is {kind}; this operator takes integer ids")
    return kind


def bounded_batches(spark: SparkSession) -> None:
    """Hand Python workers at most 1,000 rows and 4 MB at a time, from now on in this session: texts may be long."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 1000), ("spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20)):
        spark.conf.set(key, str(most))


def give_back() -> None:
    """Return a Python worker's free memory to the machine: the worker outlives its task, and the JVM beside it needs room."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
        trim(0)


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_dir(spark)}/linesift/{tag}-{uuid.uuid4().hex}"


def read_if_there(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """The Parquet files at a path, or None if there is no such path. Any other failure is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def row_hash(*cols: str | Column) -> Column:
    """Tells rows that share an id apart; rows equal in all of cols share it, and get equal results."""
    return F.xxhash64(*cols, F.lit(7))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() does that at once where each character is one byte."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def let(value: Column, body) -> Column:
    """body(value), with value evaluated once even where body uses it in lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has been counted to have at most so many rows, else df as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


#: A key is hot if it holds more than this share of the rows, so at most 1 / HOT_SHARE keys are hot.
HOT_SHARE = 0.002


def join_keys(rows: DataFrame, keys: DataFrame, on: list[str], n: str, total: int, how: str = "inner") -> DataFrame:
    """Join (inner or left) of rows with one row a key, whose column n counts the key's rows (of total); n is dropped.

    Rows of hot keys meet their keys in a broadcast of at most 1 / HOT_SHARE rows of fixed width, so they stay where
    they are; the others are shuffled.
    """
    least = max(100, int(total * HOT_SHARE))
    hot = keys.filter(F.col(n) > least).drop(n).withColumn("_hot", F.lit(True))
    tagged = rows.join(F.broadcast(hot), on, "left")
    cold = tagged.filter(F.col("_hot").isNull()).select(rows.columns).join(keys.filter(F.col(n) <= least).drop(n), on, how)
    return tagged.filter(F.col("_hot").isNotNull()).drop("_hot").unionByName(cold)


def bloom_blocks(keys: int) -> int:
    """Blocks of 64 bits for so many keys: 16 bits a key, rounded up to a power of two.

    At most MOST_BLOCKS (4 MB): that holds a million keys as well, and for more keys it lets more through, which the
    exact join behind it takes out.
    """
    return min(MOST_BLOCKS, max(16, 1 << (max(keys, 1) // 4).bit_length()))


MOST_BLOCKS = 1 << 19


def _bit(h: Column, i: int) -> Column:
    """The place of the i-th bit of a hash in its block."""
    return F.shiftrightunsigned(h, 32 + 7 * i).bitwiseAND(F.lit(63)).cast("int")


def _block(h: Column, blocks: int) -> Column:
    return h.bitwiseAND(F.lit(blocks - 1)).cast("int")


def blocked_bloom(keys: DataFrame, key: str, blocks: int) -> Column:
    """A blocked Bloom filter of a column, as a literal array of 64-bit blocks. 8 * blocks bytes go to the driver.

    Take blocks, a power of two, from bloom_blocks() of the counted keys.
    """
    h = F.xxhash64(F.col(key))
    one = F.lit(1).cast("bigint")
    mask = reduce(lambda a, b: a.bitwiseOR(b), (F.call_function("shiftleft", one, _bit(h, i)) for i in range(3)))
    words = keys.select(_block(h, blocks).alias("b"), mask.alias("m")).groupBy("b").agg(F.bit_or("m").alias("m"))
    filled = [0] * blocks
    for b, m in words.collect():
        filled[b] = m
    return F.from_json(F.lit("[" + ",".join(map(str, filled)) + "]"), "array<bigint>")


def might_contain(bloom: Column, key: Column, blocks: int) -> Column:
    """The bits are tested one by one: most keys fail the first, and are hashed once."""
    h = F.xxhash64(key)
    one = F.lit(1).cast("bigint")
    return reduce(lambda a, b: a & b, (F.call_function("shiftrightunsigned", F.get(bloom, _block(h, blocks)), _bit(h, i)).bitwiseAND(one) == one for i in range(3)))


def same_row(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    """Join on id and row (see row_hash), where a null id equals a null id; right's ids and rows are dropped.

    right is the lighter side: it is hashed, so the texts on the left need no sort.
    """
    right = right.withColumnsRenamed({"id": "_id", "row": "_row"}).hint("shuffle_hash")
    return left.join(right, left["id"].eqNullSafe(right["_id"]) & (left["row"] == right["_row"]), how).drop("_id", "_row")


by_value(__name__)
