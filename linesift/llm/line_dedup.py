"""Line dedup with a sharded minimal perfect hash over distinct line hashes.

Each shard of the index is one row of flat arrays: a minimal perfect hash of the shard's line hashes, and at the
place it gives, a line's fingerprint, the number of documents that hold it, and the smallest of their ids.
Documents probe the arrays rather than join lines: a chunk of documents asks each shard once for its distinct
hashes, so a line that a third of all documents hold is asked for once a chunk, and the answers go back to the
chunk. A shard that is asked for more than a task should take is repeated, and its questions are split. Chunks and
shards grow in number with the corpus, not in size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, ascii_lower, by_value, integral, row_hash, same_row, stored
from .textnum import fmix

LEAST_CHARS = 10
#: Distinct lines in a shard, and lines in a chunk of documents, on average.
SHARD_LINES = 200_000
CHUNK_LINES = 200_000
#: Bytes of questions (16 a line) that one task takes to a shard.
QUESTION_BYTES = 64 << 20
NO_ID = (1 << 63) - 1

U = np.uint64


def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (fmix(keys ^ U((level * 0x9E3779B97F4A7C15) % (1 << 64))) % U(size)).astype(np.int64)


def build_hash(keys: np.ndarray) -> list[np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys: at each level, a bit for each place that exactly one key takes."""
    levels = []
    while len(keys):
        size = max(64, len(keys) * 3 // 2)
        at = place(keys, len(levels), size)
        bits = np.bincount(at, minlength=size) == 1
        levels.append(bits)
        keys = keys[~bits[at]]
    return levels


def find(levels: list[np.ndarray], keys: np.ndarray) -> np.ndarray:
    """The index of each key, -1 for some that weren't among those it was built from (others get any index)."""
    out, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for i, bits in enumerate(levels):
        if not len(left):
            break
        at = place(keys[left], i, len(bits))
        hit = bits[at]
        out[left[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base, left = base + int(bits.sum()), left[~hit]
    return out


SHARD = "shard int, sizes array<int>, bits binary, fingerprints binary, counts binary, firsts binary, odd binary"


def build_shard(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["k1", "k2"])
    keys = pdf["k1"].to_numpy().view(U)
    odd = pdf["k1"].duplicated().to_numpy()  # two lines with one 64-bit hash: the second goes to a short exact list
    k1, k2, n, first = keys[~odd], pdf["k2"].to_numpy()[~odd], pdf["n"].to_numpy()[~odd], pdf["first"].to_numpy()[~odd]
    levels = build_hash(k1)
    at = find(levels, k1)
    order = np.empty(len(at), np.int64)
    order[at] = np.arange(len(at))
    row = {
        "shard": int(pdf["shard"].iloc[0]), "sizes": [len(x) for x in levels], "bits": np.packbits(np.concatenate(levels)).tobytes(),
        "fingerprints": k2[order].tobytes(), "counts": n[order].tobytes(), "firsts": first[order].tobytes(),
        "odd": pdf.loc[odd, ["k1", "k2", "n", "first"]].to_numpy(np.int64).tobytes(),
    }
    return pd.DataFrame([row])


def ask(pdf: pd.DataFrame, shards: int) -> pd.DataFrame:
    """A chunk's distinct line hashes, by shard."""
    pairs = np.unique(np.stack([np.concatenate(pdf[c].to_list()).astype(np.int64) for c in ("k1", "k2")], 1), axis=0)
    pairs = pairs[(pairs != 0).any(1)]
    shard = (pairs[:, 0].view(U) % U(shards)).astype(np.int32)
    order = np.argsort(shard, kind="stable")
    cut = np.flatnonzero(np.diff(shard[order])) + 1
    parts = [x for x in np.split(order, cut) if len(x)]
    chunk = int(pdf["chunk"].iloc[0])
    return pd.DataFrame({"shard": [int(shard[x[0]]) for x in parts], "chunk": [chunk] * len(parts), "pairs": [pairs[x].tobytes() for x in parts]}).astype({"shard": "int32", "chunk": "int32"})


def probe(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    """Of the lines that a chunk asked for, those that several documents hold, with the smallest id."""
    out = []
    if len(shard) and len(asked):
        s = shard.iloc[0]
        bits = np.unpackbits(np.frombuffer(s["bits"], np.uint8)).astype(bool)
        levels = np.split(bits[: sum(s["sizes"])], np.cumsum(s["sizes"])[:-1])
        prints, counts, firsts = (np.frombuffer(s[c], np.int64) for c in ("fingerprints", "counts", "firsts"))
        odd = np.frombuffer(s["odd"], np.int64).reshape(-1, 4)
        for chunk, pairs in zip(asked["chunk"], asked["pairs"]):
            pairs = np.frombuffer(pairs, np.int64).reshape(-1, 2)
            at = find(levels, pairs[:, 0].copy().view(U))
            known = (at >= 0) & (prints[at] == pairs[:, 1])
            n, first = np.where(known, counts[at], 0), np.where(known, firsts[at], 0)
            for k1, k2, m, f in odd:
                here = (pairs[:, 0] == k1) & (pairs[:, 1] == k2)
                n[here], first[here] = m, f
            many = n >= 2
            if many.any():
                out.append((chunk, np.column_stack([pairs[many], first[many]]).tobytes()))
    return pd.DataFrame(out, columns=["chunk", "found"]).astype({"chunk": "int32"})


def settle(rows: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
    """Per document that loses lines: which ones."""
    out = []
    if len(rows) and len(found):
        known = np.concatenate([np.frombuffer(x, np.int64) for x in found["found"]]).reshape(-1, 3)
        known = known[np.lexsort((known[:, 1], known[:, 0]))]
        sizes = [len(x) for x in rows["k1"]]
        k1, k2 = (np.concatenate(rows[c].to_list()).astype(np.int64) for c in ("k1", "k2"))
        own = np.repeat(rows["oid"].to_numpy(), sizes)
        at = np.searchsorted(known[:, 0], k1)
        drop = np.zeros(len(k1), bool)
        left = np.flatnonzero(at < len(known))
        while len(left):  # more than one step only where two lines share a hash
            left = left[known[at[left], 0] == k1[left]]
            same = known[at[left], 1] == k2[left]
            drop[left[same]] = known[at[left[same]], 2] != own[left[same]]
            left = left[~same]
            at[left] += 1
            left = left[at[left] < len(known)]
        for i, part in enumerate(np.split(drop, np.cumsum(sizes)[:-1])):
            if part.any():
                out.append((rows["id"].iloc[i], rows["row"].iloc[i], part))
    return pd.DataFrame(out, columns=["id", "row", "gone"])


by_value(__name__)


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineIndex:
    """The stored shards of a corpus, and the line hashes of its documents (both in the shared folder)."""

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS):
        integral(docs, id_col)
        self.id_col, self.texts = id_col, docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_hash("id", "text"))
        key = lambda line: ascii_lower(F.btrim(line, F.lit(BLANKS)))
        keys = F.transform(lines(F.col("text")), lambda x: F.transform(F.array(key(x)), lambda k: F.when(F.char_length(k) >= least_chars, F.struct(F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(1), k).alias("k2"))))[0])
        rows = self.texts.select("id", "row", keys.alias("keys")).filter(F.exists("keys", lambda k: k.isNotNull()))
        zero = F.struct(F.lit(0).cast("bigint").alias("k1"), F.lit(0).cast("bigint").alias("k2"))
        rows = rows.select("id", "row", F.coalesce("id", F.lit(NO_ID)).alias("oid"), F.transform("keys", lambda k: F.coalesce(k, zero)).alias("keys"))
        self.rows = stored(rows.select("id", "row", "oid", F.transform("keys", lambda k: k["k1"]).alias("k1"), F.transform("keys", lambda k: k["k2"]).alias("k2")), "lines")
        held = self.rows.select("oid", F.explode(F.array_distinct(F.arrays_zip("k1", "k2"))).alias("k")).filter((F.col("k.k1") != 0) | (F.col("k.k2") != 0))
        # A document is its id: rows that repeat an id count once.
        several = F.when(F.min("oid") == F.max("oid"), F.lit(1)).otherwise(F.count(F.lit(1)))
        distinct = stored(held.groupBy("k.k1", "k.k2").agg(several.cast("bigint").alias("n"), F.min("oid").alias("first")), "distinct")
        sizes = self.rows.agg(F.sum(F.size("k1"))).first()[0] or 0
        self.shards, self.chunks = 1 + distinct.count() // SHARD_LINES, 1 + sizes // CHUNK_LINES
        # The unsigned remainder, as in ask().
        high, low = F.shiftrightunsigned("k1", 1), F.col("k1").bitwiseAND(F.lit(1).cast("bigint"))
        shard = ((high % self.shards) * 2 + low) % self.shards
        self.index = stored(distinct.withColumn("shard", shard.cast("int")).groupBy("shard").applyInPandas(build_shard, SHARD), "shards")

    def gone(self) -> DataFrame:
        """id, row and, for each line, whether it goes; only documents that lose lines."""
        shards = self.shards
        rows = self.rows.withColumn("chunk", F.pmod(F.xxhash64("id", "row"), F.lit(self.chunks)).cast("int"))
        asked = stored(rows.groupBy("chunk").applyInPandas(lambda pdf: ask(pdf, shards), "shard int, chunk int, pairs binary"), "asked")
        salts = asked.groupBy("shard").agg(F.ceil(F.sum(F.octet_length("pairs")) / QUESTION_BYTES).cast("int").alias("salts"))
        index, key = self.index, ["shard"]
        if not salts.filter("salts > 1").isEmpty():
            salts, key = stored(salts, "salts"), ["shard", "salt"]
            index = index.join(salts, "shard").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).drop("salts")
            asked = asked.join(salts, "shard").withColumn("salt", F.pmod("chunk", "salts")).drop("salts")
        found = asked.groupBy(*key).cogroup(index.groupBy(*key)).applyInPandas(probe, "chunk int, found binary")
        kind = self.rows.schema["id"].dataType.simpleString()
        out = rows.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInPandas(settle, f"id {kind}, row bigint, gone array<boolean>")
        return out.dropDuplicates(["id", "row"])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_chars: int = LEAST_CHARS) -> DataFrame:
    """Per row: the id, n_lines, n_dropped and kept (the lines that stay, joined by newlines).

    Lines are equal if they are after trimming ASCII white space and lower-casing A-Z. Of lines of at least
    least_chars code points that several documents hold, only those of the smallest id stay, all of them. Null and
    empty text is one empty line. Rows with a null id count as one document, after all others. Rows that repeat
    an id are one document; repeated rows get equal results. Ids are integers below 2**63 - 1. An empty table gives
    no rows; of docs only the two columns are read.
    """
    index = LineIndex(docs, id_col, text_col, least_chars)
    rows = same_row(index.texts, index.gone(), "left")
    rows = rows.select("id", lines(F.col("text")).alias("lines"), "gone")
    keep = F.when(F.col("gone").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~F.get("gone", i)))
    dropped = F.coalesce(F.size(F.filter("gone", lambda g: g)), F.lit(0))
    return rows.select(F.col("id").alias(id_col), F.size("lines").cast("bigint").alias("n_lines"), F.greatest(dropped, F.lit(0)).cast("bigint").alias("n_dropped"), F.array_join(keep, "\n").alias("kept"))
