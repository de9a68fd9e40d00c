"""Substring dedup by seed and extend.

Seeds: of every run of window consecutive words, one k-word seed is its anchor, the one with the smallest hash
(winnowing). Equal runs have equal anchors in equal places, so a run can repeat in another document only if its
anchor does. Documents are joined on the anchors that several of them hold; all else is left alone.
Extension: around each shared anchor, the runs that it stands for are matched word for word to both sides, by
hashes of 128 bits (see textnum), against the smallest document that holds them. A document asks once for each
distinct run. A star takes the place of all pairs: a run's
smallest holder is found by partial aggregation. Adjoining runs merge to maximal repeats, which are removed.

Documents that are equal word for word are settled first, by one hash of the whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, integral, join_keys, row_hash, same_row, stored
from .textnum import chunks, digest, run_hashes, signed, word_hashes

WINDOW = 50
NO_ID = (1 << 63) - 1


def encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]


def anchored(words: np.ndarray, first: np.ndarray, window: int, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts' runs of window words: their starts, their texts, and the places and hashes of their anchors."""
    long = np.diff(first)
    starts = np.arange(max(0, len(words) - window + 1))
    text = np.repeat(np.arange(len(long)), long)[: len(starts)]
    inside = starts + window <= first[text + 1]
    starts, text = starts[inside], text[inside]
    if not len(starts):
        return starts, text, starts, starts.astype(np.uint64)
    seeds = run_hashes(words, seed, 0)
    span = window - seed + 1
    view = np.lib.stride_tricks.sliding_window_view(seeds, span)
    place = np.empty(len(starts), np.int64)
    for i in range(0, len(starts), 1 << 16):
        part = starts[i : i + (1 << 16)]
        place[i : i + (1 << 16)] = part + view[part].argmin(1)
    return starts, text, place, seeds[place]


def seed_rows(window: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["text"])
            for i, j in chunks(texts):
                lanes, first = word_hashes(texts[i:j])
                whole = [digest(b"".join(x[a:b].tobytes() for x in lanes)) for a, b in zip(first, first[1:])]
                starts, text, place, hashes = anchored(lanes[0], first, window, seed)
                cut = np.searchsorted(text, np.arange(j - i + 1))
                own = [np.unique(signed(hashes[cut[k] : cut[k + 1]])) for k in range(j - i)]
                yield pd.DataFrame({"id": pdf["id"].iloc[i:j].to_numpy(), "row": pdf["row"].iloc[i:j].to_numpy(), "n": np.diff(first), "q1": [x[0] for x in whole], "q2": [x[1] for x in whole], "anchors": own})

    return run


def extend_rows(window: int, seed: int):
    """Of each document: the places of its runs around shared anchors, which of its distinct runs each is, and those runs' hashes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["text"])
            for i, j in chunks(texts):
                lanes, first = word_hashes(texts[i:j])
                starts, text, _, hashes = anchored(lanes[0], first, window, seed)
                a, b = (run_hashes(x, window, lane) for lane, x in enumerate(lanes))
                cut = np.searchsorted(text, np.arange(j - i + 1))
                out = []
                for k in range(j - i):
                    mine = slice(cut[k], cut[k + 1])
                    s = starts[mine][np.isin(signed(hashes[mine]), pdf["shared"].iloc[i + k])]
                    order = np.lexsort((b[s], a[s]))
                    h1, h2 = a[s][order], b[s][order]
                    new = np.ones(len(s), bool)
                    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
                    which = np.empty(len(s), np.int32)
                    which[order] = np.cumsum(new) - 1
                    out.append(((s - first[k]).astype(np.int32), which, signed(h1[new]), signed(h2[new])))
                yield pd.DataFrame({c: pdf[c].iloc[i:j].to_numpy() for c in ("oid", "id", "row")} | {c: [x[n] for x in out] for n, c in enumerate(("at", "which", "h1", "h2"))})

    return run


def cut_rows(window: int):
    """Leave out the words of the runs that are gone: those at the places whose which is in gone. A whole copy goes entirely."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text, copy, at, which, gone in zip(encoded(pdf["text"]), pdf["copy"], pdf["at"], pdf["which"], pdf["gone"]):
                words = text.split()
                kept = words
                if copy == 1:
                    kept = []
                elif gone is not None and len(gone):
                    places = np.asarray(at)[np.isin(which, gone)]
                    cover = np.zeros(len(words) + 1, np.int64)
                    np.add.at(cover, places, 1)
                    np.add.at(cover, places + window, -1)
                    kept = [w for w, c in zip(words, np.cumsum(cover)) if not c]
                out.append((len(words), len(words) - len(kept), b" ".join(kept)))
            yield pd.DataFrame({"id": pdf["id"], "n_words": [x[0] for x in out], "n_removed": [x[1] for x in out], "kept": [x[2].decode("utf-8", "surrogatepass") for x in out]})

    return run


by_value(__name__)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Per row: the id (an integer below 2**63 - 1), n_words, n_removed and kept (the words that stay, joined by one space).

    Words are what ASCII white space parts. A word goes if some run of window words that covers it also starts in a
    document with a smaller id. Runs that repeat only inside one document stay. Null and empty text has no words.
    Rows with a null id count as one document after all others; rows that repeat an id are one document. An empty
    table gives no rows; of docs only the two columns are read.
    """
    bounded_batches(docs.sparkSession)
    seed = (window + 1) // 2
    kind = integral(docs, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_hash("id", "text"))
    seeds = stored(texts.mapInPandas(seed_rows(window, seed), f"id {kind}, row bigint, n bigint, q1 bigint, q2 bigint, anchors array<bigint>"), "seeds")
    seeds = seeds.filter(F.col("n") >= window).withColumn("oid", F.coalesce("id", F.lit(NO_ID)))
    # Of documents that are equal word for word, the smallest speaks; the others go as a whole.
    whole = seeds.groupBy("q1", "q2", "n").agg(F.min("oid").alias("least"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    ranked = join_keys(seeds, whole, ["q1", "q2", "n"], "copies", seeds.count(), "left")
    ranked = stored(ranked.select("id", "row", "oid", "anchors", (F.col("oid") > F.coalesce("least", "oid")).alias("copy")), "ranked")
    held = ranked.filter(~F.col("copy")).select("id", "row", "oid", F.explode("anchors").alias("anchor"))
    # Hot anchors and runs are told by their counts (see join_keys).
    shared = held.groupBy("anchor").agg(F.min("oid").alias("a"), F.max("oid").alias("b"), F.count(F.lit(1)).alias("m")).filter("a < b").select("anchor", "m")
    anchors = ranked.filter(~F.col("copy")).agg(F.sum(F.size("anchors"))).first()[0] or 0
    joined = join_keys(held, shared, ["anchor"], "m", anchors).groupBy("id", "row", "oid").agg(F.collect_set("anchor").alias("shared"))
    extended = same_row(texts, joined, "inner").mapInPandas(extend_rows(window, seed), f"oid bigint, id {kind}, row bigint, at array<int>, which array<int>, h1 array<bigint>, h2 array<bigint>")
    extended = stored(extended, "runs")
    runs = extended.select("oid", "id", "row", F.posexplode(F.arrays_zip("h1", "h2")).alias("n", "x")).select("oid", "id", "row", "n", "x.*")
    least = runs.groupBy("h1", "h2").agg(F.min("oid").alias("least"), F.max("oid").alias("most"), F.count(F.lit(1)).alias("m")).filter("least < most").select("h1", "h2", "least", "m")
    many = extended.agg(F.sum(F.size("h1"))).first()[0] or 0
    gone = join_keys(runs, least, ["h1", "h2"], "m", many).filter("least < oid").groupBy("id", "row").agg(F.collect_set("n").alias("gone"))
    gone = same_row(extended.select("id", "row", "at", "which"), gone, "inner")
    if extended.select("id", "row").distinct().count() < extended.count():  # rows that repeat: one of each speaks for all
        gone = gone.dropDuplicates(["id", "row"])
    copies = ranked.filter("copy").select("id", "row", F.lit(True).alias("copy")).dropDuplicates(["id", "row"])
    cut = same_row(texts, gone.withColumn("copy", F.lit(False)).unionByName(copies, allowMissingColumns=True), "left")
    return cut.select("id", "text", "copy", "at", "which", "gone").mapInPandas(cut_rows(window), f"id {kind}, n_words bigint, n_removed bigint, kept string").withColumnRenamed("id", id_col)
