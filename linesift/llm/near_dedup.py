"""MinHash near-dedup.

One-permutation hashing gives each set of word shingles a signature from one pass over its hashes; empty bins are
filled by optimal densification. Bands of the signature are bucketed. A bucket of m sets gives m - 1 candidate
edges, a star around its smallest member, so the number of pairs stays in proportion to the members. The
components of the stars are families: sets that could be linked meet in one. Inside a family, links are
confirmed on full sets: postings of the family's shingles give every intersection exactly. Families beyond a
bound are cut into blocks. Once each block is confirmed, only members outside the family's largest component so far
meet the other blocks, so a group of near copies of any size costs its size. Only a spanning forest of the links
leaves a task.

Equal sets are one class from the start, so copies of a text cost nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, by_value, give_back, integral, row_hash, same_row, stored
from .components import components
from .textnum import U, chunks, digest, fmix, run_hashes, signed, word_hashes

BINS, ROWS = 128, 4
BANDS = BINS // ROWS
#: Members of a family, and shingles of all of them, that one task takes; a larger family is cut into blocks.
BLOCK, BLOCK_SHINGLES = 250, 2_000_000


def encoded(texts: pd.Series) -> list[bytes]:
    return [t.encode("utf-8", "surrogatepass").lower() if t else b"" for t in texts]  # bytes.lower() knows A-Z alone


def shingles(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Each text's set of k-word shingles as sorted 64-bit hashes; the whole sequence where it has fewer words."""
    (words, _), first = word_hashes(texts)
    long = np.diff(first)
    runs = {n: run_hashes(words, n, 0) for n in {k, *np.unique(long[long < k]).tolist()} - {0}}
    out = []
    for a, n in zip(first[:-1], long):
        out.append(np.unique(runs[k][a : a + n - k + 1]) if n >= k else runs[n][a : a + 1] if n else np.empty(0, U))
    return out


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of BINS minima for each (non-empty) set."""
    sig, full = np.zeros((len(sets), BINS), U), np.zeros((len(sets), BINS), bool)
    edges = (np.arange(BINS + 1, dtype=object) << (64 - BINS.bit_length() + 1))[:-1].astype(U)
    for i, s in enumerate(sets):
        at = np.append(np.searchsorted(s, edges), len(s))  # sets are sorted, and a bin is a range of hashes
        full[i] = at[1:] > at[:-1]
        sig[i, full[i]] = s[at[:-1][full[i]]]
    was, (row, col) = full.copy(), np.nonzero(~full)
    step = 0
    while len(row):  # each empty bin walks its own way through the bins until it meets a full one
        to = (fmix((col * 65537 + step * 257 + 1).astype(U)) >> U(64 - BINS.bit_length() + 1)).astype(np.int64)
        hit = was[row, to]
        sig[row[hit], col[hit]] = sig[row[hit], to[hit]]
        row, col, step = row[~hit], col[~hit], step + 1
    return sig


def sign_rows(k: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = encoded(pdf["text"])
            for i, j in chunks(texts):
                sets = shingles(texts[i:j], k)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                bands: list = [None] * len(sets)
                if len(some):
                    sig = signatures([sets[x] for x in some]).reshape(len(some), BANDS, ROWS)
                    key = np.broadcast_to(np.arange(BANDS, dtype=U), sig.shape[:2]).copy()
                    for r in range(ROWS):
                        key = fmix(key * U(0x9E3779B97F4A7C15) + sig[:, :, r])
                    for x, row in zip(some, signed(key)):
                        bands[x] = row
                whole = [digest(s.tobytes()) for s in sets]
                yield pd.DataFrame({"id": pdf["id"].iloc[i:j].to_numpy(), "row": pdf["row"].iloc[i:j].to_numpy(), "n": size, "s1": [x[0] for x in whole], "s2": [x[1] for x in whole], "bands": bands})
        give_back()

    return run


def confirmed(nodes: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets: 100 * intersection >= percent * union. sides: only links between 0 and 1."""
    n = len(nodes)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(word, kind="stable")
    count = np.bincount(word)
    begin = np.concatenate(([0], np.cumsum(count)))
    posted = owner[order]
    cut = np.concatenate(([0], np.cumsum(size)))
    side = np.array(sides) if sides else None
    root = np.arange(n)
    out = []
    for i in range(n - 1):
        mine = word[cut[i] : cut[i + 1]]
        mine = mine[count[mine] > 1]
        if len(mine) * 100 < percent * size[i]:  # too many of its shingles stand nowhere else
            continue
        both = np.zeros(n, np.int64)
        for part in np.array_split(mine, 1 + int(count[mine].sum()) // 4_000_000):
            if len(part):
                long = count[part]
                at = np.repeat(begin[part] - np.concatenate(([0], np.cumsum(long)[:-1])), long) + np.arange(long.sum())
                both += np.bincount(posted[at], minlength=n)
        link = 100 * both >= percent * (size + size[i] - both)
        link[: i + 1] = False
        if side is not None:
            link &= side != side[i]
        for j in np.flatnonzero(link & (root != root[i])):
            if root[j] != root[i]:
                root[root == root[j]] = root[i]
                out.append((nodes[i], nodes[j]))
    return out


def link_rows(k: int, percent: int):
    """Rows come in the order of their task key; each key's rows are confirmed together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, nodes, texts, sides = None, [], [], []

        def close():
            sets = []
            for i, j in chunks(texts):
                sets += shingles(texts[i:j], k)
            return confirmed(nodes, sets, percent, sides if any(sides) else None) if len(nodes) > 1 else []

        out = []
        for pdf in batches:
            for *now, node, text, side in zip(pdf["family"], pdf["x"], pdf["y"], pdf["node"], encoded(pdf["text"]), pdf["side"]):
                if now != key:
                    if key:
                        out += close()
                    key, nodes, texts, sides = now, [], [], []
                nodes.append(node)
                texts.append(text)
                sides.append(side)
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])
                out = []
        if key and (out := close()):
            yield pd.DataFrame(out, columns=["a", "b"])
        give_back()

    return run


by_value(__name__)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Per row: the id (an integer), n_shingles, component_id (the smallest id that links reach) and kept.

    Two texts are linked if 100 * shared shingles >= percent * shingles of either. Words are what ASCII white space
    parts, after lower-casing A-Z. A text without words, and a row with a null id, is linked with nothing (the
    latter's component_id is null, and it is kept). Rows that repeat an id are one document. Candidates come from
    BANDS bands of ROWS rows: a pair at similarity 0.8 shares none with a probability of 5e-8, and meets in a family
    by way of others even then. An empty table gives no rows; of docs only the two columns are read.
    """
    return verdicts(docs, id_col, text_col, k, percent).drop("row").withColumnRenamed("id", id_col)


def _links(texts: DataFrame, tasks: DataFrame, k: int, percent: int) -> DataFrame:
    """The links that tasks confirm. texts: node, text; tasks: node, family, x, y, side. A task is a family, x and y."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = texts.join(tasks.hint("shuffle_hash"), "node").select("family", "x", "y", "node", "text", "side")
    rows = rows.repartition(parts, "family", "x", "y").sortWithinPartitions("family", "x", "y")
    return stored(rows.mapInPandas(link_rows(k, percent), "a bigint, b bigint"), "confirmed")


def _across(members: DataFrame, found: DataFrame) -> DataFrame | None:
    """What is left to confirm in families of several blocks, as tasks; None if nothing is.

    members: node, family, n, blocks, own; found: node, root (components so far). Members that are joined already need
    no check. A family's largest component is taken as settled, and only the members outside it meet all the others,
    block by block.
    """
    now = stored(members.join(found, "node", "left").withColumn("c", F.coalesce("root", "node")).drop("root"), "settling")
    sizes = now.groupBy("family", "c").agg(F.count(F.lit(1)).alias("m"))
    largest = sizes.groupBy("family").agg(F.max_by("c", F.struct("m", "c")).alias("largest"))
    rest = now.join(largest, "family").filter("c <> largest").drop("largest")
    split = _blocks(rest).select("family", F.col("blocks").alias("others"))
    rest = stored(rest.join(split, "family"), "unsettled")
    if rest.isEmpty():
        return None
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    home = now.join(split, "family").select("node", "family", F.col("own").alias("x"), spread("others").alias("y"), F.lit(0).alias("side"))
    guest = rest.withColumn("y", F.pmod(F.xxhash64("node", F.lit(1)), "others").cast("int"))
    return home.unionByName(guest.select("node", "family", spread("blocks").alias("x"), "y", F.lit(1).alias("side")))


def _blocks(members: DataFrame) -> DataFrame:
    """family, blocks: how many tasks' worth of members, or of shingles, a family has."""
    return members.groupBy("family").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("blocks"))


def verdicts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """near_dedup() with the id as id, and row: rows that share an id may differ in kept (see row_hash)."""
    spark = docs.sparkSession
    bounded_batches(spark)
    kind = integral(docs, id_col)
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("row", row_hash("id", "text"))
    signed_rows = stored(texts.mapInPandas(sign_rows(k), f"id {kind}, row bigint, n bigint, s1 bigint, s2 bigint, bands array<bigint>"), "signed")
    some = signed_rows.filter("n > 0 and id is not null")
    classes = some.groupBy("s1", "s2", "n").agg(F.min(F.struct("id", "row", "bands")).alias("first"))
    classes = stored(classes.select("s1", "s2", "n", F.col("first.id").cast("bigint").alias("node"), "first.id", "first.row", "first.bands"), "classes")
    buckets = classes.select("node", F.explode("bands").alias("bucket"))
    stars = buckets.groupBy("bucket").agg(F.min("node").alias("b"), F.max("node").alias("m")).filter("m > b").select("bucket", "b")
    edges = buckets.join(stars, "bucket").filter("node <> b").select("node", "b")
    # A node is in BANDS buckets at most: its smallest star joins the others, which leaves a tenth of the edges.
    edges = edges.groupBy("node").agg(F.collect_set("b").alias("bs")).withColumn("m", F.array_min("bs"))
    edges = edges.select(F.explode(F.transform(F.concat("bs", F.array("node")), lambda b: F.struct(b.alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*").distinct()
    families = components(edges).select("node", F.col("root").alias("family"))
    members = classes.select("node", "n", "id", "row").join(families, "node")
    members = stored(members.join(_blocks(members), "family").withColumn("own", F.pmod(F.xxhash64("node"), "blocks").cast("int")), "families")
    kept = stored(same_row(texts, members.select("node", "id", "row"), "inner").select("node", "text"), "candidates")
    own = members.select("node", "family", F.col("own").alias("x"), F.col("own").alias("y"), F.lit(0).alias("side"))
    # The family's smallest member visits each block, so that near copies of it are one component at once.
    visits = members.filter("node = family and blocks > 1").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).filter("x <> own")
    links = _links(kept, own.unionByName(visits.select("node", "family", "x", F.col("x").alias("y"), F.lit(0).alias("side"))), k, percent)
    found = stored(components(links), "found")
    wide = members.filter("blocks > 1").drop("id", "row")
    if not wide.isEmpty() and (tasks := _across(wide, found)) is not None:
        found = components(links.unionByName(_links(kept, tasks, k, percent)))
    roots = stored(classes.join(found, "node", "left").select("s1", "s2", "n", F.coalesce("root", "node").alias("root")), "roots")
    judged = some.join(roots, ["s1", "s2", "n"]).select("id", "row", "n", F.col("root").alias("component"))
    alone = signed_rows.filter("n = 0 or id is null").select("id", "row", "n", F.col("id").cast("bigint").alias("component"))
    found = judged.unionByName(alone)
    return found.select("id", "row", F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"), F.col("component").eqNullSafe(F.col("id").cast("bigint")).alias("kept"))
