"""Benchmark decontamination over a distributed positional inverted index.

Benchmark items are cut into windows of n words. Two passes over the corpus follow, and no text is shuffled:

1. Count every benchmark term in the corpus. Each window's terms are ranked from the rarest.
2. Post the occurrences of each window's rarest term: (term, document, position), with the words around it. The
   stored postings are the index; its lists are short, since the terms are rare.

A posting of a window's rarest term, less the term's place in the window, is a candidate start. The other terms'
lists, less their places, must hold the same start; they are intersected from the rarest to the most frequent,
and read from the words kept with the posting. What is left are the exact phrases. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bloom_blocks, blocked_bloom, let, might_contain, row_hash, small, stored

#: Distinct benchmark terms, or windows, up to which they are broadcast; beyond it they are shuffled.
BROADCAST_TERMS = 200_000

#: Fixed value: what stands between words.
BETWEEN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN_WORDS), "")


def windows(bench: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """terms, items: the distinct windows of n words (or of a whole shorter item), with the ids of their items."""
    cut = lambda w: F.when(F.size(w) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.slice(w, i, n)))
    rows = bench.filter(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.explode(let(words(F.col(text_col)), cut)).alias("terms"))
    return rows.groupBy("terms").agg(F.collect_set("item").alias("items"))


class PositionalIndex:
    """Postings of the rarest terms of a benchmark's windows in a corpus.

    docs: id_col and text_col are read, null text has no words. bench: item_col and text_col; items with a null id
    or without words have no window. Repeated items count once. Repeated rows of docs get equal results.
    """

    def __init__(self, docs: DataFrame, bench: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text", n: int = 8, slack: int = 0):
        self.n, self.id_col, self.reach = n, id_col, n - 1 + slack
        texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
        wins = stored(windows(bench, item_col, item_text_col, n), "windows")
        terms = wins.select(F.explode("terms").alias("term")).distinct()
        tokens = texts.select(F.explode(words(F.col("text"))).alias("term"))
        counts = tokens.join(small(terms, BROADCAST_TERMS), "term", "left_semi").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
        # A window with a term that the corpus doesn't hold can't occur: the inner join and the sizes drop it.
        places = wins.select("terms", "items", F.posexplode("terms").alias("j", "term")).join(counts, "term")
        ranked = places.groupBy("terms", "items").agg(F.array_sort(F.collect_list(F.struct("n", "term", "j"))).alias("order"))
        ranked = ranked.filter(F.size("order") == F.size("terms"))
        self.anchors = stored(
            ranked.groupBy(F.col("order")[0]["term"].alias("term")).agg(F.collect_list(F.struct("terms", "items", F.transform("order", lambda o: o["j"]).alias("js"))).alias("wins")), "anchors"
        )
        self.postings = stored(self._post(texts), "postings")

    def _post(self, texts: DataFrame) -> DataFrame:
        """A row of each document with pos null, and one of each posting; around: the words from pos - back on."""
        blocks = bloom_blocks(self.anchors.count())
        bloom = blocked_bloom(self.anchors, "term", blocks)
        reach = self.reach

        def post(w: Column) -> Column:
            at = F.filter(F.transform(w, lambda x, i: F.when(might_contain(bloom, x, blocks), i)), lambda i: i.isNotNull())
            return F.struct(F.size(w).cast("bigint").alias("n_words"), F.transform(at, lambda i: F.struct(
                i.alias("pos"), F.element_at(w, i + 1).alias("term"), F.least(i, F.lit(reach)).alias("back"),
                F.slice(w, i - F.least(i, F.lit(reach)) + 1, F.least(i, F.lit(reach)) + reach + 1).alias("around"),
            )).alias("posts"))

        rows = texts.select("id", row_hash("id", "text").alias("row"), let(words(F.col("text")), post).alias("p")).select("id", "row", "p.n_words", F.concat(F.array(F.lit(None)), F.col("p.posts")).alias("posts"))
        return rows.select("id", "row", "n_words", F.explode("posts").alias("post")).select("id", "row", "n_words", "post.*")

    def _candidates(self) -> DataFrame:
        posts = self.postings.filter(F.col("pos").isNotNull())
        held = self.anchors.agg(F.sum(F.size("wins"))).first()[0] or 0  # windows of n words each, whatever the rows
        return posts.join(F.broadcast(self.anchors) if held <= BROADCAST_TERMS else self.anchors, "term")

    def phrases(self) -> DataFrame:
        """Exact occurrences: id, row, pos (of the posting), starts: array of (start, length, items)."""
        back, around = F.col("back"), F.col("around")

        def holds(win: Column) -> Column:
            start = back - win["js"][0]
            # From the rarest term to the most frequent: each list, less its place, must hold the start.
            return (start >= 0) & F.forall(win["js"], lambda j: F.coalesce(F.get(around, start + j) == F.get(win["terms"], j), F.lit(False)))

        found = F.transform(F.filter("wins", holds), lambda win: F.struct((F.col("pos") - win["js"][0]).alias("start"), F.size(win["terms"]).alias("long"), win["items"].alias("items")))
        return self._candidates().select("id", "row", "pos", found.alias("starts")).filter(F.size("starts") > 0)

    def near(self, span: int) -> DataFrame:
        """Proximity matches: id, row, pos, items of windows all whose terms lie within span words around the posting, in any order."""
        if span > self.reach:
            raise ValueError("build the index with slack >= span - n + 1")
        win_in = lambda win: F.exists(F.sequence(F.greatest(F.col("back") - span + 1, F.lit(0)), F.col("back")), lambda s: F.size(F.array_except(win["terms"], F.slice("around", s + 1, span))) == 0)
        hits = F.filter("wins", win_in)
        return self._candidates().select("id", "row", "pos", F.array_distinct(F.flatten(F.transform(hits, lambda w: w["items"]))).alias("items")).filter(F.size("items") > 0)

    def report(self, least_items: int = 2) -> DataFrame:
        """Per row of docs: the id, n_words, n_hit, n_items, items_sha256, contaminated."""
        return self.verdicts(least_items).drop("row").withColumnRenamed("id", self.id_col)

    def verdicts(self, least_items: int = 2) -> DataFrame:
        """report() with the id as id, and row: rows that share an id may differ in their verdicts (see row_hash)."""
        # One row of a document each, and those with hits: repeated documents give their number back.
        heads = self.postings.filter(F.col("pos").isNull()).select("id", "row", "n_words", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("array<struct<start:int,long:int,items:array<bigint>>>").alias("starts"))
        hits = self.phrases()
        heads = heads.withColumn("starts", F.lit(None).cast(hits.schema["starts"].dataType))
        rows = heads.unionByName(hits, allowMissingColumns=True).groupBy("id", "row").agg(
            F.max("n_words").alias("n_words"), F.count_if(F.col("pos").isNull()).cast("int").alias("times"), F.flatten(F.collect_list("starts")).alias("hits")
        )
        covered = F.flatten(F.transform(F.array_distinct(F.transform("hits", lambda h: F.struct(h["start"], h["long"]))), lambda h: F.sequence(h["start"], h["start"] + h["long"] - 1)))
        items = F.array_sort(F.transform(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"]))), lambda i: i.cast("string")))
        rows = rows.select("id", "row", "n_words", F.size(F.array_distinct(covered)).cast("bigint").alias("n_hit"), items.alias("items"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_"))
        return rows.select(
            "id", "row", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
            F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("items") >= least_items).alias("contaminated"),
        )
