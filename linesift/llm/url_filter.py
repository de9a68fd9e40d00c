"""URL filter: a blocked Bloom filter of listed canonical URLs, then an exact hash join.

A listed entry is a host and a path prefix, with a verdict. The canonical forms of a URL that could be listed are
few: the suffixes of its host with as many labels as some entry has, times the prefixes of its path as long as
some entry's. The Bloom filter, a literal sized by the counted list (4 MB at most), drops nearly all of them; the exact join removes the
false positives. No Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, bloom_blocks, blocked_bloom, let, might_contain

#: Entries up to which the exact join broadcasts the list; beyond it, the list is shuffled and hot keys are salted.
BROADCAST_ENTRIES = 100_000
SALTS = 16

#: (verdict, host, path) of the stated rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def listed_urls(spark: SparkSession, rules=RULES, listed: DataFrame | None = None) -> DataFrame:
    """verdict, host, path, stated: the stated rules, and a list of URLs (verdict, host, path) that decides where no rule fits.

    Such a list is the user's data, and may be of any size; none comes with this library.
    """
    rows = spark.createDataFrame([(v, h, p, True) for v, h, p in rules], "verdict string, host string, path string, stated boolean")
    return rows if listed is None else rows.unionByName(listed.select("verdict", "host", "path", F.lit(False).alias("stated")))


def url_parts(url):
    """host and path of a url: both empty without '://' or for null."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.char_length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return F.translate(F.regexp_extract(rest, r"(?s)^[^/?#]*", 0), UPPER, UPPER.lower()), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def url_verdicts(urls: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """Per row: the id, host, path, rule, verdict.

    listed has verdict, host, path and stated. An entry fits its host and all subdomains, if the path starts with
    its path. rule is the longest stated entry that fits, host and path, and gives the verdict; else rule is null
    and the longest entry that isn't stated gives it, or default. Of equally long entries the last in (rule,
    verdict) order wins. A null url and one without '://' get default. Entries with a null field fit nothing.
    Repeated rows stay repeated, an empty table gives no rows, and columns other than the two named are not read.
    """
    listed = listed.select("verdict", "host", "path", "stated").dropna().groupBy(F.concat("host", "path").alias("rule"), F.col("host").alias("h"), F.col("path").alias("p")).agg(F.max(F.struct("stated", "verdict")).alias("v"))
    listed = listed.select("rule", "h", "p", "v.stated", F.col("v.verdict").alias("says"))
    shape = listed.agg(
        F.collect_set(F.size(F.split("h", r"\."))).alias("labels"), F.collect_set(F.char_length("p")).alias("lengths"), F.count(F.lit(1)).alias("entries")
    ).first()  # two short lists of small numbers, and a count
    host, path = url_parts(F.col(url_col))
    rows = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    if not shape["entries"]:
        return rows.select(F.col("id").alias(id_col), "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    blocks = bloom_blocks(shape["entries"])
    bloom = blocked_bloom(listed, "rule", blocks)
    suffixes = let(F.split("host", r"\."), lambda parts: F.transform(
        F.filter(F.array(*map(F.lit, sorted(shape["labels"]))), lambda n: F.size(parts) >= n),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    ))
    prefixes = F.transform(F.filter(F.array(*map(F.lit, sorted(shape["lengths"]))), lambda n: F.char_length("path") >= n), lambda n: F.substring(F.col("path"), F.lit(1), n))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.struct(F.concat(s, p).alias("rule"), s.alias("h")))))
    rows = rows.withColumn("possible", F.filter(keys, lambda k: might_contain(bloom, k["rule"], blocks)))
    hits = rows.select("id", "host", "path", F.greatest(F.size("possible"), F.lit(1)).alias("n"), F.explode_outer("possible").alias("key")).select("id", "host", "path", "n", "key.rule", "key.h")
    if shape["entries"] <= BROADCAST_ENTRIES:
        exact = hits.join(F.broadcast(listed.drop("p")), ["rule", "h"], "left")
    else:
        salt = F.pmod(F.xxhash64("id", "host", "path"), F.lit(SALTS))
        spread = listed.drop("p").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SALTS - 1).cast("bigint")))).hint("shuffle_hash")
        exact = hits.withColumn("salt", salt).join(spread, ["rule", "h", "salt"], "left")
    best = F.max(F.when(F.col("says").isNotNull(), F.struct("stated", F.char_length("rule"), "rule", "says")))
    # A url's few candidates meet under its own id. Repeated rows have equally many: that gives their number back.
    judged = exact.groupBy("id", "host", "path", "n").agg(best.alias("best"), (F.count(F.lit(1)) / F.col("n")).cast("int").alias("times"))
    return judged.select(
        F.col("id").alias(id_col), "host", "path", F.when(F.col("best.stated"), F.col("best.rule")).alias("rule"),
        F.coalesce("best.says", F.lit(default)).alias("verdict"), F.explode(F.array_repeat(F.lit(0), F.col("times"))).alias("_"),
    ).drop("_")
