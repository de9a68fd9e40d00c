"""Secret scan over an incremental ledger of blobs.

Every version of a text is content-addressed by SHA-256. Only pairs of a blob and a rule version that the ledger
hasn't seen are scanned, once each, whatever the number of paths that hold the blob; the findings are joined back
to all of them. No Python runs on the executors.
"""

from __future__ import annotations

from functools import reduce
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bucketed import BucketedTable
from .common import join_keys, new_path, row_hash, same_row, stored

# The base rules, as (kind, pattern, group that is measured, least code points of it). A run that is
# long enough is found by its least length at once, where a failing match can't swallow the start of another.
BASE_RULES = [
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
]
#: Spans that the method adds.
MORE_RULES = [
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]+", 0, 1),
]
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "1"

FINDING = "array<struct<start:int,rank:int,kind:string,end:int>>"


def matches(text: Column, rule: tuple[str, str, int, int], rank: int) -> Column:
    """The leftmost non-overlapping matches of a rule as structs (start, rank, kind, end), in code points, end exclusive.

    The text between matches and the matches themselves alternate, so running lengths give the positions.
    """
    kind, pattern, group, least = rule
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    measured = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast(FINDING).alias("out"))
    steps = F.arrays_zip(F.transform(between, F.char_length).alias("gap"), F.transform(found, F.char_length).alias("long"), F.transform(measured, F.char_length).alias("size"))

    def step(acc, x):
        at = acc["at"] + x["gap"]
        span = F.array(F.struct(at.alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (at + x["long"]).alias("end")))
        keep = x["size"] >= least
        return F.struct((at + F.coalesce(x["long"], F.lit(0))).alias("at"), F.when(keep, F.concat(F.coalesce(acc["out"], F.array().cast(FINDING)), span)).otherwise(acc["out"]).alias("out"))

    spans = F.aggregate(steps, start, step, lambda acc: F.coalesce(acc["out"], F.array().cast(FINDING)))
    return F.when(text.rlike(pattern), spans).otherwise(F.array().cast(FINDING))


def scan(text: Column, rules=RULES) -> Column:
    """All spans by start, then kind as listed."""
    return F.array_sort(reduce(F.concat, (matches(text, rule, rank) for rank, rule in enumerate(rules))))


class BlobLedger:
    """Two append-only tables for each rule version, below path: scanned (blob) and findings (blob, spans; none for a blob
    without findings). Both are bucketed and sorted by blob, so a batch is joined with a version's ledger without moving it.

    scanned is written after findings, so a run that dies between them is repeated; a blob scanned twice has equal
    findings, of which one is read.
    """

    def __init__(self, spark: SparkSession, path: str | None = None, buckets: int | None = None):
        self.spark, self.path, self.buckets = spark, path or new_path(spark, "ledger"), buckets

    def _open(self, name: str, version: str) -> BucketedTable:
        columns = "blob STRING" + (f", spans {FINDING}" if name == "findings" else "")
        return BucketedTable(self.spark, f"{self.path}/{quote(version, safe='')}/{name}", columns, "blob", self.buckets)

    def scanned(self, version: str = RULE_VERSION) -> list[str]:
        """The blobs that were scanned under a rule version, for small ledgers and tests."""
        with self._open("scanned", version) as table:
            return [r["blob"] for r in table.rows().collect()]

    def ingest(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES, version: str = RULE_VERSION) -> DataFrame:
        """Scan what is new, and return per row: the id, blob and spans (an array, empty without findings).

        Null text is the empty blob. Rows with a null id, and repeated rows, keep their number. An empty table gives
        no rows; other columns are not read. The result doesn't change with later batches.
        """
        texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
        versions = stored(texts.select("id", F.sha2("text", 256).alias("blob"), row_hash("id", "text").alias("row")), "versions")
        # One row of each blob represents it; only ids and hashes are shuffled to find it. Written first: an anti-join
        # right above the aggregate would be moved below it, and meet every row.
        first = stored(versions.groupBy("blob").agg(F.min(F.struct("id", "row")).alias("first"), F.count(F.lit(1)).alias("m")), "blobs")
        with self._open("scanned", version) as scanned, self._open("findings", version) as findings:
            unseen = stored(first.hint("merge").join(scanned.rows(), "blob", "left_anti").select("blob", F.col("first.id").alias("id"), F.col("first.row").alias("row")), "unseen")
            to_scan = same_row(texts.withColumn("row", row_hash("id", "text")), unseen.select("id", "row"), "left_semi")
            # Written whole before it is filtered: a filter on spans would be moved below the join, and scan every row.
            blobs = stored(to_scan.select(F.sha2("text", 256).alias("blob"), scan(F.col("text"), rules).alias("spans")), "scans")
            findings.append(blobs.filter(F.size("spans") > 0).dropDuplicates(["blob"]))
            scanned.append(unseen.select("blob"))
            found = findings.rows().groupBy("blob").agg(F.first("spans").alias("spans"))
            # Findings of hot blobs meet their paths in a broadcast; see join_keys.
            found = stored(first.select("blob", "m").hint("merge").join(found, "blob"), "found")
        out = join_keys(versions, found, ["blob"], "m", versions.count(), "left")
        return out.select(F.col("id").alias(id_col), "blob", F.coalesce("spans", F.array().cast(FINDING)).alias("spans"))


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger: BlobLedger | None = None) -> DataFrame:
    """Per row: the id, counts of the base kinds, SHA-256 of the base spans, and all spans as kind:start:end."""
    found = (ledger or BlobLedger(docs.sparkSession)).ingest(docs, id_col, text_col)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE_RULES))
    return found.select(id_col, *(count(kind) for kind, *_ in BASE_RULES), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
