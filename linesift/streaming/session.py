"""Session memory as a stream: what of each search is new to its session.

Events (session, kind, file, key, ns) come in order of ingest: 'shown' (a line that a search found), 'edit' (its file
changed: what was shown of it no longer counts), 'clear' (the session forgets all). State is kept by session: each
key's file, and drops out by time to live.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENTS = "session string, kind string, file string, key string, ns long"
FRESH = "session string, file string, key string, ns long"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Sessions idle for three days are forgotten.
IDLE_MS = 3 * 24 * 3600 * 1000


class SeenLines(StatefulProcessor):
    """Emits the lines that a session hasn't seen, and remembers them. A map entry for each line, and one for each edited file."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "file string, ns long", ttlDurationMs=IDLE_MS)
        self.edited = handle.getMapState("edited", "file string", "ns long", ttlDurationMs=IDLE_MS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        every = pd.concat(list(rows)).sort_values("ns", kind="stable")
        out = []
        for r in every.itertuples(index=False):
            file = r.file or ""
            if r.kind == "clear":
                self.seen.clear()
            elif r.kind == "edit":
                self.edited.updateValue((file,), (int(r.ns),))
            else:
                # Anything in doubt counts as unseen: an edit at the same moment makes the line new.
                known = self.seen.containsKey((r.key,)) and self.seen.getValue((r.key,))
                stale = known and known[0] and self.edited.containsKey((known[0],)) and self.edited.getValue((known[0],))[0] >= known[1]
                if not known or stale:
                    out.append((key[0], file, r.key, int(r.ns)))
                    self.seen.updateValue((r.key,), (file, int(r.ns)))
        yield pd.DataFrame(out, columns=["session", "file", "key", "ns"])

    def close(self) -> None:
        pass


def fresh_lines(events: DataFrame) -> DataFrame:
    """events: a stream with the columns of EVENTS. A stream of the lines that were new to their session."""
    conf = events.sparkSession.conf
    conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # there are no timers, so no batch is needed without data
    return events.groupBy("session").transformWithStateInPandas(SeenLines(), outputStructType=FRESH, outputMode="append", timeMode="ProcessingTime")


def replay(events: DataFrame) -> DataFrame:
    """The same memory over a batch: session, file, key of what still counts as shown at the end.

    Edits and clears are reduced to their last before they are joined.
    """
    edits = events.filter("kind = 'edit'").groupBy("session", "file").agg(F.max("ns").alias("edited"))
    clears = events.filter("kind = 'clear'").groupBy("session").agg(F.max("ns").alias("cleared"))
    shown = events.filter("kind = 'shown'").groupBy("session", "file", "key").agg(F.max("ns").alias("ns"))
    rows = shown.join(edits, ["session", "file"], "left").join(clears, "session", "left")
    none = F.lit(-(1 << 62))
    return rows.filter((F.col("ns") > F.coalesce("edited", none)) & (F.col("ns") > F.coalesce("cleared", none))).select("session", "file", "key")
