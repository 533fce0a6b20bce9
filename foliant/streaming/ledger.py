"""What users have seen, kept as state of a stream: first sightings, the newest ``keep`` of each user.

A user's ledger is one value of the state, two arrays of at most ``keep`` entries, so a batch
reads and writes it once.  Rows that change go to a bucketed table with the batch's epoch, so
a batch that runs again changes nothing, and what falls over the cap is removed there.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from foliant.streaming.store import BucketStore, Spec

SEEN = {"seen": Spec("user_id", ("user_id", "item"))}
CHANGES = "user_id long, item long, seen_at timestamp, kept boolean"


def merged(old: dict[int, int], rows: list[tuple[int, int]], keep: int) -> dict[int, int]:
    """Ledger (item: first time, in microseconds) after sightings, the newest ``keep``; ties go to the greater item."""
    after = dict(old)
    for item, at in rows:
        after[item] = min(at, after.get(item, at))
    return dict(sorted(after.items(), key=lambda x: (x[1], x[0]))[-keep:])


class Ledger(StatefulProcessor):
    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("ledger", "items array<bigint>, times array<bigint>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        had = self.state.get() if self.state.exists() else ([], [])
        old = dict(zip(had[0], had[1], strict=True))
        new = [(int(i), pd.Timestamp(t).value // 1000) for part in rows for i, t in zip(part["item"], part["seen_at"], strict=True)]
        after = merged(old, new, self.keep)
        self.state.update((list(after), list(after.values())))
        changed = [(i, t, True) for i, t in after.items() if old.get(i) != t] + [(i, t, False) for i, t in old.items() if i not in after]
        if changed:
            items, times, kept = zip(*changed, strict=True)
            yield pd.DataFrame({"user_id": [key[0]] * len(items), "item": items, "seen_at": pd.to_datetime(list(times), unit="us"), "kept": kept})

    def close(self) -> None:
        pass


def ledger_stream(sightings: DataFrame, table: str, checkpoint: str, keep: int = 5000, buckets: int = 64) -> StreamingQuery:
    """Runs what is available now; the table equals ``mark_seen`` applied batch after batch.

    sightings: user_id, item, seen_at (rows with a null are left out).  Needs the RocksDB state
    store.  Late rows count by their own time: an earlier sighting moves an entry back.
    """
    sightings.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    own = sightings.select("user_id", "item", "seen_at").where("user_id is not null and item is not null and seen_at is not null")
    changes = own.groupBy("user_id").transformWithStateInPandas(Ledger(keep), CHANGES, "Update", "None")

    def write(batch: DataFrame, epoch: int) -> None:
        # Counted even where the epoch is in the table already: the state moves on with the batch.
        batch.persist().count()
        kept, gone = batch.where("kept").drop("kept"), batch.where("not kept").select("user_id", "item")
        BucketStore(batch.sparkSession, table, SEEN, buckets).commit({"seen": kept}, {"seen": gone}, epoch=("ledger", epoch))
        batch.unpersist()

    return changes.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
