"""Streams of records into keyed tables: every micro-batch is an idempotent upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from foliant.streaming.store import BucketStore, Spec

ROWS = "rows"


def _store(spark: SparkSession, table: str, key: str = "", order: str = "", buckets: int = 64) -> BucketStore:
    return BucketStore(spark, table, {ROWS: Spec(key, (key,), order)}, buckets)


def upsert_stream(stream: DataFrame, table: str, key: str, order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Runs what is available now; last ``order`` wins, a replayed batch changes nothing.

    Only buckets of keys that a batch has are written, and become visible with its epoch in
    one commit; see ``BucketStore``.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        _store(batch.sparkSession, table, key, order, buckets).commit({ROWS: batch}, epoch=("stream", epoch))

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_current(spark: SparkSession, table: str) -> DataFrame:
    return _store(spark, table).read(ROWS)


def windowed_counts(events: DataFrame, ts: str, keys: list[str], width: str = "1 day", late: str = "7 days") -> DataFrame:
    """Tumbling counts with a lookback for late rows."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count(F.lit(1)).alias("n"))
