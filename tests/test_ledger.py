"""The ledger of a stream equals the batch operator."""

import random
from datetime import datetime, timedelta

import pytest

from foliant.operators.state import mark_seen
from foliant.streaming.ledger import SEEN, ledger_stream, merged
from foliant.streaming.store import BucketStore

ROW = "user_id long, item long, seen_at timestamp"


def test_ledger_of_a_stream_equals_batches(spark, tmp_path):
    pytest.importorskip("google.protobuf")
    rng = random.Random(6)
    src, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    batches = [[(rng.randrange(4), rng.randrange(25), datetime(2024, 1, 1) + timedelta(hours=rng.randrange(300))) for _ in range(40)] for _ in range(3)]
    batches[1].append((None, 3, datetime(2024, 1, 1)))
    want = spark.createDataFrame([], ROW)
    for rows in batches:
        spark.createDataFrame(rows, ROW).coalesce(1).write.mode("append").parquet(src)
        ledger_stream(spark.readStream.schema(ROW).parquet(src), table, state, keep=8, buckets=3).awaitTermination()
        want = spark.createDataFrame(mark_seen(want, spark.createDataFrame([r for r in rows if r[0] is not None], ROW), keep=8).collect(), ROW)
        got = {tuple(r) for r in BucketStore(spark, table, SEEN).read("seen").collect()}
        assert got == {tuple(r) for r in want.collect()}
    number = BucketStore(spark, table, SEEN).version().number
    ledger_stream(spark.readStream.schema(ROW).parquet(src), table, str(tmp_path / "lost"), keep=8, buckets=3).awaitTermination()
    assert BucketStore(spark, table, SEEN).version().number == number


def test_merging_keeps_first_sightings_and_the_newest():
    assert merged({1: 10, 2: 20}, [(1, 5), (3, 30), (2, 25)], 2) == {2: 20, 3: 30}
    assert merged({}, [(1, 5), (2, 5), (3, 5)], 2) == {2: 5, 3: 5}
