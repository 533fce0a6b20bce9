"""Bucketed tables: commits are whole or not there, and write what they touch."""

import os
from datetime import datetime

import pytest

from foliant.streaming.store import USER_TABLES, BucketStore, Spec, save_users
from foliant.streaming.upserts import read_current, upsert_stream

ROW = "k long, v string, at long"


def rows(store, table="t"):
    return sorted(map(tuple, store.read(table).collect()))


def files(path):
    return {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


@pytest.fixture
def store(spark, tmp_path):
    return BucketStore(spark, str(tmp_path / "s"), {"t": Spec("k", ("k",), "at"), "u": Spec("k", ("k", "v"))}, buckets=8)


def test_upserts_keep_the_last_and_write_touched_buckets(spark, store):
    df = lambda r: spark.createDataFrame(r, ROW)
    store.commit({"t": df([(i, "old", 1) for i in range(2000)])})
    before = files(store.root)
    store.commit({"t": df([(5, "new", 2), (5, "newer", 3), (6, "late", 0), (None, "no key", 1)])})
    added = {f: n for f, n in files(store.root).items() if f not in before}
    assert len(added) <= 3 and sum(added.values()) < 0.6 * sum(before.values())
    want = {i: (i, "old", 1) for i in range(2000)} | {5: (5, "newer", 3)}
    assert sorted(store.read("t").where("k is not null").collect()) == sorted(want.values())
    assert store.read("t").where("k is null").count() == 1
    assert store.read("t", store.version(1)).where("k = 5").first()["v"] == "old"


def test_a_stop_at_any_step_leaves_whole_tables(spark, store, monkeypatch):
    df = lambda r: spark.createDataFrame(r, ROW)
    store.commit({"t": df([(1, "a", 1), (2, "b", 1)]), "u": df([(1, "x", 1)])}, epoch=("s", 0))
    batch = {"t": df([(1, "c", 2), (3, "d", 2)]), "u": df([(1, "y", 1), (9, "z", 1)])}
    whole = (rows(store), rows(store, "u"))

    def stops(name, after):
        real, calls = getattr(BucketStore, name), []

        def broken(self, *args):
            calls.append(1)
            if len(calls) > after:
                raise KeyboardInterrupt
            return real(self, *args)

        monkeypatch.setattr(BucketStore, name, broken)
        with pytest.raises(KeyboardInterrupt):
            store.commit(batch, epoch=("s", 1))
        monkeypatch.setattr(BucketStore, name, real)
        assert (rows(store), rows(store, "u")) == whole

    stops("_merged", 0)
    stops("_merged", 1)
    stops("_publish", 0)
    store.commit(batch, epoch=("s", 1))
    done = (rows(store), rows(store, "u"))
    assert done == ([(1, "c", 2), (2, "b", 1), (3, "d", 2)], [(1, "x", 1), (1, "y", 1), (9, "z", 1)])
    assert store.commit(batch, epoch=("s", 1)) == store.version().number and (rows(store), rows(store, "u")) == done
    left = files(store.root)
    store.vacuum(keep=1)
    assert len(files(store.root)) < len(left) and (rows(store), rows(store, "u")) == done


def test_two_writers_of_one_version(spark, store):
    df = spark.createDataFrame([(1, "a", 1)], ROW)
    store.commit({"t": df})
    stale = store.version()
    store.commit({"t": df})
    stale.number += 1
    with pytest.raises(RuntimeError):
        store._publish(stale)


def test_saving_users_keeps_what_was_learned(spark, tmp_path):
    store = BucketStore(spark, str(tmp_path / "users"), USER_TABLES, buckets=4)
    users = lambda *ids: spark.createDataFrame([(i, f"{i}@x") for i in ids], "id string, email string")
    slugs = lambda *r: spark.createDataFrame(list(r), "user_id string, slug string, position int")
    save_users(store, users("a", "b", "c"), {"templates": slugs(("a", "one", 0), ("a", "two", 1), ("b", "one", 0))})
    profile = spark.createDataFrame([("a", "positive", "lung", 2.0), ("b", "positive", "heart", 1.0)], "user_id string, polarity string, term string, weight double")
    seen = spark.createDataFrame([("b", 7, datetime(2024, 1, 1)), ("c", 8, datetime(2024, 1, 2))], "user_id string, item long, seen_at timestamp")
    store.commit({"profiles": profile, "seen": seen})
    before = store.version()
    save_users(store, users("a", "c", "d"), {"templates": slugs(("a", "two", 0), ("d", "one", 0))})
    assert [r.id for r in store.read("users").orderBy("id").collect()] == ["a", "c", "d"]
    assert {(r.user_id, r.slug) for r in store.read("templates").collect()} == {("a", "two"), ("d", "one")}
    assert [r.user_id for r in store.read("profiles").collect()] == ["a"] and [r.user_id for r in store.read("seen").collect()] == ["c"]
    assert store.read("users", before).count() == 3 and store.read("profiles", before).count() == 2


def test_replayed_batches_change_nothing(spark, tmp_path):
    src, table = str(tmp_path / "in"), str(tmp_path / "table")
    spark.createDataFrame([(1, "a", 1), (2, "b", 1)], ROW).write.parquet(src)
    run = lambda state: upsert_stream(spark.readStream.schema(ROW).parquet(src), table, "k", "at", str(tmp_path / state), buckets=4).awaitTermination()
    run("one")
    first = BucketStore(spark, table, {}).version().number
    run("lost")
    assert BucketStore(spark, table, {}).version().number == first and read_current(spark, table).count() == 2
