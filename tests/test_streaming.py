"""Micro-batch upserts keep the last row of a key and survive replays."""

from foliant.sources.records import read_json, write_table
from foliant.streaming.upserts import read_current, upsert_stream, windowed_counts


def test_upserts(spark, tmp_path):
    schema = "k long, v string, at long"
    src, table, state = (str(tmp_path / n) for n in ("in", "table", "state"))
    spark.createDataFrame([(1, "a", 1), (2, "b", 1), (1, "c", 2)], schema).write.parquet(src)
    run = lambda: upsert_stream(spark.readStream.schema(schema).parquet(src), table, "k", "at", state).awaitTermination()
    run()
    spark.createDataFrame([(2, "d", 3), (3, "e", 1), (1, "old", 0)], schema).write.mode("append").parquet(src)
    run()
    run()
    assert {(r.k, r.v) for r in read_current(spark, table).collect()} == {(1, "c"), (2, "d"), (3, "e")}


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "a long, b string")
    write_table(df, str(tmp_path / "t"), by="b")
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    df.write.json(str(tmp_path / "j"))
    assert read_json(spark, str(tmp_path / "j"), "a long, b string").first()["b"] == "x"


def test_windows(spark):
    df = spark.sql("select timestamp'2024-01-01 03:00:00' as ts, 'a' as k union all select timestamp'2024-01-01 05:00:00', 'a'")
    assert windowed_counts(df, "ts", ["k"]).first()["n"] == 2
