"""Labelled documents for fitting classifiers: all of them, or a bounded, reproducible sample."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, learns, utf8


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """doc_id, _y of ids outside the held-out fold; ids with both labels teach nothing."""
    own = labels.select(labels["doc_id"].cast("long").alias("doc_id"), labels[label].cast("int").alias("_y"))
    own = own.where(F.col("doc_id").isNotNull() & F.col("_y").isin(0, 1) & learns()).distinct()
    return own.groupBy("doc_id").agg(F.min("_y").alias("_y"), F.count(F.lit(1)).alias("_n")).where("_n = 1").drop("_n")


def _described(describe: Callable[[list[bytes]], list[bytes]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            out = describe(b.column("_t").to_pylist())
            yield pa.record_batch([b.column("doc_id"), pa.array(out, pa.binary()), b.column("_y"), b.column("_lang")], ["doc_id", "x", "y", "lang"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs["text"]).alias("_t"), docs["lang"].cast("string").alias("_lang"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, describe: Callable[[list[bytes]], list[bytes]]) -> DataFrame:
    """doc_id, x (described text), y, lang of every labelled document outside the held-out fold; equal rows count once."""
    # Rows of one id are in one partition after the join, so nothing more is shuffled for that.
    found = _texts(docs).where(learns()).join(known_labels(labels, label), "doc_id").distinct()
    return found.select("doc_id", "_t", "_y", "_lang").mapInArrow(_described(describe), "doc_id long, x binary, y int, lang string")


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, describe: Callable[[list[bytes]], list[bytes]]
) -> tuple[list[tuple[bytes, int, str | None, int]], dict[int, int]]:
    """(described text, label, lang, doc_id) of at most ``per_class`` documents a class, and class sizes.

    Only ids outside the held-out fold are taken, in order of a hash of the id, so that
    the sample does not depend on partitions.  The ids are a broadcast of 2 * per_class
    rows at most; ``describe`` runs on the executors, so that texts never reach the driver.
    """
    own = known_labels(labels, label)
    sizes = {r["_y"]: r["n"] for r in own.groupBy("_y").agg(F.count(F.lit(1)).alias("n")).collect()}
    order = [F.xxhash64("doc_id", F.lit(5)), F.col("doc_id")]
    take = own.where("_y = 0").orderBy(*order).limit(per_class).unionAll(own.where("_y = 1").orderBy(*order).limit(per_class))
    picked = _texts(docs).join(F.broadcast(take), "doc_id")
    rows = picked.mapInArrow(_described(describe), "doc_id long, x binary, y int, lang string").collect()
    # Repeated document rows would count an id twice; the order makes fits reproducible.
    return sorted({(bytes(r["x"]), r["y"], r["lang"], r["doc_id"]) for r in rows}, key=lambda r: (r[3], r[0])), sizes
