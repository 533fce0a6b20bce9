"""Intermediate tables in the shared folder, and what is left there until a session ends."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the cluster names; one of our own only where none is and all runs on this machine."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="foliant-checkpoints-"))
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that outlive an executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Inputs below this size are dealt out anew where they lie in fewer files than there are cores.
SMALL_INPUT = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """Rows of a small input in few files over all cores; larger ones have splits enough and stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return df.repartition(cores) if int(str(size)) < SMALL_INPUT and len(df.inputFiles()) < cores else df


def settled(df: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with ``columns`` made before anything that stands above reads them.

    The optimizer puts what makes a column into a filter on it, and into the lambdas that read
    it, where it runs again for each element; through a generator of one row it does neither.
    """
    return df.select(*[c for c in df.columns if c not in columns], F.inline_outer(F.array(F.struct(*columns)))).select(*df.columns)


@contextmanager
def one_use_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go as soon as those end, not with the driver's garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, was)


def delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables of one run of an operator, written once and read from files.

    ``drop`` deletes those whose last reader is done; ``leave`` names those that a result
    not yet computed still reads, and deletes the rest.  They go with ``release``, at the
    latest when the process ends.
    """

    def __init__(self, spark: SparkSession, what: str) -> None:
        self.spark, self.at = spark, f"{ensure_checkpoint_dir(spark)}/{what}-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        _LEFT.append((spark, self.at))

    def keep(self, df: DataFrame, *by: str) -> DataFrame:
        path = f"{self.at}/{len(self.paths)}"
        with one_use_shuffles(self.spark):
            df.write.partitionBy(*by).option("compression", "zstd").parquet(path)
        read = self.spark.read.schema(df.schema).parquet(path)
        self.paths[len(self.paths)] = path
        read._foliant_path = path
        return read

    def drop(self, *tables: DataFrame) -> None:
        for t in tables:
            delete(self.spark, t._foliant_path)

    def leave(self, *tables: DataFrame) -> None:
        still = {t._foliant_path for t in tables}
        for path in self.paths.values():
            if path not in still:
                delete(self.spark, path)


_LEFT: list[tuple[SparkSession, str]] = []


def release(spark: SparkSession | None = None) -> None:
    """Deletes what results of this session (or of all) were read from; those can't be computed again."""
    for own, path in list(_LEFT):
        if spark is None or own is spark:
            _LEFT.remove((own, path))
            if own.sparkContext._jsc is not None:
                delete(own, path)


atexit.register(release)
