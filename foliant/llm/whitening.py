"""Whitening of embeddings by a two-pass covariance.

Entries become whole numbers, and each distinct vector counts once.  The first pass sums
them exactly, by high and low halves, so that the mean is a whole part and a fraction; the
second adds outer products of centred vectors, one matrix product a batch and one matrix a
task, merged by treeAggregate.  The eigenvectors of the d x d covariance are sent to the
tasks, which project every row; a third pass measures how far the whitened covariance is
from the identity.  What reaches the driver has d x d numbers at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, ship
from foliant.tables import Scratch

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries are held within this, so that what becomes of them is a long.
EDGE = float(1 << 62)
LONGEST = (1 << 63) - 1
OUT = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, x (array of longs) of the rows whose vector is there and wholly finite."""
    own = vectors.select(vectors["vec_id"].cast("long").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("_v"))
    sound = own.where(F.col("_v").isNotNull() & F.forall("_v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))))
    held = lambda c: F.greatest(F.least(SCALE * c, F.lit(EDGE)), F.lit(-EDGE))
    return sound.select("vec_id", F.transform("_v", lambda c: F.floor(held(c)) + SHIFT).alias("x"))


def _matrix(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _merged(fit: DataFrame, dims: int, add: Callable[[np.ndarray], np.ndarray], shape: tuple[int, ...], kind: type) -> np.ndarray:
    """Sum over all rows of what ``add`` makes of a block of vectors: one array a task, merged in a tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in few_rows(batches, 4096):
            part = add(_matrix(b, dims))
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array([total.tobytes()], pa.binary())], ["part"])

    parts = fit.select("x").mapInArrow(run, "part binary").rdd
    merge = lambda a, b: a + b
    return parts.treeAggregate(np.zeros(shape, kind), lambda a, r: a + np.frombuffer(bytes(r[0]), kind).reshape(shape), merge)


def _halves(x: np.ndarray) -> np.ndarray:
    """Exact sums: of the entries' high and low 32 bits, and the number of vectors."""
    return np.concatenate([(x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0), [len(x)]])


def _centred(x: np.ndarray, whole: np.ndarray, rest: np.ndarray) -> np.ndarray:
    return (x - whole).astype(np.float64) - rest


def _outer(x: np.ndarray, whole: np.ndarray, rest: np.ndarray, project: np.ndarray | None = None) -> np.ndarray:
    c = _centred(x, whole, rest)
    c = c if project is None else c @ project
    return c.T @ c


def deviations(x: np.ndarray, whole: np.ndarray, left: np.ndarray, n: int) -> list[int | None]:
    """Sum of (n * x - S)**2 by row, with S = n * whole + left; null beyond a long."""
    y = x - whole
    most = int(max(-int(y.min()), int(y.max()))) if y.size else 0
    if y.shape[1] * (n * (most + 1)) ** 2 <= LONGEST:
        return (((n * y - left) ** 2).sum(1)).tolist()
    sums = (sum((n * a - b) ** 2 for a, b in zip(row, left.tolist(), strict=True)) for row in y.tolist())
    return [s if s <= LONGEST else None for s in sums]


def whiten(vectors: DataFrame, components: int = 16) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component.

    Vectors that are null or hold a null or a number that isn't finite are dropped, and so
    are those whose length isn't the most frequent one (of ties the greatest).  Repeated ids
    and null ids are rows like any others; repeated vectors count once in the fit and get
    rows each.  There are as many components as dimensions at most; one without variance
    (below the rounding of the greatest) has a null ``whitened``, and all have where there
    is one distinct vector, whose ``explained`` is null too.  Equal eigenvalues share a
    plane, in which LAPACK's choice stands.  A scaled entry beyond 2**62 counts as that; a
    deviation beyond a long is null.  No vector at all gives an empty result.  Other columns
    are ignored.
    """
    spark = vectors.sparkSession
    ship(spark)
    own = quantised(vectors)
    length = own.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    dims = length["d"] if length else 0
    if not dims:
        return spark.createDataFrame([], OUT)
    own = own.where(F.size("x") == dims)
    scratch = Scratch(spark, "whitening")
    fit = scratch.keep(own.select("x").distinct())
    sums = _merged(fit, dims, _halves, (2 * dims + 1,), np.int64).tolist()
    n = sums[-1]
    totals = [(h << 32) + low for h, low in zip(sums[:dims], sums[dims:-1], strict=True)]
    whole, left = (np.array(c, np.int64) for c in zip(*(divmod(s, n) for s in totals), strict=True))
    rest = left / n
    values, axes = np.linalg.eigh(_merged(fit, dims, partial(_outer, whole=whole, rest=rest), (dims, dims), np.float64) / n)
    k = min(components, dims)
    top, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    trace = float(values.sum())
    real = top > dims * np.finfo(float).eps * max(float(values[-1]), 0.0)
    project = np.where(real, axes / np.sqrt(np.where(real, top, 1.0)), 0.0)
    unit = _merged(fit, dims, partial(_outer, whole=whole, rest=rest, project=project), (k, k), np.float64) / n
    error = float(np.abs(unit - np.diag(real.astype(float))).max())
    explained = [float(e) / trace if trace > 0 else None for e in top]
    scratch.drop(fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches, 1024):
            x, m = _matrix(b, dims), b.num_rows
            scores = _centred(x, whole, rest) @ project
            ids = b.column(b.schema.get_field_index("vec_id")).take(pa.array(np.repeat(np.arange(m), k)))
            yield pa.record_batch(
                [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n, np.int64)),
                    pa.array(deviations(x, whole, left, n), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                    pa.array(scores.ravel(), mask=np.tile(~real, m)), pa.array(explained * m, pa.float64()), pa.array(np.full(m * k, error)),
                ],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return own.mapInArrow(run, OUT)
