"""Importance resampling towards a target: hashed word runs, log-odds weights, exact top-k.

A document's weight adds the gain of the bucket of each of its word runs, looked up in an
array; Gumbel noise from the id makes the highest scores a sample without replacement.
The k-th best key (score, id, row) is found by radix selection: each pass counts one digit
of the key among the rows that share the digits found so far, so no rows are sorted to find
it.  Rows up to the key alone are dealt by ranges of it and ranked by their place.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, ship, utf8
from foliant.llm.decontaminate import item_words
from foliant.tables import Scratch

#: Bits of a key that one pass of the selection counts.
DIGIT = 16
#: Bytes of a text that are cut into words at a time.
PIECE = 1 << 20
_SEPARATOR = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))


def pieces(text: bytes, size: int = PIECE) -> Iterator[bytes]:
    """The text in pieces of about ``size`` bytes, cut behind characters that separate words."""
    at = 0
    while len(text) - at > size:
        end = next((i + 1 for i in range(at + size, len(text)) if text[i] in _SEPARATOR), len(text))
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def buckets(text: bytes, most: int, modulus: int) -> Iterator[tuple[int, np.ndarray]]:
    """(words, buckets of the runs of up to ``most`` words that end there) by piece of the text."""
    tail: list[bytes] = []
    for piece in pieces(text):
        words = item_words(piece)
        runs = list(words)
        if most > 1:
            joined = tail + words
            for n in range(2, most + 1):
                runs += [b" ".join(joined[i - n + 1 : i + 1]) for i in range(max(len(tail), n - 1), len(joined))]
            tail = joined[-(most - 1) :]
        yield len(words), np.fromiter(map(zlib.crc32, runs), np.uint32, len(runs)) % modulus


def bucket_counts(texts: DataFrame, most: int, modulus: int) -> np.ndarray:
    """Runs of all texts by bucket: one array a task, added by bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(modulus, np.int64)
        for b in few_rows(batches):
            for text in b.column(0).to_pylist():
                for _, found in buckets(text, most, modulus):
                    total += np.bincount(found, minlength=modulus)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    found = texts.select(utf8(texts["text"]).alias("_t")).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(modulus, np.int64)
    for r in found.collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * log odds) by bucket, with one run more in each."""
    s, t, m = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(b + 1) * float(s + m) / (float(a + 1) * float(t + m)))) for a, b in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int, seed: int) -> int:
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, most: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight, score; without an id no score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = []
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = features = weight = 0
                for n, found in buckets(text, most, len(gain)):
                    words, features, weight = words + n, features + len(found), weight + int(gain[found].sum())
                rows.append((i, words, features, weight, None if i is None else weight + noise(i, seed)))
            yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "n_words", "n_features", "weight", "score"])

    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs["text"]).alias("_t"))
    return own.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long, score long")


def _unsigned(key: str) -> Column:
    """The bits of a long whose order as an unsigned number is the long's order."""
    return F.col(key).bitwiseXOR(F.lit(-(1 << 63)))


def kth_key(rows: DataFrame, keys: list[str], k: int) -> tuple[int, ...]:
    """The k-th smallest (from 1) of the keys, longs without nulls, by digits of DIGIT bits from the top.

    A pass counts at most 2**DIGIT values and reads what shares the digits found so far.
    """
    found: list[int] = []
    for key in keys:
        here = rows.where(reduce(lambda a, b: a & b, [F.col(c) == v for c, v in zip(keys, found, strict=False)], F.lit(True)))
        ends = here.agg(F.min(key).alias("lo"), F.max(key).alias("hi")).first()
        lo, hi = ends["lo"] + (1 << 63), ends["hi"] + (1 << 63)
        # Digits above the highest bit in which two rows differ are the same in all.
        shift = -(-(lo ^ hi).bit_length() // DIGIT) * DIGIT
        prefix = lo >> shift
        while shift:
            shift -= DIGIT
            same = F.lit(True) if shift + DIGIT >= 64 else F.shiftrightunsigned(_unsigned(key), shift + DIGIT) == prefix
            digit = F.shiftrightunsigned(_unsigned(key), shift).bitwiseAND(F.lit((1 << DIGIT) - 1))
            counts = here.where(same).groupBy(digit.alias("digit")).agg(F.count(F.lit(1)).alias("n")).collect()
            for r in sorted(counts, key=lambda r: r["digit"]):
                if k <= r["n"]:
                    prefix = (prefix << DIGIT) | r["digit"]
                    break
                k -= r["n"]
        found.append(prefix - (1 << 63))
    return tuple(found)


def up_to(keys: list[str], last: tuple[int, ...]) -> Column:
    """Rows whose keys don't come after ``last``."""
    cond = F.lit(True)
    for key, v in reversed(list(zip(keys, last, strict=True))):
        cond = (F.col(key) < v) | ((F.col(key) == v) & cond)
    return cond


def ranked(rows: DataFrame, keys: list[str], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(rows with ``rank`` from 1 in order of the keys, the table they are read from).

    Rows are dealt by ranges of the keys and sorted there; a row's place in its range is in
    the low bits of monotonically_increasing_id, and starts of ranges are added up on the driver.
    """
    place = scratch.keep(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = sorted((r["part"], r["n"]) for r in place.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    before = np.cumsum([0, *[n for _, n in sizes]]).tolist()
    starts = place.sparkSession.createDataFrame([(p, s) for (p, _), s in zip(sizes, before, strict=False)], "_part long, _start long")
    met = place.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return met.withColumn("rank", F.col("_start") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("_part", "_start", "_m"), place


def resample(docs: DataFrame, target: DataFrame, most: int = 1, modulus: int = 10_000, min_words: int = 20, percent: int = 10, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null where the row isn't drawn.

    Null and empty texts have no words, weight 0 and a score of noise alone; they fail
    ``min_words``.  A row without an id has a null score, is not drawn and not counted among
    those to draw from.  Ties of score go to the smaller id; rows that repeat an id and score
    are all candidates, and where the last place falls among them the first as stored is
    drawn.  Long texts are cut into words by pieces of a megabyte.  An empty table gives an
    empty result, an empty target weights from the corpus alone.  Other columns are ignored.
    """
    ship(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "resample")
    gain = gains(bucket_counts(docs, most, modulus), bucket_counts(target, most, modulus))
    keys = ["_down", "doc_id", "_row"]
    rows = scratch.keep(scored(docs, gain, most, seed).withColumns({"_down": -F.col("score"), "_row": F.monotonically_increasing_id()}))
    out = ["doc_id", "n_features", "weight", "score"]
    pool = F.col("doc_id").isNotNull() & (F.col("n_words") >= min_words)
    k = rows.where(pool).count() * percent // 100
    if not k:
        scratch.leave(rows)
        return rows.select(*out, F.lit(None).cast("long").alias("rank"))
    drawn = pool & up_to(keys, kth_key(rows.where(pool), keys, k))
    first, place = ranked(rows.where(drawn), keys, scratch)
    scratch.leave(rows, place)
    rest = rows.where(~F.coalesce(drawn, F.lit(False)))
    return first.select(*out, "rank").unionByName(rest.select(*out, F.lit(None).cast("long").alias("rank")))
