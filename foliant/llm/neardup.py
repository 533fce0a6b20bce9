"""MinHash near-duplicates by a multi-index Hamming join.

A document's set is its distinct shingles.  Its signature has CHUNKS x WIDTH symbols of
16 bits, one per hash function.  By pigeonhole, signatures that differ in at most
CHUNKS * (ERRORS + 1) - 1 symbols (11 of 24) agree in some chunk up to ERRORS of its
symbols; leaving every choice of ERRORS symbols of every chunk out enumerates the allowed
errors, so all such pairs share a key.  At a similarity of 0.8 a pair shares none with a
probability of 4e-5, at 0.85 of 2e-6.  Candidates are confirmed on the full sets.

Work per bucket of a key is linear in its size first: every member is compared with the
bucket's most central one, that shares most buckets with others.  Where these links leave a
bucket in several components, its members outside the largest one are compared with the
others.  Such pairs are made only if they share a shingle of their sets' prefixes (the
rarest ones, enough of them that similar sets must share one) and a bucket, and differ in
component: so pairs that can't be links, or can add nothing, are not enumerated.
Documents with equal sets are one class.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import few_rows, lower_words, ship, utf8, word_hash
from foliant.operators.graph import components
from foliant.tables import Scratch

CHUNKS, WIDTH, ERRORS = 6, 4, 1
SYMBOLS = CHUNKS * WIDTH
#: A candidate whose signatures differ in more symbols has a similarity of 0.8 with a chance under 1e-9 of being missed.
FAR = 18
#: Bytes kept of a shingle's hash where sets are compared: two of 20,000 shingles each meet by chance once in a million.
KEPT = 6
#: Candidates whose shingles say which are frequent, and how many of those are remembered: they come last in prefixes.
ASKED, FREQUENT = 20_000, 200_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(1 << 62, size=SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(1 << 63, size=SYMBOLS, dtype=np.uint64)
_PLACE = _RNG.integers(1 << 62, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SLICE = 50_000


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: bytes, words: int = 4) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, an empty one none."""
    w = lower_words(text)
    h = np.fromiter(map(word_hash, w), dtype=np.uint64, count=len(w))
    k = min(words, len(h))
    if not k:
        return h
    total = np.full(len(h) - k + 1, np.uint64(k), np.uint64)
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _PLACE[i]
    return np.unique(_mix(total))


def signature(shingles: np.ndarray) -> np.ndarray:
    best = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(shingles), SLICE):
        part = _mix(shingles[lo : lo + SLICE, None] * _A + _B)
        best = np.minimum(best, part.min(axis=0))
    return (best & np.uint64(0xFFFF)).astype(np.uint16)


def chunk_keys(signatures: np.ndarray) -> np.ndarray:
    """(rows, CHUNKS * WIDTH) int64 keys: each chunk with each one of its symbols left out."""
    chunks = signatures.reshape(len(signatures), CHUNKS, WIDTH).astype(np.uint64)
    out = np.empty((len(signatures), CHUNKS, WIDTH), np.uint64)
    for gap in range(WIDTH):
        rest = [i for i in range(WIDTH) if i != gap]
        key = np.zeros(chunks.shape[:2], np.uint64)
        for i in rest:
            key = (key << np.uint64(16)) | chunks[:, :, i]
        tag = (np.arange(CHUNKS, dtype=np.uint64) * np.uint64(WIDTH) + np.uint64(gap + 1)) * np.uint64(0xD6E8FEB86659FD93)
        out[:, :, gap] = _mix(key ^ tag)
    return out.reshape(len(signatures), -1).view(np.int64)


def _describe(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            n, cls, sig = [], [], []
            for t in b.column("_t").to_pylist():
                s = shingle_set(t, words)
                n.append(len(s))
                cls.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sig.append(signature(s).tobytes() if len(s) else None)
            yield pa.record_batch([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(sig, pa.binary())], ["doc_id", "n_shingles", "_cls", "_sig"])

    return run


def _spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches, 4096):
        keys = chunk_keys(np.frombuffer(b"".join(b.column("_sig").to_pylist()), np.uint16).reshape(b.num_rows, SYMBOLS))
        yield pa.record_batch([pa.array(keys.reshape(-1)), pa.array(np.repeat(b.column("rep").to_numpy(), keys.shape[1]))], ["key", "rep"])


def pack_set(shingles: np.ndarray) -> bytes:
    """The low KEPT bytes of each shingle, sorted."""
    low = np.unique(shingles & np.uint64((1 << 8 * KEPT) - 1))
    return low.view(np.uint8).reshape(-1, 8)[:, :KEPT].tobytes()


def unpack_set(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // KEPT, 8), np.uint8)
    out[:, :KEPT] = np.frombuffer(data, np.uint8).reshape(-1, KEPT)
    return out.reshape(-1).view(np.int64)


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            yield pa.record_batch([b.column("node"), pa.array([pack_set(shingle_set(t, words)) for t in b.column("_t").to_pylist()], pa.binary())], ["node", "_set"])

    return run


def _asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in few_rows(batches):
        s, n = np.unique(np.concatenate([unpack_set(x) for x in b.column("_set").to_pylist()]), return_counts=True)
        yield pa.record_batch([pa.array(s), pa.array(n)], ["shingle", "n"])


def prefix_length(n: int, numerator: int, denominator: int) -> int:
    """So many of its first shingles, in any one order, hold one of every set that is similar enough."""
    return n - -(-n * numerator // denominator) + 1


def _prefixes(frequent: np.ndarray, rank: np.ndarray, numerator: int, denominator: int):
    """Rows (shingle, at, node, n, few, c, sig) of the sets' prefixes, frequent shingles last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            rows = []
            for data in b.column("_set").to_pylist():
                s = unpack_set(data)
                at = np.minimum(np.searchsorted(frequent, s), max(0, len(frequent) - 1))
                last = np.where(frequent[at] == s, rank[at], 0) if len(frequent) else np.zeros(len(s), np.int64)
                rows.append(s[np.lexsort((s, last))[: prefix_length(len(s), numerator, denominator)]])
            size = np.array([len(x) for x in rows])
            own = np.repeat(np.arange(len(rows)), size)
            place = np.arange(len(own)) - np.repeat(np.cumsum(size) - size, size)
            rest = pa.array(own)
            yield pa.record_batch(
                [pa.array(np.concatenate(rows)), pa.array(place.astype(np.int32)), *[b.column(c).take(rest) for c in ("node", "n", "few", "c", "sig")]], ["shingle", "at", "node", "n", "few", "c", "sig"]
            )

    return run


def _confirm(numerator: int, denominator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in few_rows(batches):
            ok = []
            for x, y in zip(b.column("_set_a").to_pylist(), b.column("_set_b").to_pylist(), strict=True):
                p, q = unpack_set(x), unpack_set(y)
                both = len(np.intersect1d(p, q, assume_unique=True))
                ok.append(denominator * both >= numerator * (len(p) + len(q) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.record_batch([b.column("a").filter(keep), b.column("b").filter(keep)], ["a", "b"])

    return run


def near_duplicates(docs: DataFrame, words: int = 4, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs``.

    Documents are linked when their sets' Jaccard similarity is at least ``similarity``;
    ``component_id`` is the smallest id reachable, ``kept`` marks the row with that id.
    Rows without words, or with null text, are linked with nothing and kept.  Rows that
    repeat an id are one document, whatever their texts: it is linked where one of them is,
    and its rows are kept or not together.  Rows without an id are linked with nothing, have
    a null component and are kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    ship(spark)
    scratch = Scratch(spark, "neardup")
    num, den = similarity
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), utf8(docs["text"]).alias("_t"))
    rows = scratch.keep(own.mapInArrow(_describe(words), "doc_id long, n_shingles long, _cls binary, _sig binary"))
    sound = rows.where("_cls is not null and doc_id is not null")
    classes = scratch.keep(sound.groupBy("_cls").agg(F.min("doc_id").alias("rep"), F.first("_sig").alias("_sig"), F.first("n_shingles").alias("_n")))

    # Buckets with more than one member, and each member's.
    keys = classes.select("rep", "_sig").mapInArrow(_spread, "key long, rep long")
    buckets = scratch.keep(keys.groupBy("key").agg(F.count(F.lit(1)).alias("_size")).where("_size > 1"))
    members = scratch.keep(keys.join(buckets, "key").groupBy("rep").agg(F.collect_list("key").alias("_keys"), F.sum("_size").alias("_pull")))
    scratch.drop(buckets)
    each = members.select("rep", "_pull", F.explode("_keys").alias("key"))
    top = F.max(F.struct("_pull", (-F.col("rep")).alias("_down")))["_down"]
    centres = scratch.keep(each.groupBy("key").agg((-top).alias("centre")))
    stars = scratch.keep(
        each.join(centres, "key").where("rep != centre").select(F.least("centre", "rep").alias("a"), F.greatest("centre", "rep").alias("b")).distinct()
    )
    scratch.drop(centres)
    # Signatures and sets of the candidates only; sets come from the whole texts again.
    nodes = members.select(F.col("rep").alias("node"))
    signed = scratch.keep(classes.withColumnRenamed("rep", "node").join(nodes, "node", "left_semi").select("node", "_sig", "_n"))
    # Texts and sets are always joined by shuffle, so that all sizes behave alike.
    sets = scratch.keep(own.withColumnRenamed("doc_id", "node").join(nodes.hint("merge"), "node", "left_semi").mapInArrow(_sets(words), "node long, _set binary"))

    def confirmed(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose full sets are similar enough; sizes and signatures rule out most others."""
        side = lambda s: signed.select(F.col("node").alias(s), F.col("_sig").alias(f"_sig_{s}"), F.col("_n").alias(f"_n_{s}"))
        close = (den * F.least("_n_a", "_n_b") >= num * F.greatest("_n_a", "_n_b")) & (_unlike(range(SYMBOLS), "_sig_a", "_sig_b") <= FAR)
        near = scratch.keep(pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b"))
        full = lambda s: sets.select(F.col("node").alias(s), F.col("_set").alias(f"_set_{s}"))
        found = scratch.keep(near.join(full("b").hint("merge"), "b").join(full("a").hint("merge"), "a").mapInArrow(_confirm(num, den), "a long, b long").distinct())
        scratch.drop(near)
        return found

    links = confirmed(stars)
    scratch.drop(stars)
    found = components(links, scratch)
    scratch.drop(links)

    # Members of buckets in several components; ``few`` are outside their bucket's largest one.
    label = scratch.keep(members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("rep", "_keys", F.coalesce("component", "rep").alias("c")))
    scratch.drop(members)
    placed = label.select("rep", "c", F.explode("_keys").alias("key"))
    sizes = placed.groupBy("key", "c").agg(F.count(F.lit(1)).alias("_m"))
    mixed = scratch.keep(sizes.groupBy("key").agg(F.count(F.lit(1)).alias("_parts"), F.max(F.struct("_m", "c"))["c"].alias("main")).where("_parts > 1").select("key", "main"))
    apart = scratch.keep(placed.join(mixed, "key").groupBy("rep").agg(F.first("c").alias("c"), F.max(F.col("c") != F.col("main")).alias("few")).withColumnRenamed("rep", "node"))
    scratch.drop(label, mixed)
    signs = apart.join(signed.select("node", F.col("_sig").alias("sig")), "node")
    chosen = scratch.keep(sets.join(signs.hint("merge"), "node").select("node", "_set", "c", "few", "sig", (F.octet_length("_set") / KEPT).cast("int").alias("n")))
    # Which shingles are frequent only orders prefixes; any order finds the same links.
    few_nodes = chosen.select("node").orderBy(F.xxhash64("node"), "node").limit(ASKED).distinct()
    told = chosen.join(F.broadcast(few_nodes), "node").select("_set").mapInArrow(_asked, "shingle long, k long").groupBy("shingle").agg(F.sum("k").alias("k"))
    # As columns: rows of Python objects would take the driver a hundred times their size.
    told = told.where("k > 2").orderBy(F.col("k").desc(), "shingle").limit(FREQUENT).toArrow().sort_by("shingle")
    frequent, rank = (told.column(c).to_numpy().astype(np.int64) for c in ("shingle", "k"))
    prefix = scratch.keep(chosen.mapInArrow(_prefixes(frequent, rank, num, den), "shingle long, at int, node long, n int, few boolean, c long, sig binary"))
    scratch.drop(chosen, apart)
    x, y = prefix.where("few").alias("x"), prefix.alias("y")
    rest = F.least(F.col("x.n") - F.col("x.at"), F.col("y.n") - F.col("y.at"))
    meet = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.c") != F.col("y.c")) & (den * rest >= num * (F.col("x.n") + F.col("y.n") - rest))
    meet = meet & _share_bucket("x.sig", "y.sig") & (_unlike(range(SYMBOLS), "x.sig", "y.sig") <= FAR)
    cross = scratch.keep(x.join(y, meet).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct())
    scratch.drop(prefix)
    more = confirmed(cross)
    scratch.drop(cross, sets, signed)

    # Components of components; rows that repeat an id with another text join theirs.
    placed = scratch.keep(classes.select("_cls", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left").select("_cls", "rep", F.coalesce("component", "rep").alias("c")))
    scratch.drop(found)
    of = lambda c, n: placed.select(F.col("rep").alias(c), F.col("c").alias(n)).distinct()
    again = sound.select("doc_id", "_cls").distinct().join(placed, "_cls").select("doc_id", "c")
    firsts = again.groupBy("doc_id").agg(F.min("c").alias("x"), F.max("c").alias("_z")).where("x < _z").drop("_z")
    joins = more.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y").unionAll(again.join(firsts, "doc_id").select("x", F.col("c").alias("y")))
    joins = scratch.keep(joins.where("x != y").distinct())
    merged = components(joins, scratch, "x", "y")
    done = scratch.keep(placed.join(merged.withColumnRenamed("node", "c"), "c", "left").select("_cls", F.coalesce("component", "c").alias("_component")))
    scratch.leave(rows, done)
    out = rows.join(done, "_cls", "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("_component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _unlike(symbols: range, x: str, y: str) -> Column:
    """In how many of some symbols (two bytes each) two signatures differ."""
    return F.expr(" + ".join(f"int(substring({x}, {2 * i + 1}, 2) != substring({y}, {2 * i + 1}, 2))" for i in symbols))


def _share_bucket(x: str, y: str) -> Column:
    """Whether some chunk differs in ERRORS symbols at most."""
    chunks = [_unlike(range(c * WIDTH, (c + 1) * WIDTH), x, y) <= ERRORS for c in range(CHUNKS)]
    return reduce(lambda a, b: a | b, chunks)
